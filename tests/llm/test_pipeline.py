"""The pipeline against a plain version of its stages."""

import collections

from test_corpus_operators import linked, token_truth

import corpus_pipeline
from cladewise.llm import mixing, quality
from cladewise.session import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_duplicates", "mixing", "bpe"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = [r for r in quality.scored(docs, quality.fitted(docs, labels), ("doc_id", "text")).collect() if r.score >= 0.3]
    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(" ".join(r.text.split()) if r.text.isascii() else r.text, r)
    alone = [(r.doc_id, r.text) for r in first.values()]
    stay = {int(i) for i, _, c in linked(alone) if i == c}
    left = docs.filter(docs.doc_id.isin(list(stay)))
    want = collections.Counter(r.doc_id for r in mixing.training_rows(left).collect())
    ids = {i: len(t) for i, t, _ in token_truth([x for x in alone if x[0] in stay])}

    state = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        state = written(stage(spark, state, data), f"test-{name}")
        if k < 4:
            assert state.columns == docs.columns
        if k == 2:
            assert {r.doc_id for r in state.select("doc_id").collect()} == stay
    got = state.collect()
    assert collections.Counter(r.doc_id for r in got) == want
    assert all(r.n_tokens == ids[r.doc_id] for r in got)


def test_empty_and_extra_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), "test-empty")
    assert docs.count() == 0
    some = spark.createDataFrame([(1, None, None, "a", 0, 5), (2, "", "en", None, 0, 6), (3, "Some words of a text.", "en", "a", 0, 7), (3, "Some words of a text.", "en", "a", 0, 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        some = written(stage(spark, some, data), "test-odd")
        assert k == 4 or "component_id" in some.columns
