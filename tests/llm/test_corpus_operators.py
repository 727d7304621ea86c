"""The ten corpus operators against brute force, on given tables and odd rows."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from helpers import same
from pyspark.sql import functions as F

from cladewise.llm import bpe, components, exact_dedup, jaccard_join, mixing, pii, quality, queries, sharding, sketch, substring_dedup, tiff, token_files, wavelet
from cladewise.llm import textnp as tn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two"
ODD = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace(" ", "\t \n"), "b"), (4, None, None), (5, "", "b"), (6, " \n", "c"),
    (7, BASE + " " + BASE, "c"), (8, "é ü 日本 " + "x" * 5000, "c"), (9, "w " * 30000, "a"), (10, "a b c", "b"), (11, "A B c", "b"),
    (12, "mail a@b.c or +49 (30) 1234567, 4111 1111 1111 1111, 10.0.0.255", "d"), (13, BASE.replace("ten", "10"), "a"), (2, BASE, "a"), (None, "no id", "e"),
]
SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, size string, shard string, component_id string, kept string, score string, id string, n int, at int"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use themselves."""
    rows = [(i, t, s, "en", len(t or ""), "x", "x", "x", "x", "x", "x", 1, 1) for i, t, s in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def test_exact_dedup(spark, data, duck, odd, empty):
    same(queries.op1_exact_dedup(spark, data), duck, exact_dedup.ORACLE)
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert [by[i].keep_id for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 4, 6]
    assert by[1].group_size == 4 and by[4].group_size == 2 and by[None].kept
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_split_fingerprints(spark, odd, monkeypatch):
    """With fingerprints that all collide the digests still tell texts apart."""
    want = sorted(map(str, exact_dedup.exact_dedup(odd).collect()))
    real = exact_dedup._chunks
    monkeypatch.setattr(exact_dedup, "_chunks", lambda b, o: (*(x := real(b, o))[:3], np.zeros_like(x[3])))
    run = exact_dedup._recipes
    assert sorted(map(str, exact_dedup.exact_dedup(odd).collect())) == want
    assert run is exact_dedup._recipes


def test_chunks_depend_on_content():
    rng = random.Random(1)
    a = bytes(rng.choices(b"abcdefgh ", k=60000))
    one = np.frombuffer(a, np.uint8)
    two = np.frombuffer(b"zz" * 300 + a, np.uint8)
    ends_1 = exact_dedup.chunk_ends(one, np.array([0, len(one)]))[0]
    ends_2 = exact_dedup.chunk_ends(two, np.array([0, len(two)]))[0]
    assert len(set(e + 600 for e in ends_1) & set(ends_2)) > 0.8 * len(ends_1)
    both = exact_dedup.chunk_ends(np.concatenate([two, one]), np.array([0, len(two), len(two) + len(one)]))
    assert both[1] == [e + len(two) for e in ends_1]


def test_mixing(spark, data, duck, odd, empty):
    same(queries.op2_mixing(spark, data), duck, mixing.ORACLE)
    got = mixing.mixed(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in got)
    per = collections.defaultdict(int)
    for r in got:
        per[r.source, r.target] += r.taken
    assert all(abs(v - t) <= 1 for (_, t), v in per.items())
    assert sum(t for _, t in per) == pytest.approx(sum(r.size for r in got))
    assert all(0 <= r.position <= 1 for r in got if r.taken)
    assert mixing.mixed(empty).count() == 0
    rows = mixing.training_rows(odd)
    assert rows.columns == odd.columns and rows.count() > 0


def token_truth(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_vocabulary())
    tok.no_truncation()
    tok.no_padding()
    return [(i, tok.encode(t or "", add_special_tokens=False).ids, tok) for i, t in rows]


def test_token_files(spark, data, docs, odd, empty):
    start, want = 0, {}
    for i, ids, _ in sorted(token_truth(docs)):
        raw = np.array([*ids, 1], "<u4").tobytes()
        want[i] = (start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_output(spark, data).collect()} == want
    near = [(2**60 + 1, "near"), (2**60 + 3, "nearer")]
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id bigint, text string"))
    shards = token_files.write_shards(more, queries.word_vocabulary(), shard_tokens=100, slice_bytes=200)
    assert shards.count() > 1
    got = sorted(token_files.read_documents(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _, _ in ODD if i is not None), 2**60 + 1, 2**60 + 3]
    assert [r.start for r in got] == list(np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]])
    truth = collections.defaultdict(list)
    for i, ids, _ in token_truth([(i, t) for i, t, _ in ODD] + near):
        truth[i].append([*ids, 1])
    for r in got:
        same = [x for x in truth[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32]
        assert same and (r.n_tokens, r.first_token, r.n_end_ids, r.end_at) == (len(same[0]), same[0][0], same[0].count(1), r.start + r.n_tokens - 1)
    named = spark.createDataFrame([("b", "x y"), ("a", "z"), (None, None)], "doc_id string, text string")
    got = token_files.read_documents(token_files.write_shards(named, queries.word_vocabulary())).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "a", "b"] and got[0].n_tokens == 1
    assert token_files.read_documents(token_files.write_shards(empty, queries.word_vocabulary())).count() == 0


def test_wavelet():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 70000, 140001):
        seq = rng.choice([0, 1, 5, 320, 49407], n).astype(np.uint16)
        w = wavelet.Wavelet(wavelet.build(seq, 16))
        assert (w.tokens() == seq).all()
        for i in rng.integers(0, max(n, 1), 20 if n else 0):
            assert w.access(int(i)) == seq[i]
        for t in (0, 5, 320, 7):
            at = np.flatnonzero(seq == t)
            assert w.count(t) == len(at) and w.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
            if len(at):
                assert w.locate(t, len(at) - 1) == at[-1] and w.locate(t, 0) == at[0] and w.locate(t, len(at) // 2) == at[len(at) // 2]
            assert (w.locate_many(t, np.arange(len(at))) == at).all()
            lo = np.arange(0, n + 1, 997)
            assert w.count_many(t, lo, np.minimum(lo + 500, n)).tolist() == [int((seq[a : a + 500] == t).sum()) for a in lo]
        if n:
            some = rng.integers(0, n, 300)
            assert (w.access_many(some) == seq[some]).all()


def two_alike(n):
    """The two Thue-Morse words of a power of two letters, on which polynomials with an odd base modulo 2**64 collide."""
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join("ab"[x] for x in s), "".join("ba"[x] for x in s)


def test_words_that_defeat_polynomials(spark):
    rows = []
    for n in (64, 128, 1024, 2048, 4096):
        a, b = two_alike(n)
        rows += [(len(rows), a), (len(rows) + 1, b), (len(rows) + 2, " ".join([a] * 25)), (len(rows) + 3, " ".join([b] * 25)), (len(rows) + 4, f"{a} {b} {a}, {b}.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {i: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, ids, _ in token_truth(rows)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.encode_decode(df, queries.word_vocabulary()).collect()} == want
    crc = {i: zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) for i, ids, _ in token_truth(rows)}
    assert {r.doc_id: r.ids_crc32 for r in token_files.read_documents(token_files.write_shards(df, queries.word_vocabulary())).collect()} == crc
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(df).collect()) == linked(rows)
    assert said_windows(substring_dedup.substring_dedup(df)) == windows_truth(rows)


def test_pieces_with_one_hash(monkeypatch):
    """With hashes that all collide the bytes still tell pieces apart."""
    text = "One two, one 12 two! <b> don't one".encode()
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, 10, len(text)])

    def read(found, plain, which, firsts):
        return [(found[k], bool(plain[k])) for k in which], firsts.tolist()

    want = read(*bpe.distinct_pieces(buf, offs))
    monkeypatch.setattr(tn, "word_hashes", lambda b, s, e, which=0: np.zeros(len(s), np.uint64))
    assert read(*bpe.distinct_pieces(buf, offs)) == want
    assert want[0][:4] == [(b"one", True), (b"two", True), (b",", True), (b"o", True)]


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y) if x != y else up[max(x, y)]
    return sorted((str(i), len(s), str(top(i))) for i, s in sets)


def test_jaccard_join(spark, data, docs, odd, empty):
    said = lambda df: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())
    assert said(queries.op4_jaccard_join(spark, data)) == linked(docs)
    assert said(jaccard_join.near_duplicates(odd)) == linked([(i, t) for i, t, _ in ODD])
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_on_near_copies(spark):
    """Groups of near copies, chains of links, and shared passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 60, 120]))]
        for _ in range(rng.choice([2, 5, 25])):
            copy = [word() if rng.random() < rng.choice([0.0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append(" ".join(copy[: rng.choice([len(copy), len(copy) - 1])] + (passage if rng.random() < 0.3 else [])))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == linked(rows)


def test_jaccard_join_of_long_texts(spark):
    """Long texts send numbers, not bitmaps; one pair links, one is at about 0.67."""
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:59_000])), (3, " ".join([*words[:48_000], *(f"v{k}" for k in range(12_000))])), (4, "w1 w2 w3 w4 w5")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == linked(rows)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Frequent shingles, lists in blocks, and families that share much without linking."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(160):
        own = [f"o{i // 3}x{k}" for k in range(rng.choice([4, 8, 12, 16]))]
        rows.append((i, " ".join(base[: rng.choice([20, 40])] + own + ([f"z{i}"] if i % 2 else []))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(df).collect()) == linked(rows)
    with pytest.raises(TypeError):
        jaccard_join.near_duplicates(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(25)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in list(up)}


def test_quality_sample(spark, monkeypatch):
    """The fit sees the first rows by hash of doc_id, 16,000 of them, each with its own buckets and label."""
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.update(rows=rows, labels=labels))
    ids = [i for i in range(21_000)]
    docs = spark.createDataFrame([(i, f"w{i} " * (2 + i % 3)) for i in ids], "doc_id bigint, text string")
    quality.fitted(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int"))
    trained = [r.doc_id for r in docs.filter(quality.fold(F.col("doc_id")) != quality.HELD_OUT_FOLD).orderBy(F.xxhash64("doc_id"), "doc_id").limit(16_000).collect()]
    assert len(trained) == len(seen["rows"]) == len(seen["labels"]) == 16_000
    for k, i in list(enumerate(sorted(trained)))[::500]:
        text = f"w{i} " * (2 + i % 3)
        found, _ = quality.features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert seen["rows"][k].tolist() == found.tolist() and seen["labels"][k] == i % 2


def test_pii(spark, data, docs, odd, empty):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def passes(k, m):
        d = re.sub("[^0-9]", "", m)
        return k == 0 or (k == 1 and all(int(x) <= 255 for x in m.split("."))) or (k == 2 and 12 <= len(d) <= 19 and luhn(d)) or (k == 3 and 9 <= len(d) <= 15)

    def truth(t):
        spans = sorted((m.start(), k, m.end()) for k in range(4) for m in re.finditer(kinds[k], t or "") if passes(k, m[0]))
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        return hashlib.sha256(said.encode()).hexdigest(), *(sum(x[1] == k for x in spans) for k in range(4))

    read = lambda df: sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in df.collect())
    assert read(queries.op5_pii(spark, data)) == sorted((str(i), *truth(t)) for i, t in docs)
    more = ODD + [(20, "a@b.c_d@e.f.g, x@y.z 1.2.3.4.5.6.7.8 01.02.003.0255 1.2.3.256", ""), (21, "12-" * 500 + "1 " + "é😀 x@y.zz " + "1.2.3.4" * 30, "")]
    df = spark.createDataFrame([(i, t) for i, t, _ in more], "doc_id bigint, text string")
    assert read(pii.pii_digest(df)) == sorted((str(i), *truth(t)) for i, t, _ in more)
    assert len(pii.pii_digest(odd).collect()) == len(ODD) and pii.pii_digest(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.redacted(odd).collect()}
    assert masked[12] == "mail [REDACTED] or [REDACTED], [REDACTED], [REDACTED]" and masked[4] is None and masked[10] == "a b c"


def test_pii_adds_planted_spans(spark):
    """Disguised mails, dotted cards and bare telephone numbers are added; what only looks like them is not."""

    def dotted(n, right):
        d = f"4{n * 7919 % 10**14:014d}"
        check = -sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 == 0 else x for k, x in enumerate(map(int, reversed(d)))) % 10
        d += str((check + (not right)) % 10)
        return ".".join(d[i : i + 4] for i in range(0, 16, 4))

    rows, want = [], {}
    for i in range(600):
        phone = f"555-{100 + i % 900}-{1000 + 7 * i}"
        yes = [("email", f"u{i} (at) host{i % 9} (dot) org"), ("card", dotted(i, True)), ("phone", phone)][i % 3]
        before = {"email": "so ", "card": "pay with ", "phone": "please call "}[yes[0]]
        no = [f"lunch (at) {i % 12}.30", f"see {dotted(i + 1, False)}", f"order {phone}"][i // 3 % 3]
        base = f"a{i}@b.example.com +1 {phone}"
        text = f"é {before}{yes[1]} and {no} then {base} end"
        at = len(f"é {before}")
        rows.append((i, text))
        want[i] = (f"{yes[0]}:{at}:{at + len(yes[1])}", no, base)
    got = pii.pii_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for r in got.select("doc_id", pii.written_out(F.col("base")).alias("base"), pii.written_out(F.col("spans")).alias("spans")).collect():
        assert sorted(r.spans.split(",")) == sorted([*r.base.split(","), want[r.doc_id][0]]), (rows[r.doc_id], r)


def test_pii_vectors_are_bounded(spark):
    """However texts vary, a feature takes no more values than its steps, and their product is the stated bound."""
    texts = [" ".join(("-" * (k % 9) + "x" * k, f"{'y' * k}@{'z' * k}.{'1' * k}.org", "1-" * k + "2", f"+1{'(' * (k % 8)}{'5' * k}")) for k in range(1, 40)]
    cands = pii.with_candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ("doc_id",))
    c = cands.select(F.explode("spans").alias("c")).select("c.*")
    most = c.agg(*[F.max(f).alias(f) for f in pii.FEATURES]).first()
    sizes = {f: len(cuts) + 1 for f, cuts in pii.CUTS.items()} | dict(zip(("checked", "context", "before", "after"), pii.OTHERS))
    assert all(most[f] < n for f, n in sizes.items())
    assert len(pii.GENERATORS) * np.prod(list(sizes.values())) * 2 == pii.MOST_VECTORS <= 200_000


def test_pii_trees():
    """Trees tell vectors apart, and thresholds follow held-out evidence."""

    class Counts:
        def limit(self, n):
            return self

        def collect(self):
            from pyspark.sql import Row

            out = []
            for held in (False, True):
                for digits in range(12):
                    v = dict.fromkeys(pii.FEATURES, 0) | {"kind": 3, "gen": 1, "digits": digits}
                    out.append(Row(held=held, good=50 * (digits >= 9), n=50, **v))
            return out

    trees = pii.fitted(Counts())
    v = lambda d: tuple(3 if f == "kind" else 1 if f == "gen" else d if f == "digits" else 0 for f in pii.FEATURES)
    assert trees.margin(v(10)) >= trees.thresholds[3] > trees.margin(v(5))


def test_bpe(spark, data, docs, odd, empty):
    more = [t for _, t, _ in ODD] + ["a<|endoftext|>b <|startoftext|>", "ΣΑΣ İstanbul ǅ ﬁ é x y 1234 ½ _foo_ --- \x1c\x1d a\x1cb 🙂👍🏽", "x y\x85z don't 'twas 's it'LL", "aaaaaaaaaaaa!!!!!!??..,,"]
    rows = docs + list(enumerate(more, 1_000_000))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {}
    for i, ids, tok in token_truth(rows):
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df, queries.word_vocabulary()).collect()} == want
    kept = bpe.encode_decode(df, queries.word_vocabulary(), keep=("decoded", "ids")).collect()
    assert all(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in kept)
    assert bpe.encode_decode(odd, queries.word_vocabulary()).count() == len(ODD)
    assert bpe.encode_decode(empty, queries.word_vocabulary()).count() == 0


def test_bpe_pieces_of_random_letters():
    from tokenizers import Tokenizer

    b = bpe.loaded(queries.word_vocabulary())
    assert b.ordered
    tok = Tokenizer.from_file(queries.word_vocabulary())
    rng = random.Random(9)
    for _ in range(1500):
        w = "".join(rng.choices("aeiostnrhlé", k=rng.randrange(1, 18)))
        assert b.piece_ids(w) == tok.encode(w, add_special_tokens=False).ids


def test_quality(spark, data, odd, empty):
    labels = spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet")
    df = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality(df, labels).collect()
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good = [r.score for r in held if truth[r.doc_id] == 1]
    bad = [r.score for r in held if truth[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    model = quality.fitted(df, labels)
    assert len(quality.scored(odd, model).collect()) == len(ODD)
    assert quality.kept(odd, model).columns == odd.columns
    assert quality.quality(empty, labels).count() == 0
    none = quality.quality(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}


def windows_truth(rows):
    seen, out, texts = {}, {}, collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(WORD.findall(t or ""))
    for i in sorted(texts, key=lambda x: -1 if x is None else x):
        for w in texts[i]:
            for a in range(len(w) - 19):
                k = tuple(w[a : a + 20])
                seen[k] = min(seen.get(k, (i, a)), (i, a), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    for i, many in texts.items():
        marks = {a for w in many for a in range(len(w) - 19) if seen[tuple(w[a : a + 20])] != (i, a)}
        for w in many:
            gone = {x for a in marks for x in range(a, a + 20)}
            kept = [x for k, x in enumerate(w) if k not in gone]
            out.setdefault(str(i), []).append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def said_windows(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[str(r.doc_id)].append((r.n_words, r.n_removed, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


def test_substring_dedup(spark, data, docs, odd, empty, monkeypatch):
    assert said_windows(queries.op8_substring_dedup(spark, data)) == windows_truth(docs)
    want = windows_truth([(i, t if i != 9 else "w " * 3000) for i, t, _ in ODD])
    df = spark.createDataFrame([(i, t if i != 9 else "w " * 3000) for i, t, _ in ODD], "doc_id bigint, text string")
    assert said_windows(substring_dedup.substring_dedup(df)) == want
    monkeypatch.setattr(substring_dedup, "HELD", 40)
    assert said_windows(substring_dedup.substring_dedup(df)) == want
    # One 8-word phrase in many surroundings: its windows are dealt, and repeats are still found.
    rng, phrase = random.Random(3), " ".join(f"p{k}" for k in range(8))
    around = [" ".join(f"{c}{i // 3 if i % 3 else i}x{k}" for k in range(14)) for i in range(400) for c in "ab"]
    rows = [(i, f"{around[2 * i]} {phrase} {around[2 * i + 1]}") for i in range(400)]
    rng.shuffle(rows)
    assert said_windows(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))) == windows_truth(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(odd, keep_text=True).count() == len(ODD)


def test_sketch_never_loses(spark):
    """With far too few counters repeated hashes are still all found."""
    rng = np.random.default_rng(1)
    h = tn.mix64(rng.integers(0, 3000, 5000).astype(np.uint64))
    df = spark.createDataFrame([(i,) for i in range(10)], "k int").repartition(4)

    def hashes(batch):
        for k in batch.column("k").to_pylist():
            yield h[k * 500 : (k + 1) * 500]

    values, counts = np.unique(h, return_counts=True)
    for width in (16, 20):
        found, often = sketch.repeated(df, hashes, width, 2)
        seen = found.maybe(values)
        assert (often.weight(values) > 0).sum() == 0
        assert seen[counts > 1].all()
    assert (~seen[counts == 1]).mean() > 0.9


def test_sharding(spark, data, docs, odd, empty):
    got = queries.op9_sharding(spark, data).collect()
    text = dict(docs)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode())) for r in got)
    got.sort(key=lambda r: r.doc_id)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(v == list(range(len(v))) for v in slots.values())
    total, most = sum(r.size for r in got), max(r.size for r in got)
    sums = collections.Counter()
    for r in got:
        sums[r.shard] += r.size
    assert all(abs(sums[k] - total / 24) <= 2 * most for k in range(24))
    rows = sharding.byte_shards(odd).collect()
    assert len(rows) == len(ODD) and sharding.byte_shards(empty).count() == 0


def test_tiff(spark, data, docs, odd, empty):
    text = dict(docs)
    for r in queries.op10_tiff(spark, data).collect():
        raw = text[r.doc_id].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    got = tiff.media_digest(odd).collect()
    assert len(got) == len(ODD) and tiff.media_digest(empty).count() == 0
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1
    media = spark.createDataFrame([(1, 3, bytearray(b"abc")), (2, 0, None), (3, 9, bytearray(tiff.write_tiff(b"x" * 192 * 3000)))], "doc_id bigint, n_bytes bigint, media binary")
    pages = tiff.tiff_pages(media).collect()
    assert [(r.doc_id, r.page, r.height) for r in sorted(pages, key=lambda r: (r.doc_id, r.page))] == [(1, 0, None), (3, 0, 1024), (3, 1, 1024), (3, 2, 952)]
    assert pages[0].error
    small = spark.createDataFrame([(1, "abc")], "doc_id smallint, text string")
    assert [r.doc_id for r in tiff.media_digest(small).collect()] == [1]


def test_broken_tiff(spark):
    whole = tiff.write_tiff(b"0123456789ab" * 16 * 1500)
    wide = bytearray(tiff.write_tiff(b"x" * 192))
    at = struct.unpack_from("<I", wide, 4)[0]
    struct.pack_into("<HHIH", wide, at + 2, tiff.WIDTH, 3, 1, 65535)
    rows = [(1, 0, bytearray(whole[: len(whole) // 2])), (2, 0, bytearray(b"junk")), (3, 0, wide), (4, 0, bytearray(whole))]
    got = {r.doc_id: r for r in tiff.file_digests(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    for k in (1, 2, 3):
        assert got[k].error and got[k].payload_sha256 is None and got[k].payload_bytes is None
    assert got[4].error is None and got[4].payload_bytes == 192 * 1500


def directory(order, tags, at):
    """A directory of one page with short values only."""
    out = struct.pack(order + "H", len(tags))
    for tag, (kind, values) in sorted(tags.items()):
        data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        assert len(data) <= 4
        out += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return out + b"\0" * 4


def test_tiff_of_other_writers():
    """Files put together by hand: big-endian, strips that do not divide the height, tiles over the border, LZW beyond 9 bits."""
    samples = bytes(random.Random(2).choices(range(256), k=40 * 30))
    grey = np.frombuffer(samples, np.uint8).reshape(40, 30)
    parts = [samples[: 25 * 30], samples[25 * 30 :]]
    for scheme, encode in ((1, bytes), (tiff.PACKBITS, tiff.packbits_encode), (tiff.LZW, tiff.lzw_encode), (tiff.DEFLATE, zlib.compress)):
        one, two = map(encode, parts)
        # Two offsets do not fit in a field of four bytes: they come first.
        body = struct.pack(">IIII", 24, 24 + len(one), len(one), len(two)) + one + two
        at = 8 + len(body)
        tags = {256: (3, [30]), 257: (3, [40]), 258: (3, [8]), 259: (3, [scheme]), 277: (3, [1]), 278: (3, [25])}
        raw = struct.pack(">H", 8) + b"".join(struct.pack(">HHI", t, k, 1) + struct.pack(">H", v[0]).ljust(4, b"\0") for t, (k, v) in sorted({**tags}.items()) if t < 273)
        raw += struct.pack(">HHII", 273, 4, 2, 8)
        raw += b"".join(struct.pack(">HHI", t, k, 1) + struct.pack(">H", v[0]).ljust(4, b"\0") for t, (k, v) in sorted(tags.items()) if t > 273)
        raw += struct.pack(">HHII", 279, 4, 2, 16) + b"\0" * 4
        [(_, page)] = tiff.read_pages(b"MM\0*" + struct.pack(">I", at) + body + raw)
        assert (page[:, :, 0] == grey).all(), scheme
    tile = np.zeros((48, 32), np.uint8)
    tile[:40, :30] = grey
    packed = zlib.compress(tile.tobytes())
    tags = {256: (3, [30]), 257: (3, [40]), 258: (3, [8]), 259: (3, [tiff.OLD_DEFLATE]), 277: (3, [1]), 322: (3, [32]), 323: (3, [48]), 324: (4, [8]), 325: (4, [len(packed)])}
    [(_, page)] = tiff.read_pages(b"II*\0" + struct.pack("<I", 8 + len(packed)) + packed + directory("<", tags, 8 + len(packed)))
    assert (page[:, :, 0] == grey).all()
    # A fixed stream of the format: clear, 7, 258, 8, 8, 258, 6, 6, end in codes of nine bits.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(stream, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_tiff_codings():
    rng = random.Random(4)
    for n in (0, 1, 2, 127, 128, 129, 600, 20000):
        for raw in (rng.randbytes(n), b"a" * n, bytes(rng.choices(b"ab", k=n))):
            assert tiff.lzw_decode(tiff.lzw_encode(raw), n) == raw
            assert tiff.packbits_decode(tiff.packbits_encode(raw), n) == raw
