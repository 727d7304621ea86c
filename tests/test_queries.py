"""Every registered query of the curation operators against its SQL."""

import pytest
from helpers import same

from cladewise.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, ORACLE_SQL[name])


def test_fold_losses_agree_with_counts(spark, data):
    pairs = QUERIES["fold_losses"](spark, data).groupBy("fold", "int_seq").count()
    counts = QUERIES["loss_counts"](spark, data).filter("n_losses > 0")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, counts.collect()))


def test_resampled_reps_are_members(spark, data):
    from cladewise.plans import views

    reps = QUERIES["resampled_reps"](spark, data)
    c = views.clusters(spark, data)
    assert reps.join(c.withColumnRenamed("member", "new_rep"), ["level", "rep", "new_rep"], "left_anti").count() == 0
    assert reps.count() == 3 * c.select("level", "rep").distinct().count()


def test_greedy_cluster_is_a_partition(spark, data):
    got = QUERIES["greedy_cluster"](spark, data).collect()
    members = [r.member for r in got]
    assert len(members) == len(set(members)) == spark.read.parquet(f"{data}/documents.parquet").count()
    reps = {r.rep for r in got}
    assert all(r.member == r.rep for r in got if r.member in reps)


def test_chains(spark, data):
    from cladewise.plans import views

    got = QUERIES["chained_hits"](spark, data)
    n = views.hits(spark, data).select("profile", "target").distinct().count()
    assert got.select("profile", "target").distinct().count() == n
    best = QUERIES["chain_scores"](spark, data)
    assert best.count() == n


def test_profile_search_finds_places(spark, data):
    """Every item that stands in a document as it is has a hit there, over all its letters."""
    from cladewise.plans import views

    got = {(r.profile, r.target): r for r in QUERIES["profile_search"](spark, data).orderBy("score").collect()}
    docs = views.seqs(spark, data).collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", views.letters().alias("seq")).collect()
    n = 0
    for i in items:
        for t in docs:
            if i.seq and i.seq in t.seq:
                r, n = got[f"B{i.item_id}", t.seq_id], n + 1
                assert r.hmm_e >= r.hmm_s + 0.9 * len("".join(c for c in i.seq if c in "ACDEFGHIKLMNPQRSTVWY")) - 2 and r.score > 50
    assert n and all(r.env_s >= 1 and r.score > 30 for r in got.values())


def test_smart_trim_columns(spark, data):
    low = {(r.aln_id, r.col) for r in QUERIES["smart_trim_stats"](spark, data).collect()}
    got = QUERIES["smart_trim_columns"](spark, data).collect()
    assert got and all((r.aln_id, r.col) in low and r.p >= 0.05 for r in got)
