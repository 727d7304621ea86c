"""Realigned pairs against plain dynamic programming; mutual information, curation by chains and mapped trees on small tables."""

import math
import random
from functools import lru_cache

import pytest

from cladewise.operators import clusters, hits
from cladewise.operators.realign import Scoring, counts, counts_of, pair_identities, within


def plain(a, b, s):
    """Best (score, equal pairs, pairs), by last step: a pair, a residue of a, a residue of b."""
    none = (-(10**9), 0, 0)

    def plus(x, *y):
        return tuple(i + j for i, j in zip(x, y))

    @lru_cache(None)
    def best(i, j, step):
        if i == j == 0:
            return (0, 0, 0) if step == 0 else none
        if step == 0:
            if not (i and j):
                return none
            top = max(best(i - 1, j - 1, k) for k in range(3))
            return plus(top, s.same, 1, 1) if a[i - 1] == b[j - 1] else plus(top, s.other, 0, 1)
        if not (i if step == 1 else j):
            return none
        return max(plus(best(i - (step == 1), j - (step == 2), k), -(s.extension if k == step else s.opening), 0, 0) for k in range(3))

    return max(best(len(a), len(b), k) for k in range(3))[1:]


@pytest.mark.parametrize("s", [Scoring(), Scoring(1, -1, 1, 1), Scoring(2, -3, 4, 1)])
def test_counts(s):
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("ACD", k=rng.randrange(10))) for _ in range(2))
        assert counts(a, b, s) == counts(b, a, s) == plain(a, b, s)


def test_many_at_once():
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choices("ACD", k=rng.choice([0, 1, 5, 12, 30]))) for _ in range(2)) for _ in range(200)]
    assert counts_of(pairs) == [plain(a, b, Scoring()) for a, b in pairs] and counts_of([]) == []


def test_very_large_scores_are_exact():
    big = Scoring(5 << 50, -4 << 50, 12 << 50, 2 << 50)
    rng = random.Random(2)
    for _ in range(30):
        a, b = ("".join(rng.choices("ACD", k=8)) for _ in range(2))
        assert counts(a, b, big) == counts(a, b)


def test_pair_identities(spark):
    rows = [(1, "ACDEF", "x"), (2, "ACDF", "x"), (3, "", "x"), (4, None, "y"), (5, "ACDEF", "y")]
    seqs = spark.createDataFrame(rows, "seq_id bigint, seq string, grp string")
    got = {(r.a, r.b): (r.n_same, r.n_both, r.identity) for r in pair_identities(seqs, within(seqs)).collect()}
    assert got == {(1, 2): (*plain("ACDEF", "ACDF", Scoring()), got[1, 2][2]), (1, 3): (0, 0, None), (2, 3): (0, 0, None), (4, 5): (0, 0, None)}
    assert pair_identities(seqs.limit(0), within(seqs)).count() == 0


def test_expected_information(spark):
    rng = random.Random(3)
    one = [rng.choice("abc") for _ in range(60)]
    two = [x if rng.random() < 0.5 else rng.choice("abcd") for x in one]
    frames = [spark.createDataFrame([(i, c) for i, c in enumerate(x)], "member int, c string") for x in (one, two)]
    n, emi = 60, 0.0
    for x in set(one):
        for y in set(two):
            a, b = one.count(x), two.count(y)
            for k in range(max(1, a + b - n), min(a, b) + 1):
                emi += k / n * math.log(n * k / (a * b)) * math.comb(a, k) * math.comb(n - a, b - k) / math.comb(n, b)
    table = clusters.contingency(*frames)
    assert clusters.expected_mi(table).first().emi == pytest.approx(emi, abs=1e-12)
    assert clusters.expected_mi(table, block=3).first().emi == pytest.approx(emi, abs=1e-12)
    r = clusters.adjusted_information(*frames).first()
    assert r.emi == pytest.approx(emi) and 0 < r.ami < 1 and r.n == 60
    alone = spark.createDataFrame([(i, i) for i in range(10)], "member int, c int")
    assert clusters.adjusted_information(alone, alone).first().ami == pytest.approx(1)


def test_curate_chains(spark):
    best = spark.createDataFrame([("p", "t", 5.0, 3, 9), ("q", "t", 50.0, 1, 99), ("p", "u", 1.0, 1, 2), ("q", "u", 7.0, 4, 8), ("q", "v", 6.9, 1, 1)], "profile string, target string, score double, span_s int, span_e int")
    thr = spark.createDataFrame([("p", 5.0, 0), ("q", 7.0, 1)], "profile string, threshold double, ord int")
    got = {r.target: tuple(r)[1:] for r in hits.curate_chains(best, thr).collect()}
    assert got == {"t": ("p", 5.0, 3, 9, 2), "u": ("q", 7.0, 4, 8, 1)}


def test_tree_mapping(spark):
    kind = "query string, target string, identity double, coverage double, ord int"
    there = spark.createDataFrame([("a1", "b1", 90.0, 80.0, 1), ("a2", "b1", 80.0, 90.0, 2), ("a3", "b2", 79.9, 99.0, 3), ("a4", "b2", None, 99.0, 4)], kind)
    back = spark.createDataFrame([("b1", "a1", 99.0, 99.0, 1)], kind)
    one = spark.createDataFrame([("x", "a1"), ("x", "a3"), ("y", "a2")], "clade string, seq_id string")
    first, second = hits.tree_mapping(there, back, one, spark.createDataFrame([], "clade string, seq_id string"))
    assert sorted(map(tuple, second.collect())) == [("b1", "map_x", "a1"), ("b1", "map_y", "a2"), ("b1", "tree_mapping", "a2")]
    assert sorted(map(tuple, first.collect())) == [("a1", "tree_mapping", "b1"), ("a1", "x", "True"), ("a2", "y", "True"), ("a3", "x", "True")]
