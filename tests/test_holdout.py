"""Range sums, interval joins and hold-out runs against plain versions."""

import math
import random

import pytest
from helpers import same
from pyspark.sql import functions as F

from cladewise.operators import holdout, intervals, ranges, robust
from cladewise.plans import views
from cladewise.plans.queries import ORACLE_SQL


@pytest.mark.parametrize("descending", [False, True])
def test_running(spark, descending):
    rng = random.Random(1)
    rows = [(k, o, rng.randrange(9)) for k in ("a", "b", None) for o in rng.sample(range(500), 90)]
    got = ranges.running(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], "o", {"s": "v"}, descending)
    want = sorted(str((k, o, v, sum(x for j, p, x in rows if j == k and (p >= o if descending else p <= o)))) for k, o, v in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    every = ranges.running(spark.createDataFrame([(i, 1) for i in range(100)], "o int, v int"), [], "o", {"s": "v"})
    assert all(r.s == r.o + 1 for r in every.collect())


def test_rank_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), rng.choice([None, 1.0, 2.0, 2.5, 7.0])) for i in range(60)]
    others = [(rng.choice("xyz"), rng.choice([None, 1.0, 2.0, 3.0]), rng.randrange(5)) for _ in range(80)]
    a, b = spark.createDataFrame(rows, "i int, f string, score double"), spark.createDataFrame(others, "f string, score double, v int")
    for above in (True, False):
        for keys in (["f"], []):
            got = {r.i: (r.s, r.n) for r in ranges.rank_sums(a, b, keys, {"s": "v", "n": F.lit(1)}, above).collect()}
            for i, f, s in rows:
                hit = [v for g, t, v in others if s is not None and t is not None and (not keys or f == g) and (t > s if above else t < s)]
                assert got[i] == (sum(hit), len(hit))
    assert ranges.rank_sums(a.limit(0), b, [], {"s": "v"}, True).count() == 0
    assert {r.s for r in ranges.rank_sums(a, b.limit(0), ["f"], {"s": "v"}, True).collect()} == {0}


def test_contained(spark):
    rng = random.Random(3)
    spans = [(i, *sorted(rng.choices(range(-0, 1000), k=2))) for i in range(80)] + [(80, 5, 4), (81, 0, 2**40), (82, 7, 7)]
    points = [(i, rng.randrange(1000)) for i in range(120)] + [(120, 0), (121, 2**40), (122, 2**40 + 1)]
    got = intervals.contained(spark.createDataFrame(points, "p int, at bigint"), "at", spark.createDataFrame(spans, "s int, lo bigint, hi bigint"), "lo", "hi")
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if a <= x <= b)
    assert intervals.contained(spark.createDataFrame(points, "p int, at bigint"), "at", spark.createDataFrame([], "s int, lo bigint, hi bigint"), "lo", "hi").count() == 0


def plain_cas(holdouts, thresholds):
    """The definition, pair by pair."""
    held = {}
    for f, i, s in holdouts:
        held.setdefault(f, {})[i] = s
    beats = {(f, i): [t for t, own, x in thresholds if s is not None and x is not None and own != f and x > s] for f, i, s in holdouts}
    hard = {t: sum(sum(t in beats[f, i] for i in held[f]) / len(held[f]) for f in held) / len(held) for t, *_ in thresholds}
    weak = {}
    for (f, i), ts in beats.items():
        weak.setdefault(i, []).append(sum(1 - hard[t] for t in ts) / len(thresholds))
    return {i: 1 - sum(w) / len(w) for i, w in weak.items()}


def test_cas_without_pairs(spark):
    rng = random.Random(4)
    h = [(f, i, rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for f in range(5) for i in rng.sample(range(12), 6)]
    t = [(f"t{k}", rng.choice([0, 1, 9, None]), rng.choice([None, 2.0, 3.0, 3.5, 9.0])) for k in range(15)]
    got = robust.cas(spark.createDataFrame(h, "fold int, int_seq int, score double"), spark.createDataFrame(t, "thr_seq string, own_fold int, score double"))
    assert {r.seq: round(r.cas, 9) for r in got.collect()} == {k: round(v, 9) for k, v in plain_cas(h, t).items()}


def test_small_blocks(spark, data, duck):
    tree, rows = views.tree(spark, data), views.leaf_rows(spark, data)
    clades = tree.filter("depth BETWEEN 1 AND 2").select(F.col("name").alias("clade"))
    got = holdout.holdout_scores(tree, rows, clades, leaves=16, per_block=3)
    same(got.withColumn("cas", F.round("cas", 6)), duck, ORACLE_SQL["holdout_scores"])


@pytest.fixture(scope="module")
def ladder(spark):
    """A tree (((a,b)X,c)Y,(d,e)Z)root with the rows of its leaves."""
    nodes = [("root", None, 0, False, 0, 8), ("Y", "root", 1, False, 1, 5), ("X", "Y", 2, False, 2, 4), ("a", "X", 3, True, 3, 3), ("b", "X", 3, True, 4, 4), ("c", "Y", 2, True, 5, 5), ("Z", "root", 1, False, 6, 8), ("d", "Z", 2, True, 7, 7), ("e", "Z", 2, True, 8, 8)]
    tree = spark.createDataFrame(nodes, "name string, parent string, depth int, is_leaf boolean, pre bigint, post bigint")
    return tree, spark.createDataFrame([("a", "AAAC-"), ("b", "AAAC"), ("c", "AAAD"), ("d", "WWWW"), ("e", None)], "seq_id string, aligned string")


def test_holdout_edges(spark, ladder):
    tree, rows = ladder
    clades = spark.createDataFrame([("Y",), ("Y",), ("a",), ("Z",), ("none",)], "clade string")
    found = sorted(tuple(r) for r in holdout.folds(tree, clades, 0.5).select("clade", "fold", "lo", "hi").collect())
    assert found == [("Y", "a", 0, 1), ("Y", "b", 1, 2), ("Y", "c", 2, 3), ("Z", "d", 3, 4), ("Z", "e", 4, 5)]
    left = {(r.fold, r.col, r.ch): r.left for r in holdout.holdout_counts(tree, rows, clades).filter("clade = 'Y'").collect()}
    assert left["c", 3, "C"] == 2 and left["c", 3, "D"] == 0 and left["a", 0, "A"] == 2
    got = {(r.clade, r.name): r for r in holdout.holdout_scores(tree, rows, clades).collect()}
    assert set(got) == {("Y", "a"), ("Y", "b"), ("Y", "c"), ("Z", "d"), ("Z", "e")}
    assert all(r.cas == 1.0 for k, r in got.items() if k[0] == "Y") and got["Z", "e"].n_losses == 0
    assert holdout.holdout_scores(tree, rows.limit(0), clades).filter("cas < 1").count() == 0
    assert holdout.holdout_scores(tree, rows, clades.limit(0)).count() == 0


def test_robust_clades_stop_below_a_pass(spark, ladder):
    tree, rows = ladder
    kept = tree.filter("NOT is_leaf AND depth > 0").select("name")
    got = holdout.robust_clades(tree, rows, kept)
    assert "Y" in {r.clade for r in got.collect()} and "X" not in {r.clade for r in got.collect()}
    none = holdout.robust_clades(tree, rows, kept, pass_score=1.1)
    assert none.count() == 0 and holdout.robust_clades(tree, rows, kept.limit(0)).count() == 0


def test_equal_rows_are_scored_once(spark, monkeypatch):
    """Copies of a leaf make one fold and one threshold; results are those of the definition, fold by fold."""
    texts = ["AAAC"] * 6 + ["AAAD", "AWAC"] + ["AAAC", "WWWW", "AAAC", "AADC"]
    n = len(texts)
    nodes = [("root", None, 0, False, 0, n + 2), ("Y", "root", 1, False, 1, 9), ("Z", "root", 1, False, 10, n + 2)]
    nodes += [(f"l{i}", "YZ"[i >= 8], 2, True, i + 2 + (i >= 8), i + 2 + (i >= 8)) for i in range(n)]
    tree = spark.createDataFrame(nodes, "name string, parent string, depth int, is_leaf boolean, pre bigint, post bigint")
    written, sizes = holdout.written, {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(holdout, "written", counted)
    rows = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(texts)], "seq_id string, aligned string")
    got = {r.name: (r.n_losses, round(r.cas, 9)) for r in holdout.holdout_scores(tree, rows, spark.createDataFrame([("Y",)], "clade string")).collect()}
    assert sizes["placed-folds"] == 3 and sizes["different-rows"] == 5

    def score(text, left):
        return sum(round(1000 * math.log((sum(x[c] == ch for x in left) + 0.05) / (len(left) + 1) * 20)) for c, ch in enumerate(text))

    beat = {i: [t for t in range(8, n) if score(texts[t], [x for k, x in enumerate(texts[:8]) if k != i]) > score(texts[i], [x for k, x in enumerate(texts[:8]) if k != i])] for i in range(8)}
    hard = {t: sum(t in b for b in beat.values()) / 8 for t in range(8, n)}
    assert got == {f"l{i}": (len(b), round(1 - sum(1 - hard[t] for t in b) / 4, 9)) for i, b in beat.items()}
    assert any(beat.values())


def test_equal_rows_are_one_wherever_they_lie(spark, monkeypatch):
    """Rows in many small parts, and folds in tiles, against the definition; copies far apart stay one row."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("ACD-", (9, 2, 1, 2), k=6)) for _ in range(24)] + ["".join(rng.choices("ACDW-", (6, 2, 2, 1, 1), k=6)) for _ in range(14)]
    texts[:24:5], texts[25::4] = ["AAAAAA"] * 5, ["AAAAAA"] * 4
    n = len(texts)
    nodes = [("root", None, 0, False, 0, n + 2), ("Y", "root", 1, False, 1, 25), ("Z", "root", 1, False, 26, n + 2)]
    nodes += [(f"l{i}", "YZ"[i >= 24], 2, True, i + 2 + (i >= 24), i + 2 + (i >= 24)) for i in range(n)]
    tree = spark.createDataFrame(nodes, "name string, parent string, depth int, is_leaf boolean, pre bigint, post bigint")
    written, sizes = holdout.written, {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(holdout, "written", counted)
    monkeypatch.setattr(holdout, "SPAN", 9)
    monkeypatch.setattr(holdout, "TILE", 4, raising=False)
    rows = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(texts)], "seq_id string, aligned string")
    got = {r.name: (r.n_losses, round(r.cas, 9)) for r in holdout.holdout_scores(tree, rows, spark.createDataFrame([("Y",)], "clade string")).collect()}
    cols = [c for c in range(6) if 2 * sum(t[c] != "-" for t in texts[:24]) >= 24]
    assert sizes["different-rows"] == len({t[: max(cols) + 1].rstrip("-") for t in texts} - {""})

    def score(text, left):
        count = {(c, ch): sum(x[c] == ch for x in left) for c in cols for ch in "ACDW"}
        return sum(round(1000 * math.log((count[c, text[c]] + 0.05) / (sum(count[c, ch] for ch in "ACDW") + 1) * 20)) for c in cols if text[c] != "-")

    scored = [any(t[c] != "-" for c in cols) for t in texts]
    beat = {}
    for i in range(24):
        left = [x for k, x in enumerate(texts[:24]) if k != i]
        beat[i] = [t for t in range(24, n) if scored[i] and scored[t] and score(texts[t], left) > score(texts[i], left)]
    hard = {t: sum(t in b for b in beat.values()) / 24 for t in range(24, n)}
    assert got == {f"l{i}": (len(b), round(1 - sum(1 - hard[t] for t in b) / 14, 9)) for i, b in beat.items()}
    assert any(beat.values())


@pytest.mark.parametrize("most", [1 << 16, 700])
def test_fold_losses_stay_small(spark, tmp_path, monkeypatch, most):
    """Thresholds in one part or several; files hold a pair in less than 3/4 byte, as pairs come in runs."""
    monkeypatch.setattr(robust, "THRESHOLDS", most, raising=False)
    rng = random.Random(8)
    h = [(rng.randrange(25), i, rng.choice([None, rng.random() * 9])) for i in range(2000)]
    t = [(i, rng.randrange(25), rng.choice([float("nan"), *[rng.random() * 9 for _ in range(20)]])) for i in range(3000)]
    got = robust.fold_losses(spark.createDataFrame(h, "fold int, int_seq bigint, score double"), spark.createDataFrame(t, "thr_seq bigint, own_fold bigint, score double"))
    got.coalesce(4).write.parquet(str(tmp_path / "out"))
    want = sum(f != g and (x > s or x != x) for f, _, s in h if s is not None for _, g, x in t)
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == spark.read.parquet(str(tmp_path / "out")).count() == want
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < want * 0.75
