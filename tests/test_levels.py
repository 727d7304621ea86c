"""Levels with replicates, and chain scores by residue."""

import random

import numpy as np
import pytest

from cladewise.operators import chains, clusters, levels


def families(seed, n, copies):
    """Sequences in families of families: each differs a little from its family's."""
    rng = random.Random(seed)
    out = []
    for f in range(n):
        base = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=120))
        for c in range(copies):
            s = list(base)
            for _ in range(rng.randrange(0, 12)):
                s[rng.randrange(len(s))] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
            out.append((f * 100 + c, "".join(s)))
    return out


def test_levels(spark):
    rows = families(1, 6, 7) + [(9001, None), (9002, "AC")]
    seqs = spark.createDataFrame(rows, "seq_id bigint, seq string")
    found = levels.cascade_levels(seqs, (0.9, 0.9), [(0.6, 0.8), (0.3, 0.5)], samples=3)
    ids = {i for i, _ in rows}
    c = {k: [(r.rep, r.member) for r in found.clusters.filter(f"level = {k}").collect()] for k in range(3)}
    assert {m for _, m in c[0]} == ids and len(c[0]) == len(ids)
    for k in (1, 2):
        reps = {r for r, _ in c[k - 1]}
        maps = [(r.rep_below, r.member, r.rep) for r in found.maps.filter(f"level = {k}").collect()]
        # One member of each cluster below stands for it, and is in one cluster here.
        assert sorted(b for b, *_ in maps) == sorted(reps) and sorted((r, m) for _, m, r in maps) == sorted(c[k])
        below = set(map(tuple, c[k - 1]))
        assert all((b, m) in below for b, m, _ in maps)
        assert {r for r, _ in c[k]} <= {m for _, m in c[k]}
    top = levels.expanded(found, 2).collect()
    assert sorted(r.member for r in top) == sorted(ids)
    fam = {}
    for r in top:
        fam.setdefault(r.rep, set()).add(r.member // 100)
    assert all(len(v) == 1 for v in fam.values()) and len(fam) < len({r for r, _ in c[0]})
    m = found.metrics.collect()
    assert {(r.level, r.sample) for r in m} == {(k, s) for k in (1, 2) for s in range(3)} and sum(r.best for r in m) == 2
    lines = [r.line.split("\t") for r in levels.report(found).collect()]
    assert len(lines) == 6 and sum(x[5] == "kept" for x in lines) == 2
    # One sample, the representatives as they are: each level is a plain clustering of the one before.
    one = levels.cascade_levels(seqs, (0.9, 0.9), [(0.3, 0.5)], samples=1)
    reps = seqs.join(one.clusters.filter("level = 0").selectExpr("rep AS seq_id").distinct(), "seq_id")
    want = sorted(map(tuple, clusters.greedy_cluster(reps, 0.3, 0.5).select("rep", "member").collect()))
    assert sorted(map(tuple, one.clusters.filter("level = 1").select("rep", "member").collect())) == want
    assert one.metrics.first().best


def test_pair_metrics_agree_with_comparison(spark):
    rng = random.Random(2)
    rows = [(s, u, rng.randrange(2 + s)) for s in range(3) for u in range(60)] + [(3, u, 0) for u in range(60)]
    labels = spark.createDataFrame(rows, "sample int, unit int, c int")
    got = {(r.a, r.b): (r.nmi, r.ari) for r in levels.pair_metrics(labels).collect()}
    for a, b in got:
        one, two = (labels.filter(f"sample = {s}").selectExpr("unit AS member", "c") for s in (a, b))
        r = clusters.comparison(one, two).first()
        assert got[a, b] == pytest.approx((r.nmi, r.ari), abs=1e-9)


def test_residue_scores(spark):
    emit = [("p", pos, aa, 1.0 if (pos, aa) in {(1, "A"), (2, "C"), (3, "D"), (4, "E")} else 4.0) for pos in range(1, 5) for aa in "ACDE"]
    e = spark.createDataFrame(emit, "profile string, pos int, aa string, nlp double")
    b = spark.createDataFrame([("p", a, 3.0) for a in "ACDE"], "profile string, aa string, nlp double")
    kind = "profile string, target string, chain_no int, ord bigint, score double, hmm_s int, env_s int, env_e int, a2m string"
    hits = [
        ("p", "t", 0, 1, 10.0, 1, 1, 5, "ACx-E"),  # three matches of 2 each: 10 / 3 a residue
        ("p", "t", 0, 2, 6.0, 3, 4, 5, "DE"),
        ("p", "t", 1, 3, 0.0, 1, 9, 9, "A"),
        ("p", "u", 0, 4, 5.0, 1, 1, 1, None),
        ("p", "v", 0, 5, 5.0, 1, 1, 2, "XA"),
    ]
    got = {(r.target, r.chain_no): r for r in chains.residue_scores(spark.createDataFrame(hits, kind), e, b).collect()}
    third, half = 10 / 3, 3.0
    # Profile places 1, 2, 4 and 3, 4; target places 1, 2, 4 and 4, 5.
    profile = third + third + (third + half) / 2 + half
    target = third + third + (third + half) / 2 + half
    assert got["t", 0].score == pytest.approx((profile + target) / 2) and (got["t", 0].span_s, got["t", 0].span_e) == (1, 5)
    assert got["t", 1].score == 0 and got["u", 0].score == 0
    assert got["v", 0].score == pytest.approx(5.0)


def test_residue_scores_move_hits_only(spark):
    """Residues are never shuffled, and groups of any size give the same chains."""
    kind = "profile string, target string, chain_no int, ord bigint, score double, hmm_s int, env_s int, env_e int, a2m string"
    hits = [(p, f"t{k % 5}", k % 2, k, 1.0 + k, 1 + k % 4, 2 + k % 3, 9 + k, "ACx-EAC"[k % 3 :]) for p in ("p", "q", "r") for k in range(20)] + [("p", "u", 0, 99, 3.0, 1, 1, 4, None)]
    e = spark.createDataFrame([(p, i, a, 0.5 + i * 0.25 + ord(a) * 0.01) for p in ("p", "q") for i in range(1, 9) for a in "ACE"], "profile string, pos int, aa string, nlp double")
    b = spark.createDataFrame([(p, a, 3.0) for p in ("p", "q") for a in "ACE"], "profile string, aa string, nlp double")
    h = spark.createDataFrame(hits, kind)
    whole = chains.residue_scores(h, e, b)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "target_pos" not in plan and "explode(array" not in plan
    got, parts = (sorted((r.profile, r.target, r.chain_no, r.span_s, r.span_e, round(r.score, 9)) for r in df.collect()) for df in (whole, chains.residue_scores(h, e, b, group_bytes=100)))
    assert got == parts and len(got) == 31 and all(r[5] == 0 for r in got if r[0] == "r" or r[1] == "u") and any(r[5] > 0 for r in got)


def test_common_words_are_not_counted(monkeypatch):
    """Heads that fit are those of the definition, though words that most heads have are looked up for few of them."""
    rng = np.random.default_rng(9)
    common, sets = np.arange(100), []
    for i in range(300):
        own = 1000 + 200 * (i % 40) + rng.choice(200, 90, replace=False)
        sets.append(np.unique(np.concatenate([rng.choice(common, 80, replace=False), own])))
    lens = np.array([400 - i // 2 for i in range(300)])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    heads, counted, bincount = clusters._Heads(lens, starts, np.concatenate(sets)), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: counted.append(len(x)) or bincount(x, *a, **k))
    for identity, coverage in ((0.5, 0.6), (0.7, 0.9), (0.0, 0.0), (1.0, 0.5)):
        counted.clear()
        upto = np.arange(300)
        got = heads.within(lens, starts, np.concatenate(sets), upto, identity, coverage)
        for i, x in enumerate(got):
            want = [c for c in range(i) if lens[i] >= lens[c] * coverage and (n := len(np.intersect1d(sets[c], sets[i]))) and n >= len(sets[i]) * identity]
            assert (np.flatnonzero(x) if x.dtype == bool else x).tolist() == want
        if identity > 0.6:
            assert sum(counted) < 300 * 150 * 20, sum(counted)
