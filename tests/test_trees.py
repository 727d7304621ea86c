"""Tree questions and rooting on node tables against plain versions on random trees and a ladder."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import rooting, trees

KIND = "name string, parent string, depth int, support double, dist double, is_leaf boolean, pre bigint, post bigint"


def random_tree(seed, n_leaves):
    """Rows (name, parent, dist, support) in preorder, with many children, chains and zero lengths."""
    rng = random.Random(seed)
    kids, todo, count = {"n0": []}, ["n0"], 1
    while sum(not k for k in kids.values()) < n_leaves:
        at = rng.choice(todo)
        for _ in range(rng.choice([1, 2, 2, 3]) if at != "n0" else rng.choice([2, 3])):
            name = f"n{count}"
            count += 1
            kids[at].append(name)
            kids[name] = []
            todo.append(name)
        todo.remove(at)
    rows, stack = [], [("n0", None)]
    while stack:
        n, p = stack.pop()
        rows.append((n, p, rng.choice([0.0, 0.5, 1.0, 2.25, 3.0]) if p else 0.0, float(rng.randrange(101)) if kids[n] else 0.0))
        stack += [(k, n) for k in reversed(kids[n])]
    return rows


def table(spark, rows):
    kids, depth, last = {}, {}, {}
    for i, (n, p, *_) in enumerate(rows):
        depth[n] = depth[p] + 1 if p else 0
        kids.setdefault(p, []).append(n)
        last[n] = i
    for n, p, *_ in reversed(rows):
        if p:
            last[p] = max(last[p], last[n])
    return spark.createDataFrame([(n, p, depth[n], s, d, n not in kids, i, last[n]) for i, (n, p, d, s) in enumerate(rows)], KIND)


class Plain:
    def __init__(self, rows):
        self.up = {n: p for n, p, *_ in rows}
        self.dist = {n: d for n, _, d, _ in rows}
        self.order = {n: i for i, (n, *_) in enumerate(rows)}
        self.leaves = [n for n in self.up if n not in set(self.up.values())]

    def path(self, n):
        out = []
        while n is not None:
            out.append(n)
            n = self.up[n]
        return out

    def lca(self, names):
        common = set.intersection(*(set(self.path(n)) for n in names))
        return next(n for n in self.path(next(iter(names))) if n in common)

    def under(self, n):
        return [x for x in self.leaves if n in self.path(x)]

    def far(self, a, b):
        m = self.lca({a, b})
        return sum(self.dist[x] for n in (a, b) for x in itertools.takewhile(lambda y: y != m, self.path(n)))


@pytest.mark.parametrize("seed", [1, 2])
def test_questions(spark, seed):
    rows = random_tree(seed, 25)
    t, p = table(spark, rows), Plain(rows)
    rng = random.Random(seed)
    sets = {f"s{i}": set(rng.choices(list(p.up), k=rng.choice([1, 2, 2, 3, 6]))) for i in range(40)}
    got = trees.lca(t, spark.createDataFrame([(k, n) for k, v in sets.items() for n in v], "set_id string, node string"))
    assert {r.set_id: r.lca for r in got.collect()} == {k: p.lca(v) for k, v in sets.items()}
    assert {r.node: round(r.root_dist, 9) for r in trees.root_distance(t).collect()} == {n: sum(p.dist[x] for x in p.path(n)) for n in p.up}
    target = rng.choice([n for n in p.up if len(p.path(n)) > 2])
    assert {r.leaf: round(r.distance, 9) for r in trees.patristic(t, target).collect()} == {x: p.far(target, x) for x in p.leaves}
    steps = {x: p.path(target).index(p.lca({target, x})) for x in p.leaves if target not in p.path(x)}
    assert {r.leaf: r.level for r in trees.cousin_sets(t, target).collect()} == steps
    kept = rng.sample([n for n in p.up if n not in p.leaves], 6)
    k = spark.createDataFrame([(n,) for n in kept], "name string")
    near = lambda n: next((x for x in p.path(n)[1:] if x in kept), None)
    assert {r.name: r.kept_parent for r in trees.nearest_kept_ancestor(t, k).collect()} == {n: near(n) for n in kept}
    top = {x: [n for n in p.path(x) if n in kept][-1] for x in p.leaves if set(p.path(x)) & set(kept)}
    assert {r.leaf: r.clade for r in trees.clade_labels(t, k, top_only=True).collect()} == top
    assert sorted((r.leaf, r.clade) for r in trees.clade_labels(t, k).collect()) == sorted((x, n) for x in p.leaves for n in p.path(x) if n in kept)
    made = {r.node: (r.left, r.right) for r in trees.boundaries(t).collect()}
    kids = {n: [c for c in p.up if p.up[c] == n] for n in p.up}
    first = lambda n: min(p.under(n), key=p.order.get)
    assert made == {n: (first(min(c, key=p.order.get)), first(max(c, key=p.order.get))) for n, c in kids.items() if c}
    alone = {r.node for r in trees.boundaries(t, singletons=True).collect()} - set(made)
    sister = lambda x: next((c for c in sorted(kids[p.up[x]], key=p.order.get) if c != x), None)
    assert alone == {x for x in p.leaves if sister(x) and kids[sister(x)]}
    # A name, its boundaries and the name again.
    forks = [n for n, c in kids.items() if len(c) > 1]
    b = trees.boundaries(t).filter(F.col("node").isin(forks)).select(F.col("node").alias("clade"), F.lit(0).alias("ord"), "left", "right", F.lit(None).cast("string").alias("out"))
    for n in rng.sample(forks, 3):
        assert {r.leaf for r in trees.named_clades(t, b.filter(F.col("clade") == n)).collect()} == set(p.under(n))


def test_named_clades_seen_from_outside(spark):
    rows = random_tree(5, 25)
    t, p = table(spark, rows), Plain(rows)
    rng = random.Random(6)
    bounds = [(f"c{i}", i, *rng.sample(p.leaves, 3)) for i in range(25)]
    want = {}
    for c, _, a, b, out in bounds:
        # Rooted at out, the clade holds the leaves whose path to out meets the path between its bounds.
        for x in p.leaves:
            if x != out and set(between(p, a, b)) & set(between(p, out, x)):
                want[x] = c
    got = trees.named_clades(t, spark.createDataFrame(bounds, "clade string, ord int, left string, right string, out string"))
    assert {r.leaf: r.clade for r in got.collect()} == want


def between(p, a, b):
    """Nodes on the path from a to b."""
    m = p.lca({a, b})
    up, down = p.path(a), p.path(b)
    return up[: up.index(m) + 1] + down[: down.index(m)][::-1]


def checked(spark, made, p):
    """A re-rooted table has the leaves' distances, and sound places."""
    r = made.collect()
    q = Plain([(x.name, x.parent, x.dist, x.support) for x in sorted(r, key=lambda x: x.pre)])
    assert sorted(q.leaves) == sorted(p.leaves) and [x.pre for x in sorted(r, key=lambda x: x.pre)] == list(range(len(r)))
    for a, b in itertools.combinations(p.leaves, 2):
        assert q.far(a, b) == pytest.approx(p.far(a, b))
    for x in r:
        assert x.depth == len(q.path(x.name)) - 1 and x.is_leaf == (x.name in q.leaves)
        inside = [y.pre for y in r if x.name in q.path(y.name)]
        assert (x.pre, x.post) == (min(inside), max(inside)) and len(inside) == x.post - x.pre + 1
    return q


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rooting(spark, seed):
    rows = random_tree(seed, 12)
    t, p = table(spark, rows), Plain(rows)
    rng = random.Random(seed)
    below = rng.choice([n for n in p.up if p.up[n]])
    q = checked(spark, rooting.root_on_branch(t, below, 0.0), p)
    assert q.up["rooted"] is None and q.up[below] == "rooted" and q.dist[below] == 0
    out = rng.sample(p.leaves, 2)
    inside = next(x for x in p.leaves if x not in out)
    q = checked(spark, rooting.outgroup_root(t, out, inside), p)
    assert any(set(out) <= set(q.under(c)) and inside not in q.under(c) for c in q.up if q.up[c] == "rooted")
    mid = rooting.midpoint_root(t)
    q = checked(spark, mid, p)
    longest = max(p.far(a, b) for a, b in itertools.combinations(p.leaves, 2))
    assert max(sum(q.dist[x] for x in q.path(n)) for n in q.leaves) == pytest.approx(longest / 2)
    q = checked(spark, rooting.longest_branch_root(t), p)
    inner = [n for n in p.up if p.up[n] and n not in p.leaves]
    ends = [q.dist[c] for c in q.up if q.up[c] == "rooted"]
    # Where the old root is passed over, its other branch is added to one end.
    assert min(ends) == max(p.dist[n] for n in inner) / 2
    back = trees.transfer_supports(t, mid.withColumn("support", F.lit(None).cast("double")))
    old = {frozenset(p.under(n)): s for n, _, _, s in rows if n not in p.leaves}
    mine = Plain([(x.name, x.parent, x.dist, x.support) for x in mid.collect()])
    for x in back.filter("NOT is_leaf").collect():
        side = frozenset(mine.under(x.name))
        found = [s for c, s in old.items() if 0 < len(side) < len(p.leaves) and c in (side, frozenset(p.leaves) - side)]
        # Chains of one child have one split; the highest support of them counts.
        assert x.support is None if not found else x.support >= max(found)


def test_rooted_already(spark):
    rows = random_tree(4, 6)
    t = table(spark, rows)
    assert rooting.root_on_branch(t, "n0") is t
    with pytest.raises(ValueError):
        rooting.root_on_branch(t, "none")
    one = table(spark, [("a", None, 0.0, 0.0)])
    assert rooting.midpoint_root(one) is one and rooting.longest_branch_root(one) is one
    assert [tuple(r) for r in rooting.numbered(one.select("name", "parent", F.col("pre").alias("ord"), "support", "dist")).select("name", "depth", "pre", "post").collect()] == [("a", 0, 0, 0)]


def test_ladder(spark):
    """A tree as deep as it has leaves: no question goes level by level."""
    n = 10_000
    rows = [("i0", None, 0.0, 0.0)]
    for k in range(n):
        rows += [(f"l{k}", f"i{k}", 1.0, 0.0), (f"i{k + 1}", f"i{k}", 1.0, 9.0)]
    t = spark.createDataFrame([(name, parent, (len(name) and (int(name[1:]) + (name[0] == "l"))), s, d, name[0] == "l" or name == f"i{n}", i, i if name[0] == "l" else 2 * n) for i, (name, parent, d, s) in enumerate(rows)], KIND).repartition(4)
    sets = spark.createDataFrame([(f"s{a}", f"l{x}") for a in range(0, n, 500) for x in (a, n - 1)], "set_id string, node string")
    assert all(r.lca == f"i{r.set_id[1:]}" for r in trees.lca(t, sets).collect())
    assert trees.root_distance(t).filter("node = 'l9999'").first().root_dist == 10_000
    assert trees.cousin_sets(t, f"l{n - 1}").filter("leaf = 'l0'").first().level == n
    kept = t.filter("NOT is_leaf AND depth % 5 = 0").select("name")
    assert trees.nearest_kept_ancestor(t, kept).filter("kept_parent IS NOT NULL").count() == n // 5 - 1
    assert trees.leaf_counts(t).filter("name = 'i5000'").first().leaves == n // 2 + 1
    again = rooting.numbered(t.select("name", "parent", F.col("pre").alias("ord"), "support", "dist"))
    assert again.join(t.select("name", F.col("pre").alias("p"), F.col("post").alias("q"), F.col("depth").alias("dd")), "name").filter("pre <> p OR post <> q OR depth <> dd").count() == 0


def test_labels_and_supports(spark):
    def facts(rows):
        t = spark.createDataFrame([(n, s, leaf) for n, s, leaf in rows], "name string, support double, is_leaf boolean")
        return tuple(trees.label_facts(t).first())

    assert facts([("a", None, True), (None, 0.5, False)]) == (False, False, False)
    assert facts([("0.9", None, False), ("1.0", None, False)]) == (True, True, False)
    assert facts([("95", None, False), ("", None, False)]) == (True, True, True)
    assert facts([("N1", 80.0, False), ("3", None, False)]) == (True, False, True)
    assert facts([]) == (False, False, False)
    share = table(spark, [("r", None, 0.0, 0.0), ("x", "r", 1.0, 0.5), ("a", "x", 1.0, 0.0), ("b", "x", 1.0, 0.0), ("c", "r", 1.0, 0.0)])
    assert {r.name: r.support for r in trees.percent_supports(share).collect()}["x"] == 50.0
    assert {r.name: r.support for r in trees.percent_supports(share.withColumn("support", F.col("support") * 100)).collect()}["x"] == 50.0


def test_contained_never_broadcasts_points(spark, monkeypatch):
    """Points are repeated for each size of block: only blocks of intervals may go through the driver."""
    from cladewise.operators import intervals
    from cladewise.session import written

    points = written(spark.range(200).select(F.col("id").alias("at")), "points")
    spans = written(spark.createDataFrame([(f"a long name {i}", i, 3 * i) for i in range(60)], "name string, lo bigint, hi bigint"), "spans")
    want = sorted((p, f"a long name {i}") for i in range(60) for p in range(i, 3 * i + 1))
    for few in (1 << 16, 20, 0):
        monkeypatch.setattr(intervals, "FEW", few)
        got = intervals.contained(points, "at", spans, "lo", "hi")
        assert sorted((r.at, r.name) for r in got.select("at", "name").collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("SortMergeJoin" in plan) == (few < 1 << 16)


def test_leaves_take_no_rounds(spark, monkeypatch):
    """Rounds of numbering go by the nodes with children, not by their leaves."""
    names = []
    monkeypatch.setattr(rooting, "written", lambda df, name, f=rooting.written: names.append(name) or f(df, name))
    rows = [("r", None, 0, 0.0, 0.0)] + [(f"l{k:03}", "r" if k % 3 else "m", k, 0.0, 1.0) for k in range(300)] + [("m", "r", 150, 1.0, 1.0)]
    got = {r.name: (r.depth, r.is_leaf, r.pre, r.post) for r in rooting.numbered(spark.createDataFrame(rows, "name string, parent string, ord int, support double, dist double")).collect()}
    assert names.count("walk") <= 4
    order = ["r", *(f"l{k:03}" for k in range(150) if k % 3), "m", *(f"l{k:03}" for k in range(0, 300, 3))]
    # Equal places go by name: l150 is m's, so m is alone at its place.
    order += [f"l{k:03}" for k in range(150, 300) if k % 3]
    ends = {"r": len(order) - 1, "m": order.index("m") + 100}
    assert got == {n: (0 if n == "r" else 1 + (n not in ("r", "m") and int(n[1:]) % 3 == 0), n not in ("r", "m"), i, ends.get(n, i)) for i, n in enumerate(order)}
