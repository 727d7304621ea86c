"""Rooting on the node table: path reversal, longest paths, and numbering by list ranking.

A new root turns the pointers on the path from its branch to the old root; all other
nodes keep their parent. Places in preorder are then found anew from the parent
pointers alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.operators.ranges import running
from cladewise.operators.trees import lca, patristic, root_distance
from cladewise.session import written


def numbered(nodes: DataFrame) -> DataFrame:
    """Node table of a tree given by parents: nodes has name, parent, ord (place among
    siblings; ties by name), support, dist.

    The walk around the tree enters and leaves each node with children once; each of these
    steps knows the next one and the leaves between. Steps are ranked by pointer doubling: a
    round joins each step with the one it points at and adds up what lies between, so rounds
    are as many as the walk's length has binary digits, whatever the depth. Leaves are then
    placed after their parent, or their last elder sibling with children.
    """
    above = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("_h")).distinct()
    flagged = nodes.join(above, F.col("name") == F.col("_h"), "left")
    flagged = flagged.select("name", "parent", F.struct("ord", "name").alias("o"), F.lit(1).alias("one"), (F.col("_h").isNotNull() | F.col("parent").isNull()).cast("int").alias("inner"))
    kids = written(running(flagged, ["parent"], "o", {"nth": "one", "inth": "inner"}).select("name", "parent", "inner", "nth", "inth"), "siblings")
    counts = kids.groupBy(F.col("parent").alias("_c")).agg(F.max("nth").alias("kids"))
    inner = written(kids.filter("inner = 1").join(counts, F.col("name") == F.col("_c"), "left").select("name", "parent", "nth", "inth", F.coalesce("kids", F.lit(0)).alias("kids")), "inner-nodes")
    first = inner.filter("inth = 1").select(F.col("parent").alias("_p"), F.col("name").alias("first"), F.col("nth").alias("first_nth"))
    after = inner.select(F.col("parent").alias("_q"), (F.col("inth") - 1).alias("_n"), F.col("name").alias("next"), F.col("nth").alias("next_nth"))
    up = inner.select(F.col("name").alias("_u"), F.col("kids").alias("up_kids"))
    j = inner.join(first, F.col("name") == F.col("_p"), "left").join(after, (F.col("parent") == F.col("_q")) & (F.col("inth") == F.col("_n")), "left").join(up, F.col("parent") == F.col("_u"), "left")
    mark = lambda side, c: F.concat(F.lit(side), F.col(c))
    # A step counts what is entered with it: its node, and the leaves before the next step.
    down, on = 1 + F.coalesce(F.col("first_nth") - 1, "kids"), F.coalesce(F.col("next_nth") - F.col("nth") - 1, F.col("up_kids") - F.col("nth"), F.lit(0))
    enter = F.struct(mark("+", "name").alias("step"), F.coalesce(mark("+", "first"), mark("-", "name")).alias("to"), down.cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d"))
    leave = F.struct(mark("-", "name").alias("step"), F.coalesce(mark("+", "next"), mark("-", "parent")).alias("to"), on.cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("d"))
    walk = written(j.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*"), "walk")
    while not walk.filter("to IS NOT NULL").isEmpty():
        then = walk.select(F.col("step").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("d").alias("_d"))
        moved = walk.filter("to IS NOT NULL").join(then, "to").select("step", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"), (F.col("d") + F.col("_d")).alias("d"))
        walk = written(walk.filter("to IS NULL").unionByName(moved), "walk")
    # Entries from a step to the end; steps down less steps up from there.
    at = walk.select(F.substring("step", 1, 1).alias("side"), F.expr("substring(step, 2)").alias("name"), "n", "d")
    at = at.groupBy("name").agg(F.max(F.when(F.col("side") == "+", F.col("n"))).alias("n"), F.max(F.when(F.col("side") == "-", F.col("n"))).alias("rest"), F.max(F.when(F.col("side") == "+", -F.col("d"))).alias("depth"))
    total = at.agg(F.max("n").alias("total"))
    pre = F.col("total") - F.col("n")
    got = at.crossJoin(F.broadcast(total)).select("name", F.col("depth").cast("int").alias("depth"), (F.col("n") - F.col("rest") == 1).alias("is_leaf"), pre.alias("pre"), (F.col("total") - F.col("rest") - 1).alias("post"))
    got = written(got.join(inner.select("name", "parent", "nth", "inth"), "name"), "inner-places")
    over = got.select(F.col("name").alias("parent"), F.col("pre").alias("_pre"), (F.col("depth") + 1).alias("depth"))
    elder = got.select(F.col("parent").alias("_q"), F.col("inth").alias("_i"), (F.col("post") - F.col("nth")).alias("_post"))
    leaves = kids.filter("inner = 0").join(over, "parent").join(elder, (F.col("parent") == F.col("_q")) & (F.col("inth") == F.col("_i")), "left")
    place = F.coalesce("_post", "_pre") + F.col("nth")
    got = got.select("name", "depth", "is_leaf", "pre", "post").unionByName(leaves.select("name", "depth", F.lit(True).alias("is_leaf"), place.alias("pre"), place.alias("post")))
    return nodes.select("name", "parent", "support", "dist").join(got, "name").select("name", "parent", "depth", "support", "dist", "is_leaf", "pre", "post")


def root_on_branch(tree: DataFrame, below: str, at: float | None = None, root: str = "rooted") -> DataFrame:
    """The tree with a new root (by that name) on the branch above a node, ``at`` from the node (default: the middle).

    Supports stay with their branches. An old root that is left with one child is
    passed over. A tree rooted on its root is returned as it is.
    """
    b = tree.filter(F.col("name") == below).first()
    if b is None:
        raise ValueError(f"no node {below}")
    if b.parent is None:
        return tree
    half = b.dist / 2 if at is None else float(at)
    # The path up, each node with the one below it on the path.
    path = written(tree.filter((F.col("pre") <= b.pre) & (F.col("post") >= b.post)).select("name", "parent", "depth", "support", "dist"), "path")
    under = path.select((F.col("depth") - 1).alias("depth"), F.col("name").alias("child"), F.col("support").alias("s"), F.col("dist").alias("d"))
    turned = path.filter(F.col("name") != below).join(under, "depth")
    last = F.col("child") == below
    turned = written(turned.select("name", F.when(last, root).otherwise(F.col("child")).alias("parent"), F.col("s").alias("support"), F.when(last, F.lit(b.dist - half)).otherwise(F.col("d")).alias("dist"), "depth"), "turned")
    rest = tree.join(path.select("name"), "name", "left_anti").select("name", "parent", "support", "dist", F.col("pre").alias("ord"))
    order = tree.select("name", F.col("pre").alias("ord"))
    new = turned.join(order, "name").select("name", "parent", "support", "dist", "ord")
    top = turned.filter("depth = 0").first()
    others = rest.filter(F.col("parent") == top.name)
    if others.limit(2).count() < 2:
        joined = others.select("name", F.lit(top.parent).alias("parent"), "support", (F.col("dist") + top.dist).alias("dist"), "ord")
        rest = rest.filter(F.col("parent") != top.name).unionByName(joined)
        new = new.filter(F.col("name") != top.name)
    kinds = {f.name: f.dataType for f in tree.schema.fields}
    ends = tree.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(root).alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast(kinds["support"]).alias("support"), F.lit(0.0).alias("dist"), F.lit(-1).cast("bigint").alias("ord")), F.struct(F.lit(below).alias("name"), F.lit(root).alias("parent"), F.lit(b.support).cast(kinds["support"]).alias("support"), F.lit(half).alias("dist"), F.lit(b.pre).cast("bigint").alias("ord")))).alias("e")).select("e.*")
    return written(numbered(written(rest.unionByName(new).unionByName(ends), "turned-tree")), "rooted")


def outgroup_root(tree: DataFrame, nodes: list[str], inside: str | None = None, root: str = "rooted") -> DataFrame:
    """Root on the branch above the lowest common ancestor of the outgroup's nodes.

    inside: a node that must not be in the outgroup; the tree is rooted on it first,
    so that the outgroup is one clade whatever the old root."""
    spark = tree.sparkSession
    if inside is not None:
        tree = root_on_branch(tree, inside, root=f"{root}-first")
    found = lca(tree, spark.createDataFrame([("out", n) for n in nodes], "set_id string, node string")).first()
    if found is None:
        raise ValueError("no outgroup node is in the tree")
    return root_on_branch(tree, found.lca, root=root)


def longest_branch_root(tree: DataFrame, root: str = "rooted") -> DataFrame:
    """Root in the middle of the longest branch above an inner node (the first in preorder on ties)."""
    long = tree.filter("NOT is_leaf AND parent IS NOT NULL").agg(F.max_by("name", F.struct("dist", -F.col("pre"))).alias("name")).first()
    return tree if long.name is None else root_on_branch(tree, long.name, root=root)


def midpoint_root(tree: DataFrame, root: str = "rooted") -> DataFrame:
    """Root in the middle of the longest path between two leaves.

    Two sweeps find its ends: the leaf farthest from any one, and the farthest from
    that. The middle is on the side of the end that is farther from where the path turns.
    """
    start = tree.filter("is_leaf").agg(F.min_by("name", "pre").alias("name")).first().name
    if start is None:
        return tree
    far = lambda n: patristic(tree, n).agg(F.max_by(F.struct("leaf", "distance"), F.struct("distance", "leaf")).alias("b")).first().b
    one = far(start).leaf
    two = far(one)
    if not two.distance > 0:
        return tree
    half = two.distance / 2
    depths = written(tree.join(root_distance(tree), F.col("name") == F.col("node")).select("name", "parent", "pre", "post", "dist", "root_dist"), "root-distances")
    ends = sorted((depths.filter(F.col("name") == n).first() for n in (one, two.leaf)), key=lambda r: -r.root_dist)
    # The branch above the farther end's ancestor on which the half is passed.
    e = ends[0]
    up = depths.filter((F.col("pre") <= e.pre) & (F.col("post") >= e.post) & F.col("parent").isNotNull()).withColumn("gone", F.lit(e.root_dist) - F.col("root_dist"))
    hit = up.filter((F.col("gone") <= half) & (F.col("gone") + F.col("dist") >= half)).agg(F.max_by(F.struct("name", "gone"), "gone").alias("b")).first().b
    return tree if hit is None else root_on_branch(tree, hit.name, half - hit.gone, root)
