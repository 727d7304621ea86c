"""Trees as node tables in nested-set form, and the questions asked of them.

tree: name, parent, depth, support, dist, is_leaf, pre, post. The descendants of
a node are the nodes with pre between its pre and post, so questions are interval
joins and running sums over places, whatever the depth. rooting.py changes roots.
Newick texts are read one text at a time, many of them in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.operators.intervals import blocks, contained, leaf_ranges
from cladewise.operators.ranges import running
from cladewise.session import written


def nested_set(nodes: DataFrame, leaf_depth: int) -> DataFrame:
    """Number nodes that have a path of keys (-1 above their own level) in preorder.

    A node's place is its parent's, one, and the sizes of its elder siblings'
    subtrees: counts by path prefix, running sums among siblings, and one join
    for each level, so no task sees the whole tree.
    """
    sizes = None
    for d in range(leaf_depth + 1):
        key = F.slice("path", 1, d) if d else F.array().cast("array<int>")
        part = nodes.filter(F.col("depth") >= d).groupBy(key.alias("key")).agg(F.count("*").alias("size")).withColumn("depth", F.lit(d))
        sizes = part if sizes is None else sizes.union(part)
    sized = nodes.withColumn("key", F.slice("path", 1, F.col("depth"))).join(sizes, ["key", "depth"])
    elder = W.partitionBy("parent").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    sized = sized.withColumn("elder", F.coalesce(F.sum("size").over(elder), F.lit(0)))
    rest = ["name", "parent", "depth", "support", "dist"]
    level = sized.filter("depth = 0").select(*rest, F.col("elder").alias("pre"), "size")
    out = level
    for d in range(1, leaf_depth + 1):
        up = level.select(F.col("name").alias("parent"), F.col("pre").alias("above"))
        level = sized.filter(F.col("depth") == d).join(up, "parent").select(*rest, (F.col("above") + 1 + F.col("elder")).alias("pre"), "size")
        out = out.union(level)
    return out.select(*rest, (F.col("depth") == leaf_depth).alias("is_leaf"), F.col("pre").cast("bigint"), (F.col("pre") + F.col("size") - 1).cast("bigint").alias("post"))


def clade_leaves(tree: DataFrame) -> DataFrame:
    """(node, leaf) for every internal node, by containment of the leaf's place. All pairs by definition."""
    inner = tree.filter("NOT is_leaf").select(F.col("name").alias("node"), "pre", "post")
    return contained(tree.filter("is_leaf").select(F.col("name").alias("leaf"), F.col("pre").alias("at")), "at", inner, "pre", "post").select("node", "leaf")


def leaf_counts(tree: DataFrame) -> DataFrame:
    """Leaves under each node: name, leaves."""
    return leaf_ranges(tree).select("name", (F.col("hi") - F.col("lo")).alias("leaves"))


def separators(tree: DataFrame) -> DataFrame:
    """at, node, depth: the lowest common ancestor of each leaf (by rank: at) and the next one.

    It is the parent of the highest node whose leaves begin with the next one.
    """
    nodes = tree.join(leaf_ranges(tree), "name").filter("parent IS NOT NULL AND lo > 0")
    return nodes.groupBy(F.col("lo").alias("_lo")).agg(F.min_by(F.struct(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")), "depth").alias("b")).select((F.col("_lo") - 1).alias("at"), "b.node", "b.depth")


def lca(tree: DataFrame, sets: DataFrame) -> DataFrame:
    """Lowest common ancestor of each named set of nodes (set_id, node).

    If the first node of a set in preorder holds all others, it is that one. Else it
    is the highest of the separators between the set's leaves: their range is cut in
    aligned blocks, whose highest separators are joined by equality.
    """
    ranged = written(tree.select("name", "pre", "post").join(leaf_ranges(tree), "name"), "leaf-ranges")
    j = sets.join(ranged, F.col("node") == F.col("name"))
    ends = written(j.groupBy("set_id").agg(F.min_by(F.struct("name", "post"), "pre").alias("f"), F.max("pre").alias("last"), F.min("lo").alias("lo"), (F.max("hi") - 2).alias("to")), "set-ends")
    top = ends.filter("f.post >= last").select("set_id", F.col("f.name").alias("lca"))
    part = ends.filter("f.post < last").select("set_id", F.explode(blocks("lo", "to")).alias("b")).select("set_id", "b.size", "b.at")
    sizes = [r[0] for r in part.select("size").distinct().collect()]
    if not sizes:
        return top
    highest = separators(tree).select("node", "depth", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("size"), "at").groupBy("size", F.expr("shiftright(at, size)").alias("at"))
    highest = highest.agg(F.min_by(F.struct("depth", "node"), "depth").alias("h"))
    met = part.join(highest, ["size", "at"]).groupBy("set_id").agg(F.min_by("h.node", "h.depth").alias("lca"))
    return top.unionByName(met)


def shells(tree: DataFrame, node: str) -> DataFrame:
    """anc, level, lo, hi: for each node above a given one (level 0: itself) the places it holds that the one below does not."""
    me = tree.filter(F.col("name") == node).select(F.col("pre").alias("p"), F.col("post").alias("q"), F.col("depth").alias("d"))
    # One row of bounds; the rows kept are the node's ancestors.
    anc = tree.crossJoin(F.broadcast(me)).filter("pre <= p AND post >= q").select(F.col("name").alias("anc"), "pre", "post", (F.col("d") - F.col("depth")).alias("level"))
    anc = written(anc, "ancestors")
    inner = anc.select((F.col("level") + 1).alias("level"), F.col("pre").alias("p"), F.col("post").alias("q"))
    rest = anc.join(inner, "level").select("anc", "level", F.explode(F.array(F.struct(F.col("pre").alias("lo"), (F.col("p") - 1).alias("hi")), F.struct((F.col("q") + 1).alias("lo"), F.col("post").alias("hi")))).alias("s"))
    own = anc.filter("level = 0").select("anc", "level", F.struct(F.col("pre").alias("lo"), F.col("post").alias("hi")).alias("s"))
    return own.unionByName(rest).select("anc", "level", "s.lo", "s.hi")


def cousin_sets(tree: DataFrame, target: str) -> DataFrame:
    """Leaves outside the target clade by how many steps above it they first appear (level 1 is nearest)."""
    leaf = tree.filter("is_leaf").select(F.col("name").alias("leaf"), "pre")
    return contained(leaf, "pre", shells(tree, target).filter("level > 0"), "lo", "hi").select("leaf", "level")


def supported_partition(tree: DataFrame, min_support: float, min_prop: float = 0.0, max_prop: float = 1.0) -> DataFrame:
    """Internal nodes with enough support and a share of leaves inside the bounds."""
    counts = leaf_counts(tree)
    total = tree.filter("is_leaf").agg(F.count("*").alias("total"))
    j = tree.filter("NOT is_leaf AND depth > 0").join(counts, "name").crossJoin(F.broadcast(total))
    prop = F.col("leaves") / F.col("total")
    return j.filter((F.col("support") >= min_support) & (prop >= min_prop) & (prop <= max_prop)).select("name", "depth", "support", "leaves", prop.alias("prop"))


def nearest_kept_ancestor(tree: DataFrame, kept: DataFrame) -> DataFrame:
    """Each kept node and the nearest kept node above it (null: none).

    Every node points at its parent; a pointer at a node that is not kept is moved
    on to where that one points, so each round doubles its reach.
    """
    k = kept.select(F.col("name").alias("_k")).distinct()
    state = written(tree.select("name", F.col("parent").alias("at")).join(k, F.col("at") == F.col("_k"), "left").select("name", "at", (F.col("at").isNull() | F.col("_k").isNotNull()).alias("done")), "pointers")
    while not state.filter("NOT done").isEmpty():
        other = state.select(F.col("name").alias("at"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        moved = state.filter("NOT done").join(other, "at").select("name", F.col("_at").alias("at"), F.col("_done").alias("done"))
        state = written(state.filter("done").unionByName(moved), "pointers")
    return state.join(k, F.col("name") == F.col("_k"), "left_semi").select("name", F.col("at").alias("kept_parent"))


def clade_labels(tree: DataFrame, kept: DataFrame, top_only: bool = False) -> DataFrame:
    """(leaf, clade) for every kept clade, or the largest one only."""
    if top_only:
        kept = nearest_kept_ancestor(tree, kept).filter("kept_parent IS NULL").select("name")
    spans = tree.join(kept.select("name").distinct(), "name", "left_semi").filter("NOT is_leaf").select(F.col("name").alias("clade"), F.col("pre").alias("lo"), "post")
    return contained(tree.filter("is_leaf").select(F.col("name").alias("leaf"), "pre"), "pre", spans, "lo", "post").select("leaf", "clade")


def root_distance(tree: DataFrame) -> DataFrame:
    """Sum of branch lengths from the root to each node: node, root_dist.

    A branch counts from its node's place to the last one under it, so the sum is a
    running sum over places of what begins less what has ended.
    """
    ends = tree.select(F.explode(F.array(F.struct(F.col("pre").alias("at"), F.col("dist").alias("d")), F.struct((F.col("post") + 1).alias("at"), (-F.col("dist")).alias("d")))).alias("e")).select("e.*")
    upto = running(ends.groupBy("at").agg(F.sum("d").alias("d")), [], "at", {"root_dist": "d"}).select("at", "root_dist")
    return tree.select(F.col("name").alias("node"), F.col("pre").alias("at")).join(upto, "at").select("node", "root_dist")


def patristic(tree: DataFrame, source: str) -> DataFrame:
    """Distance along the tree from one node to every leaf."""
    far = written(root_distance(tree), "root-distances")
    met = contained(tree.filter("is_leaf").select(F.col("name").alias("node"), "pre"), "pre", shells(tree, source), "lo", "hi").select("node", "anc")
    own = far.filter(F.col("node") == source).select(F.col("root_dist").alias("d0"))
    j = met.join(far, "node").join(far.select(F.col("node").alias("anc"), F.col("root_dist").alias("da")), "anc").crossJoin(F.broadcast(own))
    return j.select(F.col("node").alias("leaf"), (F.col("root_dist") + F.col("d0") - 2 * F.col("da")).alias("distance"))


# -- boundaries and named clades ---------------------------------------------------------


def boundaries(tree: DataFrame, singletons: bool = False) -> DataFrame:
    """node, left, right: two leaves whose lowest common ancestor is the node, the first
    ones under its first and its last child (one child: its first leaf twice).

    singletons: also leaves whose first sister is no leaf, as bounds of themselves.
    """
    places = written(tree.select("name", "parent", "pre", "is_leaf").join(leaf_ranges(tree), "name"), "leaf-ranges")
    leaf = lambda c: places.filter("is_leaf").select(F.col("name").alias(c), F.col("lo").alias(f"_{c}"))
    kids = places.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.min("lo").alias("_left"), F.max_by("lo", "pre").alias("_right"), F.min_by(F.struct("name", "is_leaf"), "pre").alias("one"))
    out = kids.join(leaf("left"), "_left").join(leaf("right"), "_right").select("node", "left", "right")
    if singletons:
        # The first sister of the first child is the second one.
        second = places.join(kids.select(F.col("node").alias("parent"), "one"), "parent").filter("name <> one.name").groupBy("parent").agg(F.min_by(F.struct("name", "is_leaf"), "pre").alias("two"))
        j = places.filter("is_leaf").join(kids.select(F.col("node").alias("parent"), "one"), "parent").join(second, "parent")
        sister = F.when(F.col("name") == F.col("one.name"), F.col("two.is_leaf")).otherwise(F.col("one.is_leaf"))
        alone = j.filter(~sister).select(F.col("name").alias("node"), F.col("name").alias("left"), F.col("name").alias("right"))
        out = out.unionByName(alone)
    return out


def named_clades(tree: DataFrame, bounds: DataFrame) -> DataFrame:
    """leaf, clade: leaves of each named clade (clade, ord, left, right, out), the clade of greatest ord on overlaps.

    left and right are nodes in the clade, ``out`` one that is not, or null. If the lowest
    common ancestor of left and right holds ``out``, the clade is what is left of the
    tree, rooted at ``out``: all leaves but those towards ``out`` from where the three
    paths meet.
    """
    b = written(bounds.select("clade", "ord", "left", "right", "out"), "bounds")
    three = [("left", "right"), ("left", "out"), ("right", "out")]
    sets = b.select(F.col("clade").alias("_c"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.array(x, y).alias("nodes")) for i, (x, y) in enumerate(three)])).alias("s"))
    sets = sets.select(F.struct("_c", "s.k").alias("set_id"), F.explode("s.nodes").alias("node")).filter("node IS NOT NULL")
    met = lca(tree, sets).select("set_id.*", "lca").join(tree.select(F.col("name").alias("lca"), "depth", "pre", "post"), "lca")
    met = met.groupBy("_c").agg(F.max(F.when(F.col("k") == 0, F.struct("pre", "post"))).alias("own"), F.max_by(F.struct("lca", "pre", "post", "depth"), F.struct("depth", -F.col("k"))).alias("deep"))
    places = tree.select("name", F.col("pre").alias("op"), F.col("post").alias("oq"))
    j = b.join(met, F.col("clade") == F.col("_c")).join(places, F.col("out") == F.col("name"), "left").drop("name")
    outside = F.col("out").isNull() | (F.col("op") < F.col("own.pre")) | (F.col("op") > F.col("own.post"))
    plain = j.filter(outside).select("clade", "ord", F.col("own.pre").alias("lo"), F.col("own.post").alias("hi"))
    kid = tree.select(F.col("parent").alias("_p"), F.col("pre").alias("kp"), F.col("post").alias("kq"))
    turned = j.filter(~outside).join(kid, (F.col("deep.lca") == F.col("_p")) & (F.col("op") >= F.col("kp")) & (F.col("op") <= F.col("kq")))
    last = tree.agg(F.max("pre")).first()[0] or 0
    around = turned.select("clade", "ord", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("kp") - 1).alias("hi")), F.struct((F.col("kq") + 1).alias("lo"), F.lit(last).cast("bigint").alias("hi")))).alias("s")).select("clade", "ord", "s.lo", "s.hi")
    pairs = contained(tree.filter("is_leaf").select(F.col("name").alias("leaf"), "pre"), "pre", plain.unionByName(around), "lo", "hi")
    return pairs.groupBy("leaf").agg(F.max_by("clade", F.struct("ord", "clade")).alias("clade"))


# -- labels and supports -----------------------------------------------------------------


def label_facts(tree: DataFrame) -> DataFrame:
    """One row: labelled (an inner node has a label), numeric (all of these are numbers), percent (a support is above 1).

    tree: name (the label, or null), support, is_leaf."""
    inner = tree.filter("NOT is_leaf")
    label = F.col("name").isNotNull() & (F.col("name") != "")
    number = F.expr("try_cast(name AS double)")
    return inner.agg(
        F.coalesce(F.max(label), F.lit(False)).alias("labelled"), F.coalesce(F.min(F.when(label, number.isNotNull())), F.lit(False)).alias("numeric"),
        F.coalesce(F.max(F.greatest(F.col("support").cast("double"), F.when(label, number)) > 1), F.lit(False)).alias("percent"),
    )


def percent_supports(tree: DataFrame) -> DataFrame:
    """The tree with supports from 0 to 100: those of a tree that has none above 1 are shares."""
    top = tree.filter("NOT is_leaf").agg(F.coalesce(F.max("support"), F.lit(0)).alias("_top"))
    s = F.col("support").cast("double")
    return tree.crossJoin(F.broadcast(top)).withColumn("support", F.when(F.col("_top") > 1, s).otherwise(s * 100)).drop("_top")


def splits(tree: DataFrame) -> DataFrame:
    """name, split (a pair of numbers): the leaves on the two sides of the branch above each inner node.

    Each leaf has a key of two 62-bit hashes; a node's is the sum over its leaves, a
    difference of running sums along the leaves. Of the node and its complement the
    lesser sum stands for the branch. All leaves on one side give no split.
    """
    big = "decimal(38,0)"
    keys = [F.shiftrightunsigned(F.xxhash64(F.lit(i), "name"), 2).cast(big).alias(f"k{i}") for i in (1, 2)]
    ranged = written(tree.select("name", "is_leaf").join(leaf_ranges(tree), "name"), "leaf-ranges")
    upto = written(running(ranged.filter("is_leaf").select("lo", *keys), [], "lo", {"u1": "k1", "u2": "k2"}).select((F.col("lo") + 1).alias("at"), F.col("u1").cast(big), F.col("u2").cast(big)), "leaf-keys")
    total = upto.agg(F.max_by("u1", "at").alias("t1"), F.max_by("u2", "at").alias("t2"), F.max("at").alias("n"))
    zero = F.lit(0).cast(big)
    inner = ranged.filter("NOT is_leaf").join(upto.select(F.col("at").alias("hi"), F.col("u1").alias("b1"), F.col("u2").alias("b2")), "hi").join(upto.select(F.col("at").alias("lo"), F.col("u1").alias("a1"), F.col("u2").alias("a2")), "lo", "left")
    s = [(F.col(f"b{i}") - F.coalesce(f"a{i}", zero)).cast(big) for i in (1, 2)]
    j = inner.crossJoin(F.broadcast(total)).filter("hi - lo < n")
    return j.select("name", F.least(F.struct(s[0].alias("x"), s[1].alias("y")), F.struct((F.col("t1") - s[0]).cast(big).alias("x"), (F.col("t2") - s[1]).cast(big).alias("y"))).alias("split"))


def transfer_supports(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target tree with the supports of the source's equal splits (null where it has none; leaves keep theirs).

    Roots may differ: a split is the same from either side. Of two source nodes
    with one split (the children of a root) the higher support counts."""
    known = splits(source).join(source.select("name", "support"), "name").groupBy("split").agg(F.max("support").alias("_s"))
    found = splits(target).join(known, "split").select("name", "_s")
    kind = target.schema["support"].dataType
    return target.join(found, "name", "left").withColumn("support", F.when(F.col("is_leaf"), F.col("support")).otherwise(F.col("_s").cast(kind))).drop("_s")


# -- Newick: one text at a time ----------------------------------------------


class Node:
    """A tree node of the reader."""

    def __init__(self, name: str = "", dist: float = 0.0, children: list["Node"] | None = None, support: float | None = None):
        self.name, self.dist, self.children, self.support = name, dist, children or [], support

    def walk(self):
        """Nodes in preorder, without recursion."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.children)

    def leaves(self) -> list["Node"]:
        return [n for n in self.walk() if not n.children]


def parse_newick(text: str) -> Node:
    """Names, lengths, numeric inner labels as supports; quoted names and comments are understood."""
    root = cur = Node()
    stack: list[Node] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "(":
            stack.append(cur)
            cur.children.append(Node())
            cur = cur.children[-1]
            i += 1
        elif c == ",":
            stack[-1].children.append(Node())
            cur = stack[-1].children[-1]
            i += 1
        elif c == ")":
            cur = stack.pop()
            i += 1
        elif c == ";":
            break
        elif c == "[":
            i = text.index("]", i) + 1
        elif c == "'":
            j = i + 1
            while text[j] != "'" or text[j + 1 : j + 2] == "'":
                j += 2 if text[j] == "'" else 1
            cur.name, i = text[i + 1 : j].replace("''", "'"), j + 1
        elif c == ":":
            j = i + 1
            while j < n and text[j] not in ",();[":
                j += 1
            cur.dist, i = float(text[i + 1 : j]), j
        elif c.isspace():
            i += 1
        else:
            j = i
            while j < n and text[j] not in ",():;[":
                j += 1
            cur.name, i = text[i:j].strip(), j
    for x in root.walk():
        if x.children:
            try:
                x.support, x.name = float(x.name), ""
            except ValueError:
                pass
    return root


def to_newick(root: Node, supports: bool = True) -> str:
    done: dict[int, str] = {}
    for n in reversed(list(root.walk())):
        inner = f"({','.join(done.pop(id(c)) for c in n.children)})" if n.children else ""
        label = n.name or (f"{n.support:g}" if supports and n.children and n.support is not None else "")
        done[id(n)] = f"{inner}{label}:{n.dist:g}" if n is not root else f"{inner}{label};"
    return done[id(root)]


def label_inner(root: Node) -> Node:
    """Inner nodes N0, N1, ... in preorder; leaves have support 0."""
    k = 0
    for n in root.walk():
        if n.children:
            n.name, k = f"N{k}", k + 1
        else:
            n.support = 0.0
    return root


def neighbour_joining(names: list[str], dist) -> Node:
    """Tree of a small distance matrix (numpy, symmetric)."""
    import numpy as np

    d = np.array(dist, float)
    nodes = [Node(n) for n in names]
    while len(nodes) > 2:
        n = len(nodes)
        s = d.sum(1)
        q = (n - 2) * d - s[:, None] - s[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(int(np.argmin(q)), q.shape))
        di = max(0.0, 0.5 * d[i, j] + (s[i] - s[j]) / (2 * (n - 2)))
        nodes[i].dist, nodes[j].dist = float(di), max(0.0, float(d[i, j] - di))
        new = 0.5 * (d[i] + d[j] - d[i, j])
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in keep] + [Node("", 0.0, [nodes[i], nodes[j]])]
    if len(nodes) == 2:
        nodes[0].dist = nodes[1].dist = float(d[0, 1]) / 2
        return Node("", 0.0, nodes)
    return nodes[0]


def node_rows(root: Node) -> list[tuple]:
    """Rows of the node table: name, parent, depth, support, dist, is_leaf, pre, post."""
    rows, depth, parent = [], {id(root): 0}, {}
    order = list(root.walk())
    pre = {id(n): i for i, n in enumerate(order)}
    last = {id(n): pre[id(n)] for n in order}
    for n in order:
        for c in n.children:
            depth[id(c)], parent[id(c)] = depth[id(n)] + 1, n
    for n in reversed(order):
        for c in n.children:
            last[id(n)] = max(last[id(n)], last[id(c)])
    for n in order:
        p = parent.get(id(n))
        rows.append((n.name or f"#{pre[id(n)]}", None if p is None else p.name or f"#{pre[id(p)]}", depth[id(n)], n.support, n.dist, not n.children, pre[id(n)], last[id(n)]))
    return rows


NODE_SCHEMA = "name string, parent string, depth int, support double, dist double, is_leaf boolean, pre bigint, post bigint"


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Node tables of Newick files, one tree a file, many files in parallel: file and the columns of NODE_SCHEMA.

    Inner nodes are named N0, N1, ... in preorder; numeric labels are supports, other labels are dropped."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for f, text in zip(pdf["file"], pdf["value"]):
                got = node_rows(label_inner(parse_newick(text)))
                yield pd.DataFrame([(f, *r) for r in got], columns=["file", *(x.split()[0] for x in NODE_SCHEMA.split(", "))])

    texts = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return texts.mapInPandas(rows, f"file string, {NODE_SCHEMA}")


def relabelled_newick(texts: DataFrame, labels: dict[str, str], ignore_missing: bool = False) -> DataFrame:
    """Newick texts (value) in which only the inner nodes that ``labels`` names have a label, the new one.

    A label that a text lacks is an error, or is passed over. Leaves keep their names."""
    if len(set(labels.values())) < len(labels):
        raise ValueError("two nodes would have one label")

    def run(batches):
        import re

        # A label stands between a closing bracket and what ends it.
        inner = re.compile(r"\)([^:;,()]*)")
        for pdf in batches:
            for k, text in zip(pdf.index, pdf["value"]):
                lost = set(labels) - set(inner.findall(text))
                if lost and not ignore_missing:
                    raise ValueError(f"not in the tree: {', '.join(sorted(lost))}")
                pdf.loc[k, "value"] = inner.sub(lambda m: ")" + labels.get(m[1], ""), text)
            yield pdf

    return texts.select("value").mapInPandas(run, "value string")
