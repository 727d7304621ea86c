"""Interval questions of nested-set trees as equi-joins.

An interval of whole numbers is cut into the at most 2 log2(n) aligned blocks that
make it up; a point lies in one block of each size. So containment is an equality
of (size, block), for any number of intervals and any depth of nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators.ranges import running
from cladewise.session import written

#: Blocks of intervals that are broadcast, at most.
FEW = 1 << 16


def blocks(lo: str, hi: str) -> Column:
    """Aligned blocks (size: power of two, at: number) that make up lo to hi, both inclusive.

    Of each size the first block not before lo, if its number is odd, and the last one not
    beyond hi, if it is even: the others are halves of larger ones."""
    a, b = f"shiftright({lo} + shiftleft(1L, k) - 1, k)", f"shiftright({hi} + 1, k)"
    one = f"named_struct('size', k, 'at', CASE WHEN {a} < {b} AND {a} % 2 = 1 THEN {a} END)"
    two = f"named_struct('size', k, 'at', CASE WHEN {a} < {b} AND {b} % 2 = 1 THEN {b} - 1 END)"
    return F.expr(f"filter(flatten(transform(sequence(0, 61), k -> array({one}, {two}))), x -> x.at IS NOT NULL)")


def contained(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """All pairs of a point and an interval that holds it. Column names of both sides must differ.

    A point is repeated for each size of block, which Spark's estimates do not see: the
    points are never the side that is broadcast. Blocks of the sizes with the fewest
    rows, up to FEW in all, are broadcast; those of the other sizes meet by a shuffle.
    """
    cut = intervals.filter(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(blocks(lo, hi))).select(*intervals.columns, F.col("_b.size").alias("_size"), F.col("_b.at").alias("_at"))
    cut = written(cut, "interval-blocks")
    # At most 62 sizes.
    counts = sorted(cut.groupBy("_size").count().collect(), key=lambda r: (r["count"], r["_size"]))
    few, many, total = [], [], 0
    for size, n in counts:
        total += n
        (few if total <= FEW else many).append(size)
    if not counts:
        return points.join(intervals, F.lit(False))

    def met(sizes: list[int], side: DataFrame) -> DataFrame:
        spread = points.withColumn("_size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("_at", F.expr(f"shiftright(CAST({at} AS BIGINT), _size)"))
        return spread.join(side, ["_size", "_at"]).drop("_size", "_at")

    parts = [met(few, F.broadcast(cut.filter(F.col("_size").isin(few))))] if few else []
    parts += [met(many, cut.filter(F.col("_size").isin(many)).hint("merge"))] if many else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def leaf_ranges(tree: DataFrame) -> DataFrame:
    """name, lo, hi of every node: its leaves are those with lo <= rank < hi in preorder (a leaf's rank is its lo)."""
    upto = running(tree.select("name", "pre", "post", F.col("is_leaf").cast("bigint").alias("leaf")), [], "pre", {"upto": "leaf"})
    last = upto.select(F.col("pre").alias("post"), F.col("upto").alias("hi"))
    return upto.join(last, "post").select("name", (F.col("upto") - F.col("leaf")).alias("lo"), "hi")
