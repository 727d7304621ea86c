"""Running sums over a whole order, without one task that sees all of it.

Rows are range-partitioned by key and order, summed inside each partition, and
shifted by the sums of the partitions before: one row per partition and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.session import written


def running(rows: DataFrame, keys: list[str], order: str, values: dict[str, str], descending: bool = False) -> DataFrame:
    """The rows with a running sum, up to and with each row, of each of ``values`` (new name: column).

    The pair of keys and order must tell rows apart: count equal ones first, so that
    no tie is larger than a row. Null keys count as equal.
    """
    way = F.desc_nulls_last if descending else F.asc
    cut = written(rows.repartitionByRange(*keys, way(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = [F.sum(c).alias(f"_{n}") for n, c in values.items()]
    totals = cut.groupBy(*keys, "_part").agg(*sums)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values])
    inside = W.partitionBy("_part", *keys).orderBy(way(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    got = cut.withColumns({n: F.sum(c).over(inside) for n, c in values.items()})
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return got.join(offsets, same).select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in values])


def rank_sums(rows: DataFrame, others: DataFrame, keys: list[str], values: dict[str, str | Column], above: bool) -> DataFrame:
    """Per row (keys, score) the sums of ``values`` (new name: column) over the others with a higher (else lower) score of the same keys.

    rows: keys, score and more; others: keys, score and the columns that values
    name. No pair is made: both sides are counted by score, summed along the order,
    and what has the row's own score is taken off. Null scores meet nothing: 0.
    """
    sums = [F.sum(v).alias(n) for n, v in values.items()]
    by = others.filter("score IS NOT NULL").groupBy(*keys, "score").agg(*sums)
    mine = rows.filter("score IS NOT NULL").select(*keys, "score").distinct()
    both = mine.unionByName(by, allowMissingColumns=True).groupBy(*keys, "score").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"own_{n}") for n in values])
    upto = running(both, keys, "score", {n: f"own_{n}" for n in values}, descending=above)
    upto = upto.select(*keys, "score", *[(F.col(n) - F.col(f"own_{n}")).alias(n) for n in values])
    got = rows.join(upto, [*keys, "score"], "left")
    return got.select(*rows.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in values])
