"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight and a slope. Over training time t in [0, 1] it is
drawn at the rate target * (1 + slope * (2t - 1)): a source with a positive
slope comes late, one with a negative slope early. The integral of that rate is
the demand for the source's tokens up to t,

    D(t) = target * (t + slope * (t^2 - t)),   D(0) = 0, D(1) = target.

The source's documents, in an order drawn from their ids and repeated pass
after pass, stand on the axis of demanded tokens; inverting D (a quadratic)
turns a document's place there into its training position, and the result is
range-sorted by position.

Targets share the total size by weight, and none is above ``most_passes``
times its source's size: with the sources in ascending order of
size * most_passes / weight, the first k are at their limit where k is the
least number for which the rest, sharing what is left by weight, stay within
theirs.

Only DataFrame functions are used. Running sums over a source are made in two
levels, over 4096 ranges of the draw and then inside each range, so a source
with a third of all rows is spread over as many tasks as any other data.

Defined results: a null or empty text has size 0 and is never taken. Sources go
by code point, null last. Rows that repeat a doc_id are separate documents,
ordered by size. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.session import written

WEIGHTS = (5, 2, 1)
SLOPES = (0.0, 0.5, -0.5)
MOST_PASSES = 3
#: Hex digits of the draw that name a range: 16**3 ranges.
RANGE_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights=WEIGHTS, slopes=SLOPES, most_passes: int = MOST_PASSES) -> DataFrame:
    """One row per source: source, source_size, weight, slope, target (double)."""
    n = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (pick + 1).cast("int"))
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (pick + 1).cast("int"))
    sums = sums.select("source", "source_size", weight.alias("weight"), slope.alias("slope"), (F.lit(most_passes) * F.col("source_size")).alias("limit"))
    # One row per source from here on.
    up = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    below = up.rowsBetween(W.unboundedPreceding, -1)
    rest = up.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0))) / F.sum("weight").over(rest)
    leveled = sums.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    share = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    return leveled.withColumn("share", share).select(
        "source", "source_size", "weight", "slope",
        F.least(F.coalesce(F.col("share") * F.col("weight"), F.col("limit").cast("double")), F.col("limit").cast("double")).alias("target"),
    )


def position_of(demand: Column, target: Column, slope: Column) -> Column:
    """The time at which the demand for a source reaches ``demand`` tokens."""
    y = demand / target
    lean = F.lit(1.0) - slope
    return F.when(slope == 0.0, y).otherwise((F.sqrt(lean * lean + F.lit(4.0) * slope * y) - lean) / (F.lit(2.0) * slope))


def mixed(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, most_passes: int = MOST_PASSES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes,
    part (words of a last pass that stops inside the source), taken, position,
    and slope and before (words of its source that come before it).

    ``position`` is that of the document's first use, null where it has none.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sized = sized.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("range", F.substring("draw", 1, RANGE_DIGITS))
    # Written, so that the texts are read and counted once.
    sized = written(sized, "sizes")
    targets = source_targets(sized, weights, slopes, most_passes)
    totals = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ranges = totals.select("source", "range", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("range_before"))
    plan = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "slope", "target")
    inside = W.partitionBy("source", "range").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = sized.withColumn("upto", F.sum("size").over(inside))
    at = run.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
    before = F.col("range_before") + F.col("upto") - F.col("size")
    words = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), words - passes * F.col("source_size") - before))
    out = at.select("d.doc_id", "d.source", "size", "source_size", "target", "slope", before.alias("before"), passes.cast("bigint").alias("passes"), part.cast("bigint").alias("part"))
    taken = F.col("passes") * F.col("size") + F.col("part")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "passes", "part", taken.alias("taken"),
        F.when(taken > 0, position_of(F.col("before").cast("double"), F.col("target"), F.col("slope"))).alias("position"), "slope", "before",
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents in training order, each as often as the mix takes it.

    A document is the unit here: a last pass that takes half of it or more
    counts as one use. The columns are those of ``docs``.
    """
    mix = mixed(docs)
    uses = F.col("passes") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    # Rows that share a doc_id and a size have shares of their own; they are used alike.
    each = mix.groupBy("doc_id").agg(F.max(uses).alias("uses"), F.min_by(F.struct("before", "source_size", "target", "slope"), "before").alias("at")).filter("uses > 0")
    spread = each.select(F.col("doc_id"), "at", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))).alias("pass"))
    demand = (F.col("at.before") + F.col("pass") * F.col("at.source_size")).cast("double")
    spread = spread.select("doc_id", position_of(demand, F.col("at.target"), F.col("at.slope")).alias("position"))
    rows = docs.alias("d").join(spread.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")))
    return rows.orderBy("k.position", "d.doc_id").select("d.*")


def in_training_order(mix: DataFrame) -> DataFrame:
    """Range-sorted by position; ties by doc_id, unused documents last."""
    return mix.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS draw FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s0
), s AS (
  SELECT source, source_size, [5, 2, 1][(i % 3) + 1] AS weight, CAST([0.0, 0.5, -0.5][(i % 3) + 1] AS DOUBLE) AS slope, 3 * source_size AS lim FROM s1
), l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s
), t AS (
  SELECT source, source_size, slope, least(coalesce((SELECT arg_min(level, lim / weight) FROM l WHERE level * weight <= lim) * weight, CAST(lim AS DOUBLE)), CAST(lim AS DOUBLE)) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.slope, t.target,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM r
), q AS (
  SELECT *, passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS taken FROM p
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CASE WHEN slope = 0.0 THEN before / target ELSE (sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * (before / target)) - (1.0 - slope)) / (2.0 * slope) END END AS position
FROM q
"""
