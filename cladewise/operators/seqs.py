"""Sequence tables: selection, extraction, merging, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators.ranges import running

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def include(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    return seqs.join(ids.select("seq_id"), "seq_id", "left_semi")


def exclude(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    return seqs.join(ids.select("seq_id"), "seq_id", "left_anti")


def missing(ids: DataFrame, seqs: DataFrame) -> DataFrame:
    """Wanted ids that are not there."""
    return ids.join(seqs.select("seq_id"), "seq_id", "left_anti")


def ungapped(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def extract(seqs: DataFrame, coords: DataFrame, ungap: bool = False) -> DataFrame:
    """Sub-sequences at 1-based inclusive (s, e); coords: seq_id, pos (order of the wish), s, e (null: whole)."""
    seq = ungapped(F.col("seq")) if ungap else F.col("seq")
    part = F.when(F.col("s").isNull(), F.col("_s")).otherwise(F.substring(F.col("_s"), F.col("s"), F.col("e") - F.col("s") + 1))
    return seqs.withColumn("_s", seq).join(coords, "seq_id").select("seq_id", "pos", part.alias("seq"))


def bare_id(c: Column) -> Column:
    """UniRef50_X becomes X."""
    return F.regexp_replace(c, "^UniRef50_", "")


def len_filter(seqs: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Inclusive bounds; a bound of None or 0 is open."""
    n = F.length("seq")
    return seqs.filter((n >= least if least else F.lit(True)) & (n <= most if most else F.lit(True)))


def alphabet_filter(seqs: DataFrame, letters: str = ALPHABET + "-", column: str = "seq") -> DataFrame:
    return seqs.filter(F.translate(F.col(column), letters, "") == "")


def seq_lens(seqs: DataFrame, descending: bool = True) -> DataFrame:
    n = F.length("seq")
    return seqs.select("seq_id", n.alias("len")).orderBy(F.desc("len") if descending else F.asc("len"), "seq_id")


def custom_filter(seqs: DataFrame, predicate: Column, value: bool = True) -> DataFrame:
    return seqs.filter(predicate == F.lit(value))


def merge_first_wins(*sources: DataFrame) -> DataFrame:
    """All sources after one another; of each seq_id the first row of the first source stays.

    Each source has seq_id, ord and seq. Pre-aggregated: one row per id and task travels.
    """
    rows = None
    for k, s in enumerate(sources):
        part = s.select("seq_id", F.lit(k).alias("src"), "ord", "seq")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("seq_id").agg(F.min_by(F.struct("src", "ord", "seq"), F.struct("src", "ord")).alias("b")).select("seq_id", "b.*")


def merge_between_only(*sources: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """All sources after one another; rows go if an earlier source has their seq_id. Repeats inside a source stay."""
    rows = None
    for k, s in enumerate(sources):
        part = s.select("seq_id", F.lit(k).alias("src"), "ord", "seq")
        rows = part if rows is None else rows.unionByName(part)
    if excluded is not None:
        rows = exclude(rows, excluded)
    first = rows.groupBy("seq_id").agg(F.min("src").alias("src"))
    return rows.join(first, ["seq_id", "src"]).select("seq_id", "src", "ord", "seq")


def worst_share(df: DataFrame, value: Column, share: float, by: list[str], tie: str, highest: bool = False) -> DataFrame:
    """The int(n * share) rows with the lowest (highest) value in each group, by running counts, so no group is one task.

    Nulls come first among the lowest and last among the highest; ``tie`` tells rows of a group apart.
    """
    order = F.struct(value.isNull().alias("a"), (-value).alias("b"), F.col(tie).alias("c")) if highest else F.struct(value.alias("b"), F.col(tie).alias("c"))
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = running(df.withColumns({"_order": order, "_one": F.lit(1)}), by, "_order", {"_rn": "_one"}).join(n, by)
    return ranked.filter(F.col("_rn") <= F.floor(F.col("_n") * share)).select(*df.columns)
