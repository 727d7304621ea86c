"""Text reports as tables of lines: part, ord, line.

``write_report`` writes them in order; the part files one after the other are the
file. Header lines are part 0, what follows them later parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators.annots import OTHER_COLOUR, PALETTE, cleaned, itol_rows, top_values
from cladewise.operators.levels import Levels


def _header(spark: SparkSession, lines: list[str], part: int = 0) -> DataFrame:
    return spark.createDataFrame([(part, f"{i:09d}", x) for i, x in enumerate(lines)], "part int, ord string, line string")


def _rows(df: DataFrame, order: Column, line: Column, part: int = 1) -> DataFrame:
    return df.select(F.lit(part).alias("part"), order.cast("string").alias("ord"), line.alias("line"))


def write_report(lines: DataFrame, path: str) -> None:
    """Write the lines in order of part and ord."""
    lines.orderBy("part", "ord").select("line").write.text(path)


def itol_metadata(annots: DataFrame, fields: list[str], exclude: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Metadata of a tree's nodes: labels of the fields, one line for each node, a dot for null."""
    shown = sorted(set(fields) - set(exclude))
    head = _header(annots.sparkSession, ["METADATA", "SEPARATOR TAB", "\t".join(["FIELD_LABELS", *shown]), "DATA"])
    r = annots.select("seq_id").distinct().join(itol_rows(annots, shown), "seq_id", "left")
    empty = F.concat_ws("\t", F.col("seq_id").cast("string"), *[F.lit(".")] * len(shown))
    r = r.select("seq_id", F.coalesce("line", empty).alias("line"))
    return head.unionByName(_rows(r, F.col("seq_id"), F.col("line")))


def itol_strip(annots: DataFrame, field: str, binary: bool = False, binary_colour: str = "#ff0000") -> DataFrame:
    """Colour strip of one field: the most frequent values have colours of their own, all
    others are Other; with ``binary`` every node that has a value is True, in one colour."""
    head = _header(annots.sparkSession, ["DATASET_COLORSTRIP", "SEPARATOR COMMA", f"DATASET_LABEL,{field}", "COLOR,#ff0000", "DATA"])
    if binary:
        r = cleaned(annots).filter((F.col("field") == field) & F.col("value").isNotNull()).select("seq_id").distinct()
        return head.unionByName(_rows(r, F.col("seq_id"), F.concat(F.col("seq_id").cast("string"), F.lit(f",{binary_colour},True"))))
    named = top_values(annots, field, len(PALETTE))
    counts = named.filter("label <> 'Other'").groupBy("label").agg(F.count("*").alias("n"))
    # At most one row for each colour.
    ordered = [r.label for r in counts.orderBy(F.desc("n"), "label").collect()]
    colours = dict(zip(ordered, PALETTE))
    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in colours.items() for x in p]), F.col("label")), F.lit(OTHER_COLOUR)) if colours else F.lit(OTHER_COLOUR)
    return head.unionByName(_rows(named, F.col("seq_id"), F.concat_ws(",", F.col("seq_id").cast("string"), colour, F.col("label"))))


def itol_symbols(nodes: DataFrame, colour: str = "#0000ff", legend: str = "Ancestors") -> DataFrame:
    """Symbols on the given nodes (name)."""
    head = _header(nodes.sparkSession, ["DATASET_SYMBOL", "SEPARATOR TAB", f"DATASET_LABEL\t{legend}", f"COLOR\t{colour}", "MAXIMUM_SIZE\t10", "DATA"])
    return head.unionByName(_rows(nodes, F.col("name"), F.concat_ws("\t", F.col("name"), F.lit("2"), F.lit("8"), F.lit(colour), F.lit("1"), F.lit("1"))))


def rep_map(pairs: DataFrame, old: str = "rep", new: str = "new_rep") -> DataFrame:
    """One line for each representative and the one in its place."""
    return _rows(pairs, F.col(old), F.concat_ws("\t", F.col(old).cast("string"), F.col(new).cast("string")))


def cluster_lines(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    """A cluster file: each cluster (rep, member) has its representative's header alone, then its members' records, the representative first."""
    j = clusters.join(seqs.select(F.col("seq_id").alias("member"), "seq"), "member")
    rep, member = F.col("rep").cast("string"), F.col("member").cast("string")
    first = F.when(F.col("rep") == F.col("member"), 0).otherwise(1)
    record = F.concat(F.lit(">"), member, F.lit("\n"), F.coalesce("seq", F.lit("")))
    heads = clusters.select("rep").distinct()
    return _rows(j, F.concat_ws("\x01", rep, first.cast("string"), member), record).unionByName(_rows(heads, rep, F.concat(F.lit(">"), rep)))


def level_report(found: Levels, name: str, metric: str = "nmi") -> DataFrame:
    """Levels of clustering: parameters, the first level, then every level with its samples, rounded to four places, NEXT on the kept ones."""
    spark = found.clusters.sparkSession
    n = found.clusters.groupBy("level").agg(F.count_distinct("rep").cast("string").alias("n"))
    head = _header(spark, ["Parameters", f"\tSequences:\t{name}", f"\t{metric}", "//", "Parent Clustering"])
    first = _rows(n.filter("level = 0"), F.lit("0"), F.concat(F.lit("\tlevel 0\t"), F.col("n")))
    middle = _header(spark, ["//", "Sub Clusterings"], 2)
    four = lambda c: F.format_string("%.4f", c)
    level = F.format_string("%05d", "level")
    tops = found.metrics.select("level", "overall").distinct()
    tops = _rows(tops, level, F.concat(F.lit("\tlevel "), F.col("level").cast("string"), F.lit("\tParent Clustering: level "), (F.col("level") - 1).cast("string"), F.lit("\t"), four("overall")), 3)
    kept = found.metrics.join(n, "level")
    each = _rows(kept, F.concat(level, F.lit("\x01"), F.format_string("%05d", "sample")), F.concat_ws("\t", F.lit("\t\tsample") , F.col("sample").cast("string"), F.when(F.col("best"), F.col("n")).otherwise(""), four("score"), F.when(F.col("best"), "NEXT").otherwise("")), 3)
    return head.unionByName(first).unionByName(middle).unionByName(tops).unionByName(each).unionByName(_header(spark, ["//"], 4))
