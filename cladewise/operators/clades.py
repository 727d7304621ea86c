"""Clades of a tree with their rows: sub-alignments, profiles, thresholds, scores by cousin level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.operators import hits, profiles, trees
from cladewise.operators.aln import GAP, occupancy
from cladewise.session import written


def without_empty_columns(aln: DataFrame) -> DataFrame:
    """Rows (aln_id, seq_id, aligned) without the columns in which their alignment has gaps alone.

    One array of marks for each alignment is joined to its rows, and each row is one pass."""
    aln = written(aln.select("aln_id", "seq_id", "aligned"), "sub-alignments")
    marks = occupancy(aln).groupBy("aln_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", (F.col("filled") > 0).alias("some")))), lambda x: x["some"]).alias("marks"))
    marks = written(marks, "column-marks")
    kept = F.zip_with(F.split("aligned", ""), F.slice("marks", F.lit(1), F.length("aligned")), lambda c, m: F.when(m, c).otherwise(""))
    return aln.join(marks, "aln_id", "left").select("aln_id", "seq_id", F.when(F.length("aligned") > 0, F.array_join(kept, "")).otherwise(F.coalesce("aligned", F.lit(""))).alias("aligned"))


def sub_alignment(aln: DataFrame, wanted: DataFrame, missing_error: bool = True) -> DataFrame:
    """Rows of the wanted sequences (aln_id, seq_id) without the columns that are empty among them.

    A wanted sequence that no alignment has is a ValueError, or is passed over."""
    w = wanted.select("aln_id", "seq_id").distinct()
    if missing_error:
        lost = w.join(aln, ["aln_id", "seq_id"], "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"not in the alignment: {', '.join(str(r.seq_id) for r in lost)}")
    return without_empty_columns(aln.join(w, ["aln_id", "seq_id"], "left_semi"))


def clade_sub_alignments(tree: DataFrame, aln: DataFrame, clades: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """One alignment for each clade (aln_id) of the rows (seq_id, aligned) of its leaves.

    clades: clade. include (clade, seq_id): only these; it overrides exclude (seq_id)."""
    pairs = trees.clade_labels(tree, clades.select(F.col("clade").alias("name"))).select(F.col("clade").alias("aln_id"), F.col("leaf").alias("seq_id"))
    if include is not None:
        pairs = pairs.join(include.select(F.col("clade").alias("aln_id"), "seq_id").distinct(), ["aln_id", "seq_id"], "left_semi")
    elif exclude is not None:
        pairs = pairs.join(exclude.select("seq_id").distinct(), "seq_id", "left_anti").select("aln_id", "seq_id")
    return without_empty_columns(pairs.join(aln.select("seq_id", "aligned"), "seq_id"))


def clade_profiles(tree: DataFrame, aln: DataFrame, clades: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, **options) -> DataFrame:
    """Profiles (profile, pos, aa, nlp) of clades, by their names."""
    return profiles.build(clade_sub_alignments(tree, aln, clades, include, exclude), **options)


def outside_scores(tree: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (profile: a clade's name, target: a leaf, score) of leaves outside of the profile's clade."""
    span = tree.select(F.col("name").alias("profile"), F.col("pre").alias("_lo"), F.col("post").alias("_hi"))
    place = tree.filter("is_leaf").select(F.col("name").alias("target"), F.col("pre").alias("_at"))
    return scores.join(span, "profile").join(place, "target").filter("_at < _lo OR _at > _hi").select("profile", "target", "score")


def clade_thresholds(tree: DataFrame, scores: DataFrame, beat: float = 0.2) -> DataFrame:
    """profile, threshold: the score that the given share of the leaves outside, among those with one, reach."""
    best = outside_scores(tree, scores).groupBy("profile", "target").agg(F.max("score").alias("score"))
    return hits.rank_threshold(best, beat).select("profile", "threshold")


def cousin_scores(tree: DataFrame, target: str, scores: DataFrame, include_target: bool = False) -> DataFrame:
    """level, leaf, score: leaves by how far outside the target clade they are (1: its sister), with their score (null: none).

    scores: seq_id, score. With include_target its own leaves are level 0."""
    levels = trees.cousin_sets(tree, target)
    if include_target:
        name = tree.sparkSession.createDataFrame([(target,)], "name string")
        own = trees.clade_labels(tree, name).select("leaf", F.lit(0).cast("bigint").alias("level"))
        levels = levels.select("leaf", F.col("level").cast("bigint").alias("level")).unionByName(own)
    return levels.join(scores.select(F.col("seq_id").alias("leaf"), "score"), "leaf", "left").select("level", "leaf", "score")


def ungapped(aln: DataFrame) -> DataFrame:
    """seq_id, seq of alignment rows."""
    return aln.select("seq_id", F.replace("aligned", F.lit(GAP), F.lit("")).alias("seq"))
