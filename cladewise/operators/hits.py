"""Selection of profile hits: thresholds, best rows, medians, bounds.

Hits are long tables (profile, target, score, ...). Threshold tables have one
row per profile; they are written before they are joined, so that Spark knows
their size and broadcasts them while it is below its own limit. Without, a join
by profile would bring all hits of a profile to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.session import filtered_joins, written


def over_threshold(hits: DataFrame, thresholds: DataFrame, strict: bool = False) -> DataFrame:
    """Hits at or above (strictly above) the threshold of their profile."""
    keep = F.col("score") > F.col("threshold") if strict else F.col("score") >= F.col("threshold")
    return hits.join(written(thresholds, "thresholds"), "profile").filter(keep)


def first_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def best_domain(hits: DataFrame) -> DataFrame:
    """Best-scoring hit of each (profile, target), the earliest on ties. Pre-aggregated before the shuffle."""
    rest = [c for c in hits.columns if c not in ("profile", "target", "score", "ord")]
    best = hits.groupBy("profile", "target").agg(F.max_by(F.struct("score", "ord", *rest), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
    return best.select("profile", "target", "b.*")


def first_row_domain(hits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Of the hits strictly over one threshold, the first of each (profile, target) in file order."""
    rest = [c for c in hits.columns if c not in ("profile", "target", "ord")]
    got = hits.filter(F.col("score") > threshold).groupBy("profile", "target").agg(F.min_by(F.struct("ord", *rest), "ord").alias("b"))
    return got.select("profile", "target", "b.*")


def lower_median_interval(passing: DataFrame, start: str = "env_s", end: str = "env_e") -> DataFrame:
    """Per target the interval of lower-median length over its passing profiles."""
    w = W.partitionBy("target")
    order = w.orderBy(F.col(end) - F.col(start), "profile")
    ranked = passing.select("*", F.row_number().over(order).alias("_rn"), F.count("*").over(w).alias("n_profiles"))
    return ranked.filter(F.col("_rn") == F.floor((F.col("n_profiles") - 1) / 2) + 1).drop("_rn")


def curate(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Best domain per profile and target, thresholds, then one interval per target."""
    picked = lower_median_interval(over_threshold(best_domain(hits), thresholds))
    return picked.select("target", "profile", "score", "env_s", "env_e", "n_profiles")


def curate_chains(best: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Curation by chains: best (profile, target, score, span_s, span_e), thresholds (profile, threshold, ord).

    A target stays if the best chain of some profile reaches that profile's threshold; its
    interval is the span of the first such profile in the order of the thresholds."""
    ok = over_threshold(best, thresholds)
    got = ok.groupBy("target").agg(F.min_by(F.struct("profile", "score", F.col("span_s").alias("env_s"), F.col("span_e").alias("env_e")), F.struct("ord", "profile")).alias("b"), F.count("*").alias("n_profiles"))
    return got.select("target", "b.*", "n_profiles")


def extract_domains(curated: DataFrame, sequences: DataFrame) -> DataFrame:
    """Curated targets with their full sequence and the part inside their interval (1-based, inclusive)."""
    j = curated.join(sequences, F.col("target") == F.col("seq_id"))
    return j.select("target", "seq", F.expr("substring(seq, env_s, env_e - env_s + 1)").alias("domain"))


def profile_db_hits(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per target: passing profiles, and the lexicographically greatest (start, end)."""
    ok = over_threshold(best_domain(hits), thresholds)
    got = ok.groupBy("target").agg(F.count("*").alias("n_profiles"), F.max(F.struct("env_s", "env_e")).alias("b"), F.max("score").alias("best_score"))
    return got.select("target", "n_profiles", "b.env_s", "b.env_e", "best_score")


def score_matrix(hits: DataFrame, profiles: list[str]) -> DataFrame:
    """Targets x profiles, the last score in file order; null where there is no hit."""
    return hits.groupBy("target").pivot("profile", profiles).agg(F.max_by("score", F.struct("ord", "score")))


def dense_hits(hits: DataFrame, profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """Every (profile, target), with its hits in order (none: an empty list). Profiles are few and broadcast by Spark's size limit."""
    got = hits.groupBy("profile", "target").agg(F.sort_array(F.collect_list(F.struct("ord", "score", "env_s", "env_e"))).alias("hits"))
    return targets.crossJoin(profiles).join(got, ["profile", "target"], "left").withColumn("hits", F.coalesce("hits", F.array()))


def hit_names(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    return over_threshold(hits, thresholds).select("target").distinct()


def split_by_membership(scores: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of targets inside and outside a given set, in two columns."""
    m = members.select(F.col("target").alias("_t")).distinct()
    inside = F.col("_t").isNotNull()
    j = scores.join(m, F.col("target") == F.col("_t"), "left")
    return j.select("target", F.when(inside, F.col("score")).alias("score_in"), F.when(~inside, F.col("score")).alias("score_out"))


def rank_threshold(scores: DataFrame, share: float, by: str = "profile") -> DataFrame:
    """Score at place round(n * share) - 1 (from 0, halves to even) of the descending scores; the lowest for place -1.

    Scores are counted by value first, so a profile with very many rows sends
    one row per distinct score and task; places follow from running counts.
    """
    counts = scores.groupBy(by, "score").agg(F.count("*").alias("k"))
    w = W.partitionBy(by)
    c = counts.select("*", F.sum("k").over(w.orderBy(F.desc("score"))).alias("upto"), F.sum("k").over(w).alias("n"))
    want = F.bround(F.col("n") * F.lit(share), 0)
    place = F.when(want < 1, F.col("n")).otherwise(want)
    return c.filter((F.col("upto") >= place) & (F.col("upto") - F.col("k") < place)).select(by, F.col("score").alias("threshold"), F.col("n").cast("bigint").alias("n"))


def best_pair_hit(pairs: DataFrame, query: str, target: str) -> DataFrame:
    """The best-scoring target of each query; on ties the least target."""
    got = pairs.groupBy(query).agg(F.max_by(F.struct(target, "score"), F.struct(F.col("score"), -F.col(target))).alias("b"))
    return got.select(query, f"b.{target}", "b.score")


def reciprocal_map(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that are each other's best hit."""
    one, two = best_pair_hit(pairs, a, b), best_pair_hit(pairs, b, a)
    return one.join(two.select(F.col(a).alias("_a"), F.col(b).alias("_b")), (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))).drop("_a", "_b")


def bounded_pairs(best: DataFrame, min_id: float, min_cov: float) -> DataFrame:
    """Best hits (query, target, identity, coverage, ...) within both bounds; a null figure is not."""
    return best.filter((F.col("identity") >= min_id) & (F.col("coverage") >= min_cov))


def tree_mapping(there: DataFrame, back: DataFrame, clades_there: DataFrame, clades_back: DataFrame, min_id: float = 80, min_cov: float = 80, label: str = "tree_mapping", prefix: str = "map", clade_prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Annotations (seq_id, field, value) of the sequences of two trees by each other's.

    there: best hits of the first tree's sequences in the second's (query, target,
    identity, coverage, ord); back: the other way. clades: clade, seq_id on either
    side. For the second tree: each hit within the bounds names its query as
    ``label``, and as ``prefix``_clade for each clade of the query; of several queries
    the last one (by ord, then query) stands. Its own clades are "True".
    """

    def marks(best: DataFrame, clades: DataFrame, own: DataFrame) -> DataFrame:
        good = bounded_pairs(best, min_id, min_cov)
        last = F.max_by(F.col("query").cast("string"), F.struct("ord", "query")).alias("value")
        every = good.groupBy(F.col("target").alias("seq_id")).agg(last).select("seq_id", F.lit(label).alias("field"), "value")
        field = F.concat(F.lit(f"{prefix}_"), "clade")
        by_clade = good.join(clades.distinct(), F.col("query") == F.col("seq_id")).drop("seq_id").groupBy(F.col("target").alias("seq_id"), field.alias("field")).agg(last)
        name = F.concat(F.lit(f"{clade_prefix}_" if clade_prefix else ""), "clade")
        return every.unionByName(by_clade).unionByName(own.distinct().select("seq_id", name.alias("field"), F.lit("True").alias("value")))

    return marks(back, clades_back, clades_there), marks(there, clades_there, clades_back)


def shared_words(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int = 5) -> DataFrame:
    """Pairs of texts by the number of distinct k-word sequences they share.

    An equi-join on the sequences: texts that share none never meet. Sequences of
    the left side that the right side lacks go before they are made distinct, so
    the smaller side should be the right one.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
        w = df.select(key, words.alias("w")).filter(F.size("w") >= k)
        return w.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))).alias("gram"))

    few = written(grams(right, right_id).distinct(), "grams")
    with filtered_joins(left.sparkSession):
        met = written(grams(left, left_id).join(few.filter("gram > ''").select("gram"), "gram", "left_semi").distinct(), "shared-grams")
    return met.join(few, "gram").groupBy(left_id, right_id).agg(F.count("*").alias("score"))
