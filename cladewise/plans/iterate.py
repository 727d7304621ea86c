"""The iterative run: search, curate, cluster, rebuild profiles, until few new sequences appear."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators import clusters, hits, profiles, search
from cladewise.session import written

LOG = logging.getLogger(__name__)


def convergence(iterations: DataFrame, share: float) -> DataFrame:
    """Per iteration: size, sequences not in the two before it, and whether that is under ``share``.

    iterations: iter, seq_id. The first two iterations never converge.
    """
    before = iterations.select("seq_id", F.explode(F.array(F.col("iter") + 1, F.col("iter") + 2)).alias("iter")).distinct().withColumn("old", F.lit(1))
    j = iterations.select("iter", "seq_id").distinct().join(before, ["iter", "seq_id"], "left")
    first = iterations.agg(F.min("iter").alias("first"))
    got = j.groupBy("iter").agg(F.count("*").alias("n"), F.sum(F.when(F.col("old").isNull(), 1).otherwise(0)).alias("n_new")).crossJoin(F.broadcast(first))
    novelty = F.col("n_new") / F.col("n")
    return got.select("iter", "n", "n_new", novelty.alias("novelty"), ((F.col("iter") >= F.col("first") + 2) & (novelty < share)).alias("converged"))


def new_profiles(curated: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of the curated domains, and a profile of each, whatever its size, with its threshold: the
    lowest score of its own members. A domain is aligned to its profile by its start, at
    its whole length; the end that a shorter one misses is gaps."""
    doms = written(hits.extract_domains(curated, sequences).select(F.col("target").alias("seq_id"), F.col("domain").alias("seq")), "domains")
    groups = written(clusters.greedy_cluster(doms), "domain-clusters")
    aln = groups.join(doms, F.col("member") == F.col("seq_id")).select(F.col("rep").alias("aln_id"), "seq_id", F.col("seq").alias("aligned"))
    built = written(profiles.build(aln), "profiles")
    scores = search.search(built, doms).groupBy("profile", "target").agg(F.max("score").alias("score"))
    own = scores.join(groups.select(F.col("member").alias("target"), F.col("rep").cast("string").alias("profile")), ["profile", "target"])
    return built, written(own.groupBy("profile").agg(F.min("score").alias("threshold")), "thresholds")


def run(spark: SparkSession, first_profiles: DataFrame, first_thresholds: DataFrame, sequences: DataFrame, iters: int = 5, share: float | None = None, most: int = 10):
    """Iterate. Returns the table of hits by iteration and the last profiles and thresholds."""
    prof, thr, seen = first_profiles, first_thresholds, None
    for k in range(most if share is not None else iters):
        found = written(search.search(prof, sequences).withColumn("ord", F.xxhash64("profile", "target", "env_s", "hmm_s")), f"hits-{k}")
        curated = written(hits.curate(found, thr), f"curated-{k}")
        now = curated.select(F.lit(k).alias("iter"), F.col("target").alias("seq_id"))
        seen = now if seen is None else seen.unionByName(now)
        n = curated.count()
        LOG.info("iteration %d: %d sequences", k, n)
        if share is not None and k >= 2 and convergence(seen, share).filter(F.col("iter") == k).first().converged:
            break
        if not n:
            break
        made, bounds = new_profiles(curated, sequences)
        if bounds.isEmpty():
            break
        prof, thr = made, bounds
    return seen, prof, thr


def main(argv: list[str] | None = None) -> None:
    from cladewise.sources import formats

    p = argparse.ArgumentParser(description="Iterative profile curation of a sequence database")
    p.add_argument("--name", required=True)
    p.add_argument("--profile", nargs=2, action="append", metavar=("FILE", "THRESHOLD"), required=True)
    p.add_argument("--db", required=True, help="FASTA files, a folder or a glob")
    p.add_argument("--iters", type=int, default=5)
    p.add_argument("--conv-prop", type=float)
    p.add_argument("--max-iters", type=int, default=10)
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(a.name).getOrCreate()
    tables = [(formats.profile_text(spark, f), float(t)) for f, t in a.profile]
    prof = tables[0][0]
    for t, _ in tables[1:]:
        prof = prof.unionByName(t)
    thr = None
    for t, bound in tables:
        part = t.select("profile").distinct().withColumn("threshold", F.lit(bound))
        thr = part if thr is None else thr.unionByName(part)
    seen, prof, thr = run(spark, prof, thr, formats.fasta(spark, a.db), a.iters, a.conv_prop, a.max_iters)
    seen.write.parquet(f"{a.out}/{a.name}/hits")
    prof.write.parquet(f"{a.out}/{a.name}/profiles")
    thr.write.parquet(f"{a.out}/{a.name}/thresholds")


if __name__ == "__main__":
    main()
