"""Command line of the run from profiles to a tree."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cladewise.plans import phylo
from cladewise.session import written
from cladewise.sources import formats, reports


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="A tree of the representatives of what profiles find")
    p.add_argument("--profile", nargs=2, action="append", metavar=("FILE", "THRESHOLD"), required=True)
    p.add_argument("--db", required=True, help="FASTA files, a folder or a glob")
    p.add_argument("--out", required=True)
    p.add_argument("--name", default="run")
    p.add_argument("--mode", choices=["dom", "chain"], default="dom")
    p.add_argument("--bounds", nargs=2, type=float, action="append", metavar=("IDENTITY", "COVERAGE"), help="of each level, the finest first")
    p.add_argument("--samples", type=int, default=3)
    p.add_argument("--most", type=int, default=500, help="representatives in the tree at most")
    p.add_argument("--level", type=int)
    p.add_argument("--share", type=float, default=0.01, help="share of the worst rows to leave out")
    p.add_argument("--gt", type=float, default=0.1, help="least occupancy of a column")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(a.name).getOrCreate()
    tables = [formats.profile_text(spark, f).withColumn("ord", F.lit(i)).withColumn("threshold", F.lit(float(t))) for i, (f, t) in enumerate(a.profile)]
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    both = written(both, "profiles")
    given = {"bounds": tuple(map(tuple, a.bounds))} if a.bounds else {}
    got = phylo.profiles_to_tree(both.drop("ord", "threshold"), both.select("profile", "threshold", "ord").distinct(), formats.fasta(spark, a.db), a.mode, samples=a.samples, most=a.most, level=a.level, share=a.share, gt=a.gt, **given)
    for name in ("curated", "domains", "unaligned", "rejected", "alignment", "tree"):
        getattr(got, name).write.parquet(f"{a.out}/{name}")
    got.found.clusters.write.parquet(f"{a.out}/clusters")
    if got.found.maps is not None:  # more than one level
        got.found.maps.write.parquet(f"{a.out}/maps")
        reports.write_report(reports.level_report(got.found, a.name), f"{a.out}/levels")
    spark.createDataFrame([(got.newick,)], "value string").coalesce(1).write.text(f"{a.out}/newick")


if __name__ == "__main__":
    main()
