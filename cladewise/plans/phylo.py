"""Between profiles and trees: profiles of the clades of a tree that stand on their own, and a tree of what profiles find."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators import aln, chains, clades, clusters, hits, holdout, levels, rooting, search, trees
from cladewise.session import written


@dataclass
class Clades:
    """tree: rooted node table. kept: supported nodes. clades: clade, n_leaves, n_pass.
    leaves: clade, seq_id that pass. profiles and thresholds by clade. Annotations: seq_id, field, value, priority."""

    tree: DataFrame
    kept: DataFrame
    clades: DataFrame
    leaves: DataFrame
    profiles: DataFrame
    thresholds: DataFrame

    def annotations(self) -> DataFrame:
        return self.leaves.select("seq_id", F.lit("pHMM_clades").alias("field"), F.col("clade").alias("value"), F.lit(0).alias("priority"))


def rooted(tree: DataFrame, strategy: str | None, outgroup: list[str] | None = None, inside: str | None = None) -> DataFrame:
    if strategy == "midpoint":
        return rooting.midpoint_root(tree)
    if strategy == "longest":
        return rooting.longest_branch_root(tree)
    if strategy == "outgroup":
        return rooting.outgroup_root(tree, outgroup or [], inside)
    if strategy is not None:
        raise ValueError(f"no such way of rooting: {strategy}")
    return tree


def tree_to_profiles(
    tree: DataFrame, aln: DataFrame, reroot: str | None = "midpoint", outgroup: list[str] | None = None, inside: str | None = None,
    min_support: float = 90, min_prop: float = 0.0, max_prop: float = 0.5, max_holdout: float = 0.5, pass_score: float = 0.9, min_pass: float = 0.75, beat: float = 0.2,
    options: search.Options | None = None,
) -> Clades:
    """Supported clades of the rooted tree that pass the hold-out run, their profiles over
    the leaves that pass, and thresholds from the leaves outside.

    tree: a node table with unique names; aln: seq_id (leaf), aligned. Supports of 0 to 1
    are told from per cents. A clade whose profile hits nothing outside has no threshold
    row; any hit is above it.
    """
    tree = written(rooted(trees.percent_supports(tree), reroot, outgroup, inside), "rooted-tree")
    kept = written(trees.supported_partition(tree, min_support, min_prop, max_prop).select("name"), "supported")
    passed, good = holdout.robust_leaves(tree, aln, kept, pass_score, min_pass, max_share=max_holdout)
    names = passed.select("clade")
    made = written(clades.clade_profiles(tree, aln, names, include=good.select("clade", F.col("name").alias("seq_id"))), "clade-profiles")
    found = search.search(made, clades.ungapped(aln), options=options)
    bounds = written(clades.clade_thresholds(tree, found.select("profile", "target", "score"), beat), "clade-thresholds")
    return Clades(tree, kept, passed, good.select("clade", F.col("name").alias("seq_id")), made, bounds)


@dataclass
class Tree:
    """curated: target, profile, score, env_s, env_e, n_profiles. domains: target, seq, domain.
    found: the levels of clustering, level: the one whose representatives are in the tree.
    unaligned: representatives (seq_id) that the leading profile does not hit. rejected: seq_id, why.
    alignment: seq_id, aligned (trimmed). tree: its node table; newick: its text."""

    curated: DataFrame
    domains: DataFrame
    found: levels.Levels
    level: int
    unaligned: DataFrame
    rejected: DataFrame
    alignment: DataFrame
    tree: DataFrame
    newick: str


def curated_chains(found: DataFrame, profiles: DataFrame, thresholds: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Curation by best chains of hits; thresholds stand in order of their names unless they have an ord."""
    lengths = profiles.groupBy("profile").agg(F.max("pos").alias("len"))
    order = thresholds if "ord" in thresholds.columns else thresholds.withColumn("ord", F.lit(0))
    numbered = found.withColumn("ord", F.xxhash64("env_s", "env_e", "hmm_s", "hmm_e"))
    return hits.curate_chains(chains.best_chain(chains.chains(numbered, lengths, tolerance)), order)


def on_profile(profile: DataFrame, domains: DataFrame, options: search.Options | None = None) -> DataFrame:
    """Domains (seq_id, seq) by the columns of one profile: seq_id, aligned. Insertions are left out,
    columns before and after the best hit are gaps; a domain without a hit has no row."""
    found = search.search(profile, domains, options=options)
    best = found.groupBy("target").agg(F.max_by(F.struct("hmm_s", "a2m"), F.struct("score", -F.col("hmm_s"), -F.col("env_s"))).alias("b"))
    width = profile.agg(F.max("pos").alias("width"))
    row = F.rpad(F.concat(F.repeat(F.lit("-"), F.col("b.hmm_s") - 1), F.regexp_replace("b.a2m", "[a-z]", "")), F.col("width"), F.lit("-"))
    return best.crossJoin(F.broadcast(width)).select(F.col("target").alias("seq_id"), row.alias("aligned"))


def profiles_to_tree(
    profiles: DataFrame, thresholds: DataFrame, sequences: DataFrame, mode: str = "dom", bounds: tuple[tuple[float, float], ...] = ((0.99, 0.95), (0.9, 0.9), (0.7, 0.8), (0.5, 0.8)),
    samples: int = 3, most: int = 500, level: int | None = None, share: float = 0.01, gt: float = 0.1, options: search.Options | None = None,
) -> Tree:
    """Search, curate (best domains or chains), cluster the domains in levels, take the representatives of the
    first level with at most ``most`` clusters (or of ``level``), align them by the columns of the profile
    with most targets, drop odd rows and sparse columns, and join neighbours.

    The tree is made on the driver, so more than ``most`` representatives are refused
    before anything of them is collected. sequences: seq_id (string), seq. Pairs without a common
    column have distance 1.
    """
    if mode not in ("dom", "chain"):
        raise ValueError(f"no such way of curation: {mode}")
    found = written(search.search(profiles, sequences, options=options), "hits")
    if mode == "dom":
        curated = hits.curate(found.withColumn("ord", F.xxhash64("env_s", "env_e", "hmm_s")), thresholds)
    else:
        curated = curated_chains(found, profiles, thresholds)
    curated = written(curated, "curated")
    domains = written(hits.extract_domains(curated, sequences), "domains")
    given = domains.select(F.col("target").alias("seq_id"), F.col("domain").alias("seq"))
    cascade = levels.cascade_levels(given, bounds[0], list(bounds[1:]), samples)
    k = clusters.level_pick(cascade.clusters, most).first().level if level is None else level
    if k is None:
        raise ValueError("nothing was found that reaches its threshold")
    reps = written(cascade.clusters.filter(F.col("level") == k).select(F.col("rep").alias("seq_id")).distinct(), "reps")
    n = reps.count()
    if n > most:
        raise ValueError(f"level {k} has {n} clusters, more than {most}")
    lead = curated.groupBy("profile").agg(F.count("*").alias("n")).agg(F.min_by("profile", F.struct(-F.col("n"), F.col("profile"))).alias("profile"))
    placed = written(on_profile(profiles.join(F.broadcast(lead), "profile", "left_semi"), given.join(reps, "seq_id", "left_semi"), options), "placed")
    one = placed.withColumn("aln_id", F.lit("tree"))
    rejected = written(aln.qc_rejects(one, gt, share).select("seq_id", "why"), "rejected")
    good = one.join(rejected, "seq_id", "left_anti")
    kept = aln.kept_columns(good, gt)
    gone = aln.occupancy(good).join(kept, ["aln_id", "col"], "left_anti").select("aln_id", "col")
    trimmed = written(aln.without_columns(good, gone).select("aln_id", "seq_id", "aligned"), "trimmed")
    names = [r.seq_id for r in trimmed.select("seq_id").orderBy("seq_id").collect()]
    at = {x: i for i, x in enumerate(names)}
    dist = [[0.0 if i == j else 1.0 for j in range(len(names))] for i in range(len(names))]
    for r in aln.pair_stats(trimmed).select("a", "b", "identity").filter("identity IS NOT NULL").toLocalIterator():
        dist[at[r.a]][at[r.b]] = dist[at[r.b]][at[r.a]] = 1.0 - r.identity
    if not names:
        raise ValueError("no representative is left for the tree")
    root = trees.label_inner(trees.neighbour_joining(names, dist))
    nodes = sequences.sparkSession.createDataFrame(trees.node_rows(root), trees.NODE_SCHEMA)
    return Tree(curated, domains, cascade, k, reps.join(placed, "seq_id", "left_anti"), rejected, trimmed.select("seq_id", "aligned"), nodes, trees.to_newick(root, supports=False))


def main(argv: list[str] | None = None) -> None:
    from cladewise.sources import formats

    p = argparse.ArgumentParser(description="Profiles of the robust clades of a tree")
    p.add_argument("--tree", required=True, help="a Newick file")
    p.add_argument("--aln", required=True, help="the alignment of its leaves, FASTA")
    p.add_argument("--out", required=True)
    p.add_argument("--root", choices=["midpoint", "longest", "outgroup", "none"], default="midpoint")
    p.add_argument("--outgroup", nargs="*", default=[])
    p.add_argument("--inside")
    p.add_argument("--min-support", type=float, default=90)
    p.add_argument("--max-prop", type=float, default=0.5)
    p.add_argument("--pass-score", type=float, default=0.9)
    p.add_argument("--min-pass", type=float, default=0.75)
    p.add_argument("--beat", type=float, default=0.2)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tree-to-profiles").getOrCreate()
    tree = trees.read_newick(spark, a.tree).drop("file")
    aln = formats.fasta(spark, a.aln).select("seq_id", F.col("seq").alias("aligned"))
    got = tree_to_profiles(written(tree, "tree"), aln, None if a.root == "none" else a.root, a.outgroup, a.inside, a.min_support, 0.0, a.max_prop, 0.5, a.pass_score, a.min_pass, a.beat)
    for name in ("tree", "clades", "leaves", "profiles", "thresholds"):
        getattr(got, name).write.parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    main()
