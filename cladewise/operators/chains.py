"""Ordered chaining of domain hits, and scores of chains.

A chain is a run of hits of one profile on one target, in target order, whose
places on the profile follow each other within a tolerance. The hits of a
(profile, target) are one sorted array, bounded by the target's length, and
chaining is a fold over it: everything stays in DataFrame functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.session import written

HIT = "struct<start:int,ord:bigint,end:int,hmm_s:int,hmm_e:int,score:double>"


def covered(hits: Column) -> Column:
    """Different profile positions under the hits of an array."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["hmm_s"].alias("s"), h["hmm_e"].alias("e"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(-(1 << 31)).alias("reach"))

    def add(a: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0), x["e"] - F.greatest(x["s"] - 1, a["reach"]))
        return F.struct((a["n"] + fresh).cast("int").alias("n"), F.greatest(a["reach"], x["e"]).alias("reach"))

    return F.aggregate(spans, none, add, lambda a: a["n"])


def chained(hits: Column, tol: Column) -> Column:
    """Chains (arrays of hits) of a sorted array of hits, in the order in which they end.

    The state of the fold is the chains that have ended, the current one, and a
    rival, begun by a hit that could not follow the current chain. A hit also
    follows the rival if it comes after the rival's first hit. Where the hit
    follows the current chain, the rival ends, or takes over if it has several
    hits and covers more of the profile; where it does not, a rival takes over,
    and the hit begins a new rival unless it is in the old one.
    """
    no_hits, no_chains = F.array().cast(f"array<{HIT}>"), F.array().cast(f"array<array<{HIT}>>")

    def step(state: Column, h: Column) -> Column:
        ended, current, rival = state["ended"], state["current"], state["rival"]
        after_rival = (F.size(rival) > 0) & (h["hmm_s"] >= F.get(rival, 0)["hmm_e"] - tol)
        rival = F.when(after_rival, F.concat(rival, F.array(h))).otherwise(rival)
        several, some = F.size(rival) > 1, F.size(rival) > 0
        follows = h["hmm_s"] >= F.element_at(current, -1)["hmm_e"] - tol
        grown = F.concat(current, F.array(h))
        overtaken = several & (covered(rival) > covered(grown))
        ends = F.when(follows, F.when(overtaken, grown).when(some, rival)).when(some, current)
        return F.struct(
            F.when(ends.isNotNull(), F.concat(ended, F.array(ends))).otherwise(ended).alias("ended"),
            F.when(follows & ~overtaken, grown).when(some, rival).otherwise(current).alias("current"),
            F.when(follows | several, no_hits).otherwise(F.array(h)).alias("rival"),
        )

    begin = F.struct(no_chains.alias("ended"), F.slice(hits, 1, 1).alias("current"), no_hits.alias("rival"))
    return F.aggregate(F.slice(hits, F.lit(2), F.size(hits)), begin, step, lambda s: F.filter(F.concat(s["ended"], F.array(s["current"], s["rival"])), lambda c: F.size(c) > 0))


def weighted(hits: Column) -> Column:
    """Scores spread evenly over a hit's positions; a position shared by several
    hits of the chain counts once, on the profile and on the target; the mean of both."""

    def on(first: str, last: str) -> Column:
        cuts = F.array_sort(F.array_distinct(F.concat(F.transform(hits, lambda h: h[first]), F.transform(hits, lambda h: h[last] + 1))))
        pieces = F.arrays_zip(F.slice(cuts, F.lit(1), F.size(cuts) - 1).alias("x"), F.slice(cuts, F.lit(2), F.size(cuts)).alias("y"))

        def piece(total: Column, c: Column) -> Column:
            here = F.filter(hits, lambda h: (h[first] <= c["x"]) & (h[last] >= c["y"] - 1))
            dealt = F.aggregate(here, F.lit(0.0), lambda s, h: s + h["score"] / (h[last] - h[first] + 1))
            return total + F.when(F.size(here) > 0, dealt * (c["y"] - c["x"]) / F.size(here)).otherwise(0.0)

        return F.aggregate(pieces, F.lit(0.0), piece)

    return (on("hmm_s", "hmm_e") + on("start", "end")) / 2


def chains(hits: DataFrame, lengths: DataFrame, tolerance: float = 0.1, start: str = "env_s", end: str = "env_e") -> DataFrame:
    """profile, target, chain_no, hits (array), span_s, span_e, coverage, score.

    hits: profile, target, score, hmm_s, hmm_e, ord and the region columns.
    lengths: profile, len. Each chain's score is the sum of its hits' scores,
    each hit's share at a profile or target position dealt among the chain's
    hits there, as the mean of the two deals. The lengths are written, as Spark
    broadcasts a table whose size it knows; chaining keeps the tasks of the targets then.
    """
    one = F.struct(F.col(start).alias("start"), "ord", F.col(end).alias("end"), "hmm_s", "hmm_e", "score").cast(HIT)
    groups = hits.groupBy("profile", "target").agg(F.array_sort(F.collect_list(one)).alias("hits")).join(written(lengths, "profile-lengths"), "profile")
    each = groups.select("profile", "target", F.posexplode(chained(F.col("hits"), F.lit(float(tolerance)) * F.col("len"))).alias("chain_no", "hits"))
    span_s, span_e = F.array_min(F.transform("hits", lambda h: h["start"])), F.array_max(F.transform("hits", lambda h: h["end"]))
    return each.select("profile", "target", "chain_no", "hits", span_s.alias("span_s"), span_e.alias("span_e"), covered(F.col("hits")).alias("coverage"), weighted(F.col("hits")).alias("score"))


def best_chain(chained: DataFrame) -> DataFrame:
    """The best-scoring chain of each (profile, target)."""
    rest = ["chain_no", "span_s", "span_e", "coverage", "score"]
    got = chained.groupBy("profile", "target").agg(F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col("chain_no"))).alias("b"))
    return got.select("profile", "target", "b.*")


def _matched(paths: list[str], hmm: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path, place on the profile, place on the target and letter (a byte) of every matched residue of the paths."""
    raw = [(p or "").encode("ascii", "replace") for p in paths]
    n = np.array([len(p) for p in raw], np.int64)
    x = np.frombuffer(b"".join(raw), np.uint8)
    owner, first = np.repeat(np.arange(len(raw)), n), np.cumsum(n) - n
    gone, match = x == ord("-"), (x >= ord("A")) & (x <= ord("Z"))
    some = np.flatnonzero(match)
    at = owner[some]

    def place(step: np.ndarray, before: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(step)])
        return before[at] - 1 + upto[some + 1] - upto[first[at]]

    return at, place(match | gone, hmm), place(~gone, start), x[some]


def _numbers(x: pa.Table, column: str) -> np.ndarray:
    """A number for each different value (null is one)."""
    return x.column(column).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _chain_scores(x: pa.Table, odds: pa.Table) -> pa.Table:
    """target, chain_no, span_s, span_e, score of the chains of one profile that x holds whole; odds: pos, aa, raw (lists) in one row, or none."""
    if not x.num_rows:
        return x.select(["profile", "target", "chain_no", "start", "end", "score"]).rename_columns(["profile", "target", "chain_no", "span_s", "span_e", "score"])
    no = _numbers(x, "chain_no")
    _, first, chain = np.unique(_numbers(x, "target") * (int(no.max(initial=0)) + 1) + no, return_index=True, return_inverse=True)
    owner, hp, tp, aa = _matched(x.column("a2m").to_pylist(), x.column("hmm_s").to_numpy(), x.column("start").to_numpy())
    pos, letter, value = (odds.column(c).combine_chunks().flatten() for c in ("pos", "aa", "raw")) if odds.num_rows else ([], [], [])
    raw = np.zeros(len(owner))
    if len(pos):
        pos, letter = pos.to_numpy(), np.array([ord(a) if len(a) == 1 else 0 for a in letter.to_pylist()], np.int64)
        place = pos.astype(np.int64) * 256 + np.minimum(letter, 255)
        order = np.argsort(place)
        want = hp * 256 + aa
        at = np.minimum(np.searchsorted(place[order], want), len(place) - 1)
        raw = np.where(place[order][at] == want, value.to_numpy(zero_copy_only=False)[order][at], 0.0)
    # Hits of a chain that share an ord are one: one sum of odds, the mean of their scores, and each residue for each of them.
    ord_ = _numbers(x, "ord")
    _, hit = np.unique(chain * (int(ord_.max()) + 1) + ord_, return_inverse=True)
    same = np.bincount(hit)
    total, mean = np.bincount(hit[owner], raw, len(same)), np.bincount(hit, x.column("score").to_numpy()) / same
    some = np.abs(total) > 1e-12
    scale = np.where(some, mean / np.where(some, total, 1.0), 0.0)
    part, of, weight, score = raw * scale[hit[owner]], chain[owner], same[hit[owner]], np.zeros(len(first))
    known = ~np.isnan(part)  # a hit without a score
    hp, tp, part, of, weight = hp[known], tp[known], part[known], of[known], weight[known]
    for side in (hp, tp):
        low = int(side.min(initial=1 << 31))
        width = max(int(side.max(initial=0)) - low + 1, 1)
        spot, inverse = np.unique(of * width + (side - low), return_inverse=True)
        score += np.bincount(spot // width, np.bincount(inverse, part * weight, len(spot)) / np.bincount(inverse, weight, len(spot)), len(first))
    spans = pa.table({"c": chain, "s": x.column("start"), "e": x.column("end")}).group_by("c").aggregate([("s", "min"), ("e", "max")]).sort_by("c")
    head = x.select(["profile", "target", "chain_no"]).take(pa.array(first))
    return head.append_column("span_s", spans.column("s_min")).append_column("span_e", spans.column("e_max")).append_column("score", pa.array(score / 2))


#: Bytes of hits that are scored at once.
GROUP_BYTES = 2 << 20


def residue_scores(hits: DataFrame, emissions: DataFrame, background: DataFrame, start: str = "env_s", end: str = "env_e", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """profile, target, chain_no, span_s, span_e, score of chains whose hits have paths.

    hits: profile, target, chain_no, ord (tells a chain's hits apart), score, hmm_s, a2m
    and the region columns. emissions: profile, pos, aa, nlp; background: profile, aa, nlp.
    Each matched residue has the log-odds of its emission; a hit's residues are scaled
    so that they add up to its score (all 0 if either sum is 0). Residues at one place
    of the profile count by their mean, and likewise on the target; the score is half of
    the sum over both. A residue without an emission counts as 0.

    What travels is hits with their paths, once, in groups of some whole chains of one
    profile, and the profile's odds to each of its groups. Residues are made and used inside a group.
    """
    key = ["profile", "target", "chain_no"]
    odds = emissions.select("profile", "pos", "aa", "nlp").join(background.select("profile", "aa", F.col("nlp").alias("b")), ["profile", "aa"])
    odds = odds.groupBy("profile").agg(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), "aa", (F.col("b") - F.col("nlp")).alias("raw"))).alias("o"))
    odds = odds.select("profile", "o.pos", "o.aa", "o.raw")
    size = F.coalesce(F.length("a2m"), F.lit(0)) + 64
    # Few rows, written so that Spark knows their size.
    parts = written(hits.groupBy("profile").agg(F.ceil(F.sum(size) / group_bytes).cast("int").alias("parts")), "chain-groups")
    rest = ["ord", F.col("hmm_s").cast("bigint").alias("hmm_s"), F.col(start).alias("start"), F.col(end).alias("end"), "a2m", F.col("score").cast("double").alias("score")]
    dealt = hits.select(*key, *rest).join(parts.withColumnRenamed("profile", "_p"), F.col("profile").eqNullSafe(F.col("_p")))
    dealt = dealt.select(*key, "ord", "hmm_s", "start", "end", "a2m", "score", F.pmod(F.xxhash64("target", "chain_no"), F.col("parts")).cast("int").alias("part"))
    given = odds.join(parts, "profile").select("profile", "pos", "aa", "raw", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    kinds = hits.select(*key, F.col(start).alias("span_s"), F.col(end).alias("span_e")).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields) + ", score double"
    return dealt.groupBy("profile", "part").cogroup(given.groupBy("profile", "part")).applyInArrow(_chain_scores, schema)
