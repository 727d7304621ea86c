"""Identity of pairs of sequences after aligning each pair anew, end to end.

Of the alignments with the best score (affine gaps) the one with most equal pairs
counts, and of those the one with most pairs of residues: so identity does not depend
on the order in which cells are visited. Score, equal pairs and pairs are one whole
number each cell, as all three only add up; two rows of cells are held, not a path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.session import bounded_batches


#: Cells of one row of pairs that are aligned at once.
CELLS = 1 << 14


@dataclass(frozen=True)
class Scoring:
    """Whole scores: equal and different residues, the first and further places of a gap."""

    same: int = 5
    other: int = -4
    opening: int = 12
    extension: int = 2


def counts(one: str, two: str, s: Scoring = Scoring()) -> tuple[int, int]:
    """(equal pairs, pairs of residues) of the best alignment of two sequences."""
    return counts_of([(one, two)], s)[0]


def counts_of(pairs: list[tuple[str, str]], s: Scoring = Scoring()) -> list[tuple[int, int]]:
    """The same of many pairs, those of like length at once."""
    sides = [(x, y) if len(x) <= len(y) else (y, x) for x, y in pairs]
    order = sorted(range(len(sides)), key=lambda k: (len(sides[k][0]), len(sides[k][1])))
    out: list[tuple[int, int]] = [(0, 0)] * len(sides)
    while order:
        # From the longest shorter side down; a long pair is alone.
        take = max(1, CELLS // (len(sides[order[-1]][0]) + 1))
        mine, order = order[-take:], order[:-take]
        for k, got in zip(mine, _together([sides[k] for k in mine], s)):
            out[k] = got
    return out


def _together(sides: list[tuple[str, str]], s: Scoring) -> list[tuple[int, int]]:
    """Rows go along the longer sequences, columns along the shorter ones, one line of cells a pair.

    A cell depends on those before it alone, so what follows a pair's end does no harm."""
    p, n, m = len(sides), max(len(x) for x, _ in sides), max(len(y) for _, y in sides)
    bits = (n + 1).bit_length()
    most = (n + m + 2) * max(abs(s.same), abs(s.other), s.opening, s.extension)
    # Very long sequences overflow 64 bits: whole numbers of any size, slower.
    kind = np.int64 if 2 * bits + most.bit_length() + 2 < 63 else object
    unit = 1 << 2 * bits
    a, b = (np.zeros((p, width), np.uint32) for width in (n, m))
    for k, (x, y) in enumerate(sides):
        a[k, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        b[k, : len(y)] = np.frombuffer(y.encode("utf-32-le"), np.uint32)
    opening, extension = s.opening * unit, s.extension * unit
    equal, differ = np.array(s.same * unit + (1 << bits) + 1, kind), np.array(s.other * unit + 1, kind)
    slope = np.arange(n + 1).astype(kind) * extension
    h = np.zeros((p, n + 1), kind)
    h[:, 1:] = -opening - slope[:n]
    down = np.full((p, n + 1), -4 * most * unit if kind is object else -(1 << 62), kind)
    rows, columns = (np.array([len(x[k]) for x in sides]) for k in (1, 0))
    last = h[np.arange(p), columns]
    for r in range(m):
        down = np.maximum(h - opening, down - extension)
        here = down.copy()
        here[:, 1:] = np.maximum(h[:, :-1] + np.where(a == b[:, r, None], equal, differ), down[:, 1:])
        reach = np.maximum.accumulate(here + slope, axis=1) - slope
        here[:, 1:] = np.maximum(here[:, 1:], reach[:, :-1] - opening)
        h = here
        over = np.flatnonzero(rows == r + 1)
        last[over] = h[over, columns[over]]
    mask = (1 << bits) - 1
    return [((int(x) >> bits) & mask, int(x) & mask) for x in last]


def pair_identities(seqs: DataFrame, pairs: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """a, b, n_same, n_both, identity of the given pairs (a, b) of sequences (seq_id, seq).

    Pairs whose side has no sequence are left out; null counts as empty; identity is
    null where no residues are paired. Work is the product of the lengths, so it is
    given by the pairs: ``within`` makes those of each group.
    """
    bounded_batches(seqs.sparkSession)
    kind = seqs.schema["seq_id"].dataType.simpleString()
    one, two = (seqs.select(F.col("seq_id").alias(c), F.coalesce("seq", F.lit("")).alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = counts_of(list(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())), scoring)
            sides = [pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sides], names=["a", "b", "n_same", "n_both"])

    # Little data, much work: a given number of partitions is not merged by adaptive execution.
    spark = seqs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").repartition(tasks, "a", "b")
    found = met.mapInArrow(run, f"a {kind}, b {kind}, n_same bigint, n_both bigint")
    return found.withColumn("identity", F.when(F.col("n_both") > 0, F.col("n_same") / F.col("n_both")))


def within(groups: DataFrame) -> DataFrame:
    """a, b (a < b): all pairs of the sequences of each group (grp, seq_id). A matrix of n sequences has n (n - 1) / 2."""
    a, b = (groups.select("grp", F.col("seq_id").alias(c)) for c in "ab")
    return a.join(b, "grp").filter("a < b").select("a", "b").distinct()
