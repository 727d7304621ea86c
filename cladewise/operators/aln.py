"""Alignment column algebra over rows (aln_id, seq_id, aligned).

A row shorter than its alignment ends in gaps. Only residues are exploded into
cells, with map-side counts per (alignment, column, residue), so what travels
is bounded by columns and alphabet, not by rows x columns. Per-row figures come
from one array of column statistics for each alignment, which the rows are
joined with; no residue is shuffled for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.operators.ranges import running
from cladewise.operators.seqs import ALPHABET, worst_share
from cladewise.session import bounded_batches, written

GAP = "-"


def cells(aln: DataFrame) -> DataFrame:
    """aln_id, seq_id, col (from 0), ch for every written cell."""
    return aln.filter(F.length("aligned") > 0).select("aln_id", "seq_id", F.posexplode(F.split("aligned", "")).alias("col", "ch"))


def rows_of(aln: DataFrame) -> DataFrame:
    return aln.groupBy("aln_id").agg(F.count("*").alias("n"), F.max(F.length("aligned")).alias("width"))


#: Letters that are counted by name; any other written character is ODD, and ABSENT is none.
_CODE = np.full(128, len(ALPHABET), np.int64)
for _i, _a in enumerate(ALPHABET):
    _CODE[ord(_a)] = _i
_CODE[ord(GAP)] = len(ALPHABET) + 1
_KINDS = len(ALPHABET) + 2
#: Counts that a task holds at once; columns of one piece of a row; residues of one group of pieces.
HELD, PIECE, GROUP = 1 << 23, 4096, 1 << 24


def _codes(aligned: str) -> np.ndarray:
    """The characters of a row as numbers: letters of the alphabet by place, then any other one, then the gap."""
    x = np.frombuffer(aligned.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, _CODE[np.minimum(x, 127)], len(ALPHABET))


def column_counts(aln: DataFrame) -> DataFrame:
    """aln_id, col (from 0), counts: written cells by letter, then other characters, then gaps.

    Every task counts its own rows, so only columns travel."""
    kind = aln.schema["aln_id"].dataType.simpleString()
    none = np.zeros((0, _KINDS), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for (of, start), n in held.items():
                some = np.flatnonzero(n.any(axis=1))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(n[some].ravel()), _KINDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(some), ids.type), pa.array((some + start).astype(np.int32)), lists], names=["aln_id", "col", "counts"])
            held.clear()

        for batch in batches:
            ids = batch.column("aln_id")
            for of, text in zip(ids.to_pylist(), batch.column("aligned").to_pylist()):
                code = _codes(text)
                for at in range(0, len(code), PIECE):
                    part = code[at : at + PIECE]
                    n = held.get((of, at), none)
                    if len(n) < len(part):
                        if size > HELD:
                            yield from out()
                            n, size = none, 0
                        wider = np.zeros((1 << (len(part) - 1).bit_length(), _KINDS), np.int64)
                        wider[: len(n)] = n
                        size += wider.size - n.size
                        held[of, at] = n = wider
                    n[np.arange(len(part)), part] += 1
        if held:
            yield from out()

    bounded_batches(aln.sparkSession)
    got = aln.filter(F.length("aligned") > 0).select("aln_id", "aligned").mapInArrow(run, f"aln_id {kind}, col int, counts array<bigint>")
    sums = got.groupBy("aln_id", "col").agg(*[F.sum(F.col("counts")[i]).alias(f"_{i}") for i in range(_KINDS)])
    return sums.select("aln_id", "col", F.array(*[f"_{i}" for i in range(_KINDS)]).alias("counts"))


def occupancy(aln: DataFrame) -> DataFrame:
    """Per column of each alignment: residues, rows and the share of rows with a residue."""
    filled = column_counts(aln).select("aln_id", "col", F.aggregate(F.slice("counts", 1, _KINDS - 1), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("filled"))
    return filled.join(rows_of(aln), "aln_id").select("aln_id", "col", "filled", "n", (F.col("filled") / F.col("n")).alias("occupancy"))


def gap_only_columns(aln: DataFrame) -> DataFrame:
    return occupancy(aln).filter("filled = 0").select("aln_id", "col")


def without_columns(aln: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without the given columns (aln_id, col). A row is rebuilt from its own characters."""
    lists = gone.groupBy("aln_id").agg(F.array_sort(F.collect_set("col")).alias("gone"))
    # The columns to drop as a string of marks, so that each row is one pass.
    chars = F.filter(F.split("aligned", ""), lambda c, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return aln.join(lists, "aln_id", "left").select("aln_id", "seq_id", F.array_join(chars, "").alias("aligned"))


def kept_columns(aln: DataFrame, gt: float) -> DataFrame:
    """Columns whose occupancy is at least gt."""
    return occupancy(aln).filter(F.col("occupancy") >= gt).select("aln_id", "col")


def trim_stats(aln: DataFrame, gt: float) -> DataFrame:
    """Per row: per cent of its residues that stay when columns under gt go, and
    per cent of gaps in what is left of it."""
    at = written(kept_columns(aln, gt).groupBy("aln_id").agg(F.array_sort(F.collect_list("col")).alias("at")), "kept-columns")
    # One mark for each column up to the last kept one: a run of 0 for what goes, then 1.
    runs = F.transform("at", lambda c, i: F.concat(F.repeat(F.lit("0"), c - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.lit("1")))
    marks = written(at.select("aln_id", F.size("at").alias("kept_width"), F.split(F.array_join(runs, ""), "").alias("marks")), "column-marks")
    stays = F.zip_with(F.split("aligned", ""), F.slice("marks", F.lit(1), F.length("aligned")), lambda c, m: (m == "1") & (c != GAP) & (c != ""))
    j = aln.join(marks, "aln_id", "left").select(
        "aln_id", "seq_id", F.size(F.filter(stays, lambda x: x)).alias("stay"), "kept_width",
        F.length(F.replace("aligned", F.lit(GAP), F.lit(""))).alias("residues"),
    )
    stay, residues, kept = F.greatest("stay", F.lit(0)), F.coalesce("residues", F.lit(0)), F.coalesce("kept_width", F.lit(0))
    return j.select(
        "aln_id", "seq_id",
        F.when(residues > 0, 100.0 * stay / residues).otherwise(0.0).alias("retention"),
        F.when(kept > 0, 100.0 * (kept - stay) / kept).alias("gap_pc"),
    )


def mean_col_agreement(aln: DataFrame, min_occupancy: float = 0.5, letters: str = ALPHABET) -> DataFrame:
    """Per row: mean frequency of its residue over columns that are full enough; null where there is none.

    Rows are cut into pieces of some columns; pieces of one place meet the shares of
    these columns in groups of bounded size, and a piece leaves as a sum and a count.
    """
    counts = column_counts(aln).select("aln_id", "col", F.array(*[F.col("counts")[ALPHABET.index(x)] for x in letters]).alias("ks"))
    counts = counts.withColumn("all", F.aggregate("ks", F.lit(0).cast("bigint"), lambda a, x: a + x)).filter("all > 0")
    sizes = written(rows_of(aln), "row-counts")
    full = counts.join(sizes, "aln_id").filter(F.col("all") / F.col("n") >= min_occupancy)
    full = written(full.withColumn("place", F.expr(f"col div {PIECE}").cast("int")), "column-shares")
    # No piece beyond the last full column is asked for.
    ends = written(full.groupBy("aln_id", "n").agg(F.max("place").alias("last")), "last-places")
    # Pieces of a place, dealt over groups by row.
    deal = lambda n: F.ceil(n * PIECE / GROUP).cast("int")
    shares = full.select("aln_id", "place", "col", "ks", "all", F.explode(F.sequence(F.lit(0), deal(F.col("n")) - 1)).alias("part"))
    cut = aln.filter(F.length("aligned") > 0).join(ends, "aln_id")
    cut = cut.select("aln_id", "seq_id", "aligned", F.pmod(F.xxhash64("seq_id"), deal(F.col("n"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.least("last", F.expr(f"CAST((length(aligned) - 1) div {PIECE} AS INT)")))).alias("place"))
    cut = cut.select("aln_id", "seq_id", "part", "place", F.substring(F.col("aligned"), F.col("place") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    code = np.full(_KINDS, len(letters), np.int64)
    code[[ALPHABET.index(x) for x in letters]] = np.arange(len(letters))

    def sums(pieces: pa.Table, shares: pa.Table) -> pa.Table:
        s, n = np.zeros(pieces.num_rows), np.zeros(pieces.num_rows, np.int64)
        if pieces.num_rows and shares.num_rows:
            col = shares.column("col").to_numpy() % PIECE
            value, used = np.zeros((PIECE, len(letters) + 1)), np.zeros((PIECE, len(letters) + 1), np.int64)
            ks = shares.column("ks").combine_chunks().flatten().to_numpy().reshape(len(col), len(letters))
            value[col, :-1] = ks / shares.column("all").to_numpy()[:, None]
            used[col, :-1] = ks > 0
            for i, text in enumerate(pieces.column("piece").to_pylist()):
                x = code[_codes(text)]
                at = np.arange(len(x))
                s[i], n[i] = value[at, x].sum(), used[at, x].sum()
        return pieces.select(["aln_id", "seq_id"]).append_column("s", pa.array(s)).append_column("n", pa.array(n))

    key = ["aln_id", "place", "part"]
    kinds = ", ".join(f"{c} {aln.schema[c].dataType.simpleString()}" for c in ("aln_id", "seq_id"))
    got = cut.groupBy(*key).cogroup(shares.groupBy(*key)).applyInArrow(sums, f"{kinds}, s double, n bigint")
    means = got.groupBy("aln_id", "seq_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return aln.select("aln_id", "seq_id").join(means, ["aln_id", "seq_id"], "left").select("aln_id", "seq_id", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("agreement"))


def qc_rejects(aln: DataFrame, gt: float = 0.1, share: float = 0.01, letters: str = ALPHABET + GAP) -> DataFrame:
    """Rows to drop: foreign characters, or among the worst by retention or gaps."""
    odd = aln.filter(F.translate("aligned", letters, "") != "").select("aln_id", "seq_id", F.lit("alphabet").alias("why"))
    # Written once, as both choices read it several times.
    stats = written(trim_stats(aln, gt), "trim-stats")
    low = worst_share(stats, F.round("retention", 6), share, ["aln_id"], "seq_id").select("aln_id", "seq_id", F.lit("retention").alias("why"))
    high = worst_share(stats, F.round("gap_pc", 6), share, ["aln_id"], "seq_id", highest=True).select("aln_id", "seq_id", F.lit("gaps").alias("why"))
    return odd.union(low).union(high)


def qc_filter(aln: DataFrame, gt: float = 0.1, share: float = 0.01) -> DataFrame:
    return aln.join(qc_rejects(aln, gt, share), ["aln_id", "seq_id"], "left_anti")


def pairs(aln: DataFrame) -> DataFrame:
    """All pairs of rows inside one alignment, first row first."""
    a, b = (aln.select("aln_id", F.col("seq_id").alias(x), F.col("aligned").alias(f"s{x}")) for x in ("a", "b"))
    return a.join(b, "aln_id").filter("a < b")


def _aligned(p: Column) -> Column:
    return p["x"].isNotNull() & p["y"].isNotNull() & (p["x"] != GAP) & (p["y"] != GAP) & (p["x"] != "") & (p["y"] != "")


def pair_stats(aln: DataFrame) -> DataFrame:
    """Per pair: columns with two residues, equal ones, identity, and coverage of the shorter row."""
    return _stats(pairs(aln))


def _stats(p: DataFrame) -> DataFrame:
    p = p.select("aln_id", "a", "b", F.arrays_zip(F.split("sa", "").alias("x"), F.split("sb", "").alias("y")).alias("z"), *[F.length(F.replace(f"s{k}", F.lit(GAP), F.lit(""))).alias(f"n{k}") for k in "ab"])
    p = p.select("aln_id", "a", "b", F.size(F.filter("z", _aligned)).alias("n_both"), F.size(F.filter("z", lambda p: _aligned(p) & (p["x"] == p["y"]))).alias("n_same"), F.least("na", "nb").alias("shorter"))
    return p.select(
        "aln_id", "a", "b", "n_both", "n_same",
        F.when(F.col("n_both") > 0, F.col("n_same") / F.col("n_both")).alias("identity"), F.when(F.col("shorter") > 0, F.col("n_both") / F.col("shorter")).alias("coverage"),
    )


def t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t, by the continued fraction of the incomplete beta function."""
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    x = df / (df + t * t)
    if x >= 1:
        return 0.5

    def cf(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1.0 / ((1.0 + k * d) or 1e-300), (1.0 + k / c) or 1e-300
            h *= d * c
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1.0 / ((1.0 + k * d) or 1e-300), (1.0 + k / c) or 1e-300
            h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        inc = front * cf(a, b, x) / a
    else:
        inc = 1.0 - front * cf(b, a, 1.0 - x) / b
    return inc / 2 if t > 0 else 1 - inc / 2


def smart_trim_stats(aln: DataFrame, base_threshold: float = 0.05) -> DataFrame:
    """Columns under the occupancy threshold: Welch's t for the coverage of pairs
    that both have a residue there against all other pairs of the alignment."""
    low = occupancy(aln).filter(F.col("occupancy") < base_threshold).select("aln_id", "col")
    cov = pair_stats(aln).select("aln_id", "a", "b", F.coalesce("coverage", F.lit(0.0)).alias("v"))
    total = cov.groupBy("aln_id").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    here = cells(aln).filter(F.col("ch") != GAP).join(low, ["aln_id", "col"], "left_semi")
    x, y = (here.select("aln_id", "col", F.col("seq_id").alias(k)) for k in "ab")
    inside = x.join(y, ["aln_id", "col"]).filter("a < b").join(cov, ["aln_id", "a", "b"]).groupBy("aln_id", "col").agg(F.count("*").alias("n1"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("q1"))
    j = low.join(total, "aln_id").join(inside, ["aln_id", "col"], "left").na.fill(0, ["n1", "s1", "q1"])
    j = j.withColumns({"n2": F.col("n") - F.col("n1"), "s2": F.col("s") - F.col("s1"), "q2": F.col("q") - F.col("q1")})
    var = lambda k: (F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}")) / (F.col(f"n{k}") - 1) / F.col(f"n{k}")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    j = j.withColumns({"v1": F.when(ok, F.greatest(var(1), F.lit(0.0))), "v2": F.when(ok, F.greatest(var(2), F.lit(0.0)))})
    se = F.col("v1") + F.col("v2")
    t = F.when(se > 1e-12, (F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")) / F.sqrt(se))
    df = F.when(se > 1e-12, se * se / (F.col("v1") * F.col("v1") / (F.col("n1") - 1) + F.col("v2") * F.col("v2") / (F.col("n2") - 1)))
    return j.select("aln_id", "col", F.col("n1").cast("bigint").alias("n_in"), F.col("n2").cast("bigint").alias("n_out"), t.alias("t"), df.alias("df"))


def smart_trim_columns(aln: DataFrame, base_threshold: float = 0.05, p_threshold: float = 0.05) -> DataFrame:
    """Columns to trim: p >= p_threshold (a column without a p stays)."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_tail(x, y) if x == x and y == y else None for x, y in zip(t, df)], dtype="float64")

    s = smart_trim_stats(aln, base_threshold)
    return s.withColumn("p", p_value("t", "df")).filter(F.col("p") >= p_threshold).select("aln_id", "col", "p")


def map_cols(aln: DataFrame) -> DataFrame:
    """Of every residue: its index among its row's residues (from 0) and its column.

    Made inside each row, without a window over cells.
    """
    at = F.filter(F.transform(F.split("aligned", ""), lambda c, i: F.when((c != GAP) & (c != ""), i)), lambda x: x.isNotNull())
    return aln.select("aln_id", "seq_id", F.posexplode(at).alias("pos", "col"))


def extract_mapped_cols(aln: DataFrame, positions: DataFrame) -> DataFrame:
    """For every row the characters at the columns of a reference row's residues.

    positions: aln_id, ref_id, pos (0-based residue index of the reference).
    """
    # Only reference rows are taken apart.
    wish = positions.withColumnRenamed("ref_id", "seq_id")
    refs = aln.join(wish.select("aln_id", "seq_id").distinct(), ["aln_id", "seq_id"], "left_semi")
    ref = map_cols(refs).join(wish, ["aln_id", "seq_id", "pos"])
    lists = ref.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("pos", "col"))).alias("at"))
    pick = F.transform("at", lambda p: F.when(p["col"] < F.length("aligned"), F.substring(F.col("aligned"), p["col"] + 1, F.lit(1))).otherwise(GAP))
    return aln.join(lists, "aln_id").select("aln_id", "seq_id", F.array_join(pick, "").alias("residues"))


def tag_by_identity(aln: DataFrame, refs: DataFrame, identity: float, coverage: float) -> DataFrame:
    """Per row the reference row (aln_id, seq_id in refs) with the highest identity, if identity and coverage reach the bounds."""
    rows = aln.select("aln_id", F.col("seq_id").alias("a"), F.col("aligned").alias("sa"))
    known = rows.join(refs.select("aln_id", F.col("seq_id").alias("a")), ["aln_id", "a"], "left_semi").select("aln_id", F.col("a").alias("b"), F.col("sa").alias("sb"))
    both = _stats(rows.join(known, "aln_id").filter("a <> b")).select("aln_id", F.col("a").alias("seq_id"), F.col("b").alias("ref_id"), "identity", "coverage")
    ok = both.filter((F.col("identity") >= identity) & (F.col("coverage") >= coverage))
    best = ok.groupBy("aln_id", "seq_id").agg(F.max_by(F.struct("ref_id", "identity", "coverage"), F.struct(F.col("identity"), -F.col("ref_id"))).alias("b"))
    return best.select("aln_id", "seq_id", "b.*")


def merge_on_reference(ref: DataFrame, subs: DataFrame) -> DataFrame:
    """Merge cluster alignments onto a reference alignment of their representatives.

    ref: seq_id, aligned. subs: rep, seq_id, aligned, with the representative
    among its own cluster's rows. Columns of a cluster in which its
    representative has no residue become new columns after the residue before
    them; all other rows have gaps there. Result: seq_id and its cells (place,
    ch), where place is the new column; rows are put together per sequence.
    """
    rep_ref = map_cols(ref.select(F.lit(0).alias("aln_id"), "seq_id", "aligned")).select(F.col("seq_id").alias("rep"), "pos", F.col("col").alias("ref_col"))
    own = subs.filter("seq_id = rep").select("rep", F.posexplode(F.split("aligned", "")).alias("col", "ch"))
    w = W.partitionBy("rep").orderBy("col")
    own = own.withColumn("pos", F.sum(F.when(F.col("ch") != GAP, 1).otherwise(0)).over(w) - 1)
    nth = F.when(F.col("ch") == GAP, F.row_number().over(W.partitionBy("rep", "pos").orderBy("col")) - F.when(F.col("pos") >= 0, 1).otherwise(0)).otherwise(0)
    placed = own.withColumn("nth", nth).join(rep_ref, ["rep", "pos"], "left").select("rep", "col", F.coalesce("ref_col", F.lit(-1)).alias("ref_col"), "nth")
    width = ref.agg(F.max(F.length("aligned")).alias("width"))
    base = width.select(F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("ref_col"), F.lit("").alias("rep"), F.lit(0).alias("nth"))
    # New columns of different clusters stay apart; they follow the reference column they come after.
    slots = base.select("ref_col", "rep", "nth").union(placed.filter("nth > 0").select("ref_col", "rep", "nth").distinct())
    slots = slots.select(F.col("ref_col").cast("int").alias("ref_col"), F.col("rep").cast("string").alias("rep"), "nth")
    slots = running(slots.withColumns({"o": F.struct("ref_col", F.col("nth") > 0, "rep", "nth"), "one": F.lit(1)}), [], "o", {"upto": "one"}).select("ref_col", "rep", "nth", (F.col("upto") - 1).cast("int").alias("place"))
    chars = subs.select("rep", "seq_id", F.posexplode(F.split("aligned", "")).alias("col", "ch")).join(placed, ["rep", "col"])
    key = F.when(F.col("nth") > 0, F.col("rep")).otherwise(F.lit(""))
    at = chars.select("seq_id", "ch", "ref_col", "nth", key.cast("string").alias("rep")).filter(F.col("ch") != GAP).join(slots, ["ref_col", "rep", "nth"])
    total = slots.agg(F.count("*").alias("total"))
    lists = at.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "ch"))).alias("m")).crossJoin(F.broadcast(total))
    return lists.select("seq_id", F.array_join(F.transform(F.sequence(F.lit(0), (F.col("total") - 1).cast("int")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(GAP))), "").alias("aligned"))
