"""Substring dedup with a count-min prefilter.

A window is 20 consecutive words of one document. A word goes if a window that
covers it has a word sequence that also starts earlier: in a document with a
smaller doc_id, or earlier in the same one.

1. Prefilter: every window has an anchor, the least hash among its 8-word
   parts. Equal windows have equal anchors, so a window's count is at most its
   anchor's, and there are seven times fewer anchors than windows. Each
   task sketches the anchors it meets; the merged count-min sketch never
   estimates too low, so a window whose anchor is estimated to occur once is
   not repeated. None is lost.
2. A second pass takes only windows estimated to be repeated. A task settles
   what it can by itself: of equal windows it holds, only the earliest goes on.
   Runs of windows with one anchor travel as one row to the anchor's partition,
   where windows are grouped exactly, by 128-bit hashes of their words, and all
   but the earliest are marked.
3. Marked windows return to their document, where the words they cover go.

A passage that stands in a third of all documents sends one row per task. The
windows of an anchor that is frequent (an 8-word phrase in many surroundings, by
the counts of the first pass) are dealt over ``SALTS`` parts by their own hash.

Defined results: null text has no words. Rows that share a doc_id are one
document: an equal place in it is not earlier, and what is marked goes from all
its rows. A null doc_id is the least. doc_id must be a whole number: another type is
a TypeError. Extra columns are ignored. Empty input
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm import textnp as tn
from cladewise.session import bounded_batches
from cladewise.llm.sketch import repeated

WINDOW, PART = 20, 8
#: Two rows of 2**27 counters: 32 MB, whatever the input.
LOG2_WIDTH, DEPTH = 27, 2
#: Windows that a task compares at once.
HELD = 1_000_000
#: Parts over which the windows of a frequent anchor are dealt, by their own hash.
SALTS = 256
_NULL_ID = -(1 << 63)


def _sliding(x: np.ndarray, k: int, take) -> np.ndarray:
    """take (minimum or maximum) over every k neighbours."""
    w = 1
    while 2 * w <= k:
        x = take(x[:-w], x[w:])
        w *= 2
    return take(x[: len(x) - (k - w)], x[k - w :]) if k > w else x


def anchored(buf: np.ndarray, offs: np.ndarray):
    """Word hashes, first words, valid windows (first word), their anchors, and anchor places."""
    starts, ends, firsts = tn.words(buf, offs)
    hashes = tn.word_hashes(buf, starts, ends)
    n, span = len(hashes), WINDOW - PART + 1
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return hashes, firsts, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    counts = np.maximum(np.diff(firsts) - WINDOW + 1, 0)
    heads = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) + np.repeat(firsts[:-1] - heads, counts)
    parts = tn.runs_of(hashes, PART) | np.uint64(1)
    least = _sliding(parts, span, np.minimum)
    valid = np.zeros(len(least), bool)
    valid[at] = True
    # A part is an anchor's place if a valid window over it has it as its least.
    pad = np.zeros(span - 1, np.uint64)
    over = _sliding(np.concatenate([pad, np.where(valid, least, np.uint64(0)), pad]), span, np.maximum)
    return hashes, firsts, at, least[at], parts[parts == over]


def _hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, buf, offs in tn.slices(batch):
        yield anchored(buf, offs)[4]


def _first_of_each(rows: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows (two hash rows) have no equal one that starts earlier."""
    order = np.lexsort((at, ids, rows[1], rows[0]))
    h0, h1, i, a = rows[0][order], rows[1][order], ids[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    first = np.empty(len(order), bool)
    first[order] = (i == i[head]) & (a == a[head])
    return first


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where a run begins: some column changes, or the last one (place) has a gap."""
    new = np.ones(len(cols[0]), bool)
    if len(new) > 1:
        new[1:] = cols[-1][1:] != cols[-1][:-1] + 1
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_SENT = ["anchor", "doc_id", "at", "n", "windows"]


def _candidates(seen, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                hashes, firsts, at, anchors, _ = anchored(buf, offs)
                often = seen.value.maybe(anchors)
                at, anchors = at[often], anchors[often]
                if not len(at):
                    continue
                doc = np.searchsorted(firsts, at, "right") - 1
                ids = rows.column("doc_id").fill_null(_NULL_ID).to_numpy()[doc]
                starts, ends, _ = tn.words(buf, offs)
                second = tn.word_hashes(buf, starts, ends, 1)
                if (hot := frequent.value.weight(anchors) > 0).any():
                    # Equal windows share their hash, so they still meet.
                    with np.errstate(over="ignore"):
                        salt = tn.runs_of(hashes, WINDOW)[at[hot]] % np.uint64(SALTS)
                        anchors[hot] = tn.mix64(anchors[hot] + salt)
                pair = (tn.runs_of(hashes, WINDOW)[at], tn.runs_of(second, WINDOW, 1)[at])
                held.append((*pair, ids, at - firsts[doc], anchors))
                n += len(at)
                if n >= HELD:
                    yield _sent(held)
                    held, n = [], 0
        if held:
            yield _sent(held)

    return run


def _sent(held) -> pa.RecordBatch:
    h0, h1, ids, at, anchors = (np.concatenate(x) for x in zip(*held))
    first = _first_of_each(np.stack([h0, h1]), ids, at)
    cut = _runs(first, anchors, ids, at)
    ends = np.r_[cut[1:], len(at)]
    both = np.stack([h0, h1], axis=1).tobytes()
    return pa.RecordBatch.from_arrays(
        [
            # What is settled goes anywhere; it is dealt by document.
            pa.array(np.where(first[cut], anchors[cut], tn.mix64(ids[cut].astype(np.uint64))).view(np.int64)),
            pa.array(ids[cut]), pa.array(at[cut].astype(np.int64)), pa.array((ends - cut).astype(np.int64)),
            pa.array([both[16 * a : 16 * b] if f else None for a, b, f in zip(cut.tolist(), ends.tolist(), first[cut].tolist())], pa.binary()),
        ],
        names=_SENT,
    )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: runs of windows that also start earlier."""
    kept: list[pa.RecordBatch] = []
    n, enough = 0, HELD

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, at, k = (rows.column(c).to_numpy() for c in ("doc_id", "at", "n"))
        open_ = rows.column("windows").is_valid().to_numpy(zero_copy_only=False)
        hashes = np.frombuffer(b"".join(x for x in rows.column("windows").to_pylist() if x is not None), np.uint64).reshape(-1, 2)
        ko = k[open_]
        wi = np.repeat(ids[open_], ko)
        wa = np.repeat(at[open_] - (np.cumsum(ko) - ko), ko) + np.arange(int(ko.sum()))
        late = ~_first_of_each(np.ascontiguousarray(hashes.T), wi, wa)
        wi, wa = wi[late], wa[late]
        cut = _runs(wi, wa)
        runs = np.diff(np.r_[cut, len(wi)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[ids[~open_], wi[cut]]), pa.array(np.r_[at[~open_], wa[cut]]), pa.array(np.r_[k[~open_], runs])], names=["doc_id", "at", "n"]
        )

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += int(batch.column("n").to_numpy().sum())
        if n >= enough:
            rows = joined()
            a = rows.column("anchor").to_numpy()
            whole = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            if whole:
                yield out(rows.slice(0, whole))
            kept = [rows.slice(whole)]
            n = int(kept[0].column("n").to_numpy().sum())
            enough = max(HELD, 2 * n)
    if kept:
        yield out(joined())


def _cleaned(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                starts, ends, firsts = tn.words(buf, offs)
                counts = np.diff(firsts)
                gone = np.zeros(len(starts) + 1, np.int64)
                runs = rows.column("runs")
                lists = pa.ListArray.from_arrays(runs.offsets, runs.values) if runs.offset else runs
                flat = lists.flatten()
                each = np.diff(np.asarray(runs.offsets.to_numpy()))
                each = np.where(runs.is_valid().to_numpy(zero_copy_only=False), each, 0)
                doc = np.repeat(np.arange(len(each)), each)
                if len(doc):
                    at, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    a = np.minimum(firsts[doc] + at, firsts[doc + 1])
                    b = np.minimum(a + n + WINDOW - 1, firsts[doc + 1])
                    np.add.at(gone, a, 1)
                    np.add.at(gone, b, -1)
                stay = np.cumsum(gone[:-1]) == 0
                lost = np.zeros(len(stay) + 1, np.int64)
                np.cumsum(~stay, out=lost[1:])
                # Kept words joined by one space: bytes of kept words, and a space after each.
                s, e = starts[stay], ends[stay]
                size = e - s + 1
                heads = np.cumsum(size) - size
                src = np.arange(int(size.sum())) + np.repeat(s - heads, size)
                text = np.empty(len(src), np.uint8)
                last = heads + size - 1
                body = np.ones(len(src), bool)
                body[last] = False
                text[body] = buf[src[body]]
                text[last] = 0x20
                cuts = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(stay)][firsts]]
                view = memoryview(text)
                texts = [view[x : max(x, y - 1)] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                cols = [rows.column("doc_id"), pa.array(counts), pa.array(lost[firsts[1:]] - lost[firsts[:-1]]), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if keep_text:
                    cols.append(pa.array([bytes(t) for t in texts], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(cols)])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``keep_text`` the kept text."""
    bounded_batches(docs.sparkSession)
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found, often = repeated(docs.select("text"), _hashes_of, LOG2_WIDTH, DEPTH)
    seen, frequent = (docs.sparkSession.sparkContext.broadcast(x) for x in (found, often))
    sent = docs.mapInArrow(_candidates(seen, frequent), "anchor bigint, doc_id bigint, at bigint, n bigint, windows binary")
    marked = sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_marked, "doc_id bigint, at bigint, n bigint")
    # At most one run per word of the document.
    runs = marked.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs")).withColumnRenamed("doc_id", "key")
    rows = docs.join(runs, F.coalesce("doc_id", F.lit(_NULL_ID).cast("bigint")) == F.col("key"), "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(_cleaned(keep_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text)


#: DuckDB SQL for the rows, where each doc_id has one row.
ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT k, min(struct_pack(a := doc_id, b := i)) AS f FROM v GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM v JOIN f USING (k) WHERE struct_pack(a := doc_id, b := i) > f),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (SELECT doc_id, count(*) AS n, count(g.i) AS gone, string_agg(CASE WHEN g.i IS NULL THEN w[x.i] END, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"""
