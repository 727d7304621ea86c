"""Token files: one wavelet matrix per shard, in ascending doc_id order.

Texts are range-partitioned and sorted by doc_id; each task encodes its range
with the tokenizers library and writes shards of bounded length, each a row of
one Parquet table in the shared folder: doc ids, lengths, and the file image of
the shard's wavelet matrix (see wavelet.py), which gives token access, counts
and occurrence lookup from the one compressed image. Reading starts from those
files alone; a shard's place in the whole sequence is a prefix sum over shard
totals.

White space ends every pre-token of this vocabulary, so the library encodes each
different piece of a slice once (bytes are compared, no hash decides) and the
ids are put together by numpy gathers.

Defined results: null text counts as empty and gives the end id alone. doc_id
keeps its type, whole numbers or strings; a null doc_id comes first. Rows with
equal doc_id are ordered by text. Extra columns are ignored. Empty input gives
an empty table.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.llm import textnp as tn
from cladewise.llm.bpe import _byte_chars, distinct_pieces
from cladewise.llm.wavelet import Wavelet, build
from cladewise.session import bounded_batches, written

END_ID = 1
BITS = 16
#: A shard is closed after the slice of documents with which it has so many tokens.
SHARD_TOKENS = 4_000_000
#: Bytes of text that are encoded together.
SLICE_BYTES = 2 * tn.SLICE_BYTES
#: Pieces that a worker remembers; at most this many, then it starts again.
MEMO = 800_000


class LibraryWords:
    """Ids of pieces from the tokenizers library, as 16-bit numbers in bytes.

    A plain piece, and a word of letters, go straight to the library's model, as
    the steps before it leave nothing to split or change; any other word goes
    through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.chars = dict(enumerate(_byte_chars()))
        self.known: dict[bytes, bytes] = {}

    def _model_ids(self, piece: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def ids(self, found: list[bytes], plain: np.ndarray) -> list[bytes]:
        """Ids of each piece."""
        if len(self.known) > MEMO:
            self.known.clear()
        known, odd, tokenize = self.known, [], self.model.tokenize
        out = list(map(known.get, found))
        new = [i for i, x in enumerate(out) if x is None]
        for i, is_plain in zip(new, plain[new].tolist()):
            w = found[i]
            if is_plain:
                piece = w.decode() if w.isascii() else w.decode("latin-1").translate(self.chars)
                known[w] = array("H", [t.id for t in tokenize(piece)]).tobytes()
                continue
            text = w.decode("utf-8", "replace")
            body, end = (text[:-1], text[-1]) if text[-1] in ".," else (text, "")
            if "Σ" not in body and unicodedata.is_normalized("NFC", body):
                low = body.lower()
                if body.isalpha() and low.isalpha():
                    key = w[:-1] if end else w
                    if key not in known:
                        known[key] = self._model_ids(low.encode().decode("latin-1").translate(self.chars))
                    if end:
                        known[w] = known[key] + self._model_ids(end)
                    continue
            odd.append((w, text))
        for at in range(0, len(odd), 10_000):
            some = odd[at : at + 10_000]
            for (w, _), e in zip(some, self.library.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                known[w] = array("H", e.ids).tobytes()
        for i in new:
            out[i] = known[found[i]]
        return out


_LOADED: dict[str, LibraryWords] = {}


def slice_tokens(lib: LibraryWords, buf: np.ndarray, offs: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a slice, one after the other, and each text's number."""
    found, plain, which, firsts = distinct_pieces(buf, offs)
    made = lib.ids(found, plain) + ([np.array([end_id], np.uint16).tobytes()] if end_id is not None else [])
    if end_id is not None:  # after the last word of each text
        which, firsts = np.insert(which, firsts[1:], len(found)), firsts + np.arange(len(firsts))
    lens = np.fromiter(map(len, made), np.int64, len(made)) // 2
    flat = np.frombuffer(b"".join(made), np.uint16)
    heads = np.cumsum(lens) - lens
    n = lens[which]
    upto = np.zeros(len(which) + 1, np.int64)
    np.cumsum(n, out=upto[1:])
    at = np.arange(upto[-1], dtype=np.int32) + np.repeat((heads[which] - upto[:-1]).astype(np.int32), n)
    return flat[at], np.diff(upto[firsts])


def _shard_schema(id_type: str) -> str:
    return f"part int, nth int, n_docs bigint, n_tokens bigint, doc_ids array<{id_type}>, lengths array<bigint>, image binary"


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Write the token files and return their table:
    part, nth (the shard's place), n_docs, n_tokens, doc_ids, lengths, image (binary)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = LibraryWords(path)
        # Partitions of the range shuffle are numbered in the order of their ranges.
        lib, ids, lens, toks, size, nth, part = _LOADED[path], [], [], [], 0, 0, TaskContext.get().partitionId()

        def listed(x: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

        def shard():
            n, t = np.concatenate(lens), np.concatenate(toks)
            row = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([len(t)], pa.int64())]
            return pa.RecordBatch.from_arrays([*row, listed(pa.concat_arrays(ids)), listed(pa.array(n, pa.int64())), pa.array([build(t, BITS)], pa.binary())], names=names)

        for batch in tn.gathered(batches, slice_bytes):
            for rows, buf, offs in tn.slices(batch, most=slice_bytes):
                t, n = slice_tokens(lib, buf, offs, end_id)
                ids.append(rows.column("doc_id"))
                lens.append(n)
                toks.append(t)
                size += len(t)
                if size >= shard_tokens:
                    yield shard()
                    ids, lens, toks, size, nth = [], [], [], 0, nth + 1
        if ids:
            yield shard()

    names = ["part", "nth", "n_docs", "n_tokens", "doc_ids", "lengths", "image"]
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, _shard_schema(docs.schema["doc_id"].dataType.simpleString())), "token-shards")


#: Partitions whose shards are numbered together.
_TOGETHER = 1024


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, nth and base: the tokens of all shards before it.

    Running sums inside runs of partitions, and over the runs' totals.
    """
    each = shards.select("part", "nth", "n_tokens", F.expr(f"part div {_TOGETHER}").alias("run"))
    inside = W.partitionBy("run").orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    runs = each.groupBy("run").agg(F.sum("n_tokens").alias("tokens"))
    runs = runs.select(F.col("run").alias("key"), F.coalesce(F.sum("tokens").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = each.withColumn("within_run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(runs, F.col("run") == F.col("key")).select("part", "nth", (F.col("before") + F.col("within_run")).alias("base"))


def read_documents(shards: DataFrame, end_id: int = END_ID) -> DataFrame:
    """From the files: one row per document: doc_id, start, n_tokens, ids_crc32,
    and from rank and select on the wavelet matrix first_token (the token at
    start), n_end_ids (how often the end id occurs) and end_at (where its last
    occurrence is in the whole sequence)."""
    names = ["part", "nth", "doc_id", "within", "n_tokens", "ids_crc32", "first_token", "n_end_ids", "end_within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, nth, image = (batch.column(k)[r].as_py() for k in ("part", "nth", "image"))
                ids, lens = batch.column("doc_ids")[r].values, batch.column("lengths")[r].values.to_numpy()
                upto = np.r_[0, np.cumsum(lens)]
                a, b = upto[:-1], upto[1:]
                w = Wavelet(image)
                wide = memoryview(w.tokens().astype("<u4")).cast("B")
                crcs = [zlib.crc32(wide[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
                ends = w.count_many(end_id, a, b)
                last = w.locate_many(end_id, np.cumsum(ends) - 1)
                cols = [pa.array(np.full(len(lens), part, np.int32)), pa.array(np.full(len(lens), nth, np.int32)), ids, pa.array(a), pa.array(lens), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(w.access_many(a)), pa.array(ends), pa.array(last)], names=names)

    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"part int, nth int, doc_id {id_type}, within bigint, n_tokens bigint, ids_crc32 bigint, first_token bigint, n_end_ids bigint, end_within bigint"
    rows = shards.select("part", "nth", "doc_ids", "lengths", "image").mapInArrow(run, schema)
    base = F.col("base")
    return rows.join(shard_starts(shards), ["part", "nth"]).select(
        "doc_id", (base + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "first_token", "n_end_ids", (base + F.col("end_within")).alias("end_at")
    )
