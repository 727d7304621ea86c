"""SentencePiece encoding and decoding by a table of distinct chunks.

In the models taken here no piece holds a whitespace marker after another
character (checked when the model is loaded), so no merge crosses the border
before a run of markers. A text is cut there into chunks, each a run of markers
with the characters up to the next run; the first one starts with the marker
that the model puts before every text. Encoding a text is then encoding its
chunks and joining their ids by position, and decoding likewise.

1. Chunks are counted over all texts, and a histogram of the counts gives the
   count from which on at most ``TABLE`` chunks are left.
2. These are segmented once, in a Spark job, and written as a table (chunk, ids,
   decoded). Its size is bounded: at most ``TABLE`` rows of chunks of at most
   ``LONGEST`` bytes, so it may be broadcast whatever the number of texts.
3. Every text is put together from the table. A chunk that is too rare for the
   table is segmented once in the slice of texts that holds it. Chunks of a slice
   are told apart by their bytes, not by hashes alone.

Defined results: null text counts as empty: no ids, empty decoded text. The
strings of control pieces in a text are ordinary text. Rows that repeat are
encoded each, a doc_id of any type is carried along, extra columns are ignored,
and an empty table gives no rows. Work on a long text is linear in its length,
and none is cut; one chunk without white space is segmented as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm import textnp as tn
from cladewise.session import bounded_batches, written

#: Rows of the broadcast table at most, and bytes of a chunk in it.
TABLE = 1 << 17
LONGEST = 64
#: Bytes of text over which chunks are counted at once.
COUNT_BYTES = 1 << 24
MARKER = "▁"
_MARKER = np.frombuffer(MARKER.encode(), np.uint8)
#: Chunks that the library gets at once.
_AT_ONCE = 4096
_BINS = 16


class Pieces:
    """One model file; chunks are given without their first marker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        inside = re.compile(rf"{MARKER}*[^{MARKER}]*")
        user_defined = proto.SentencePiece.USER_DEFINED
        ok = (
            spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and all(p.type != user_defined and inside.fullmatch(p.piece) for p in proto.pieces)
        )
        if not ok:
            raise ValueError(f"{path}: pieces of this model may cross whitespace markers")
        lone = self.model.piece_to_id(MARKER)
        self.lone = [lone] if lone != self.model.unk_id() else [self.model.piece_to_id(f"<0x{b:02X}>") for b in MARKER.encode()]

    def segment(self, chunks: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Ids of each chunk, and what they decode to after the chunk's first marker."""
        ids, texts = [], []
        for at in range(0, len(chunks), _AT_ONCE):
            part = [c.decode("utf-8", "replace") for c in chunks[at : at + _AT_ONCE]]
            got = self.model.encode(part, num_threads=1)
            got = [g if c else self.lone for g, c in zip(got, part)]
            ids += got
            texts += self.model.decode(got, num_threads=1)
        return ids, texts


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The model, read once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def chunks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all chunks after their first marker, and per text the index of its first chunk (one entry more than texts)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    white = buf == 0x20
    if len(buf) > 2:
        at = np.flatnonzero(buf[:-2] == _MARKER[0])
        at = at[(buf[at + 1] == _MARKER[1]) & (buf[at + 2] == _MARKER[2])]
        for k in range(3):
            white[at + k] = True
    first = white.copy()
    first[1:] &= ~white[:-1]
    head = np.zeros(len(buf), bool)
    head[offs[:-1][offs[:-1] < offs[1:]]] = True
    starts = np.flatnonzero(first | head)
    ends = np.r_[starts[1:], len(buf)]
    own = np.where(head[starts], 0, np.where(buf[starts] == 0x20, 1, 3))
    return starts + own, ends, np.searchsorted(starts, offs)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most: int = TABLE) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    what ``keep`` names of ids (array of numbers) and decoded (text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    table = spark.sparkContext.broadcast([tuple(r) for r in chunk_table(docs, path, most).toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        known = {bytes(c): (i.count(",") + 1, i, t) for c, i, t in table.value}
        for batch in tn.gathered(batches):
            for rows, buf, offs in tn.slices(batch, most=2 * tn.SLICE_BYTES):
                s, e, firsts = chunks(buf, offs)
                found, which = tn.distinct_ranges(buf, s, e)
                made = [known.get(c) for c in found]
                rare = [k for k, x in enumerate(made) if x is None]
                for k, i, t in zip(rare, *pieces.segment([found[k] for k in rare])):
                    made[k] = (len(i), ",".join(map(str, i)), t)
                counts = np.fromiter((x[0] for x in made), np.int64, len(made))
                ids, texts = [x[1] for x in made], [x[2] for x in made]
                upto = np.zeros(len(which) + 1, np.int64)
                if len(which):
                    np.cumsum(counts[which], out=upto[1:])
                shas, all_ids, decoded = [], [], []
                for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
                    at = which[a:b].tolist()
                    joined, text = ",".join([ids[k] for k in at]), " ".join([texts[k] for k in at])
                    shas.append((hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    if "ids" in keep:
                        all_ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                    if "decoded" in keep:
                        decoded.append(text)
                cols = [rows.column("doc_id"), pa.array(np.diff(upto[firsts])), pa.array([x[0] for x in shas], pa.string()), pa.array([x[1] for x in shas], pa.string())]
                more = {"ids": (all_ids, pa.list_(pa.int32())), "decoded": (decoded, pa.string())}
                yield pa.RecordBatch.from_arrays(cols + [pa.array(*more[k]) for k in keep], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep]
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {kinds[k]}" for k in keep)
    return docs.mapInArrow(run, schema)


def chunk_table(docs: DataFrame, path: str, most: int = TABLE) -> DataFrame:
    """The most frequent chunks of all texts, at most ``most``: chunk, ids (joined by commas), decoded; written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.gathered(batches, COUNT_BYTES):
            for _, buf, offs in tn.slices(batch, most=COUNT_BYTES):
                s, e, _ = chunks(buf, offs)
                short = e - s <= LONGEST
                found, which = tn.distinct_ranges(buf, s[short], e[short])
                n = np.bincount(which, minlength=len(found))
                # What a slice holds once is left to its slice.
                often = np.flatnonzero(n > 1)
                for at in range(0, len(often), 1 << 16):
                    part = often[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([found[k] for k in part.tolist()], pa.binary()), pa.array(n[part].astype(np.int64))], names=["chunk", "n"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in batches:
            ids, texts = pieces.segment(batch.column("chunk").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([",".join(map(str, i)) for i in ids], pa.string()), pa.array(texts, pa.string())], names=["chunk", "ids", "decoded"])

    counted = docs.select("text").mapInArrow(count, "chunk binary, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("bin", F.floor(F.log2("n") * _BINS).cast("int")), "chunk-counts")
    # A row for each step of the counts' logarithm: at most 64 * _BINS.
    left, least = most, None
    for r in counted.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r.bin
    frequent = counted.filter(F.col("bin") >= least if least is not None else F.lit(False)).select("chunk")
    return written(frequent.mapInArrow(segment, "chunk binary, ids string, decoded string"), "chunk-table")
