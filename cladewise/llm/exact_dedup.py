"""Exact dedup by content-defined chunk recipes.

A text is normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space) and
cut where a rolling hash of the last 32 bytes meets a mask, so equal passages
are cut alike wherever they stand. A document is then its *recipe*: the ordered
list of its chunks' fingerprints.

1. One scan makes every recipe, with a collision-resistant digest of each
   chunk's bytes beside its 64-bit fingerprint. Only these lists travel; no text
   is moved, however long.
2. Recipes that occur once are done. For the rest, the distinct chunks are
   verified: a fingerprint with several digests under it is split into numbered
   identifiers.
3. Documents are equal when their ordered lists of verified identifiers are.

A group of copies that holds a third of all rows is pre-aggregated before the
shuffle; nothing collects the members of a group.

Defined results: null text counts as empty; all empty texts are one group (a
text of white space alone is one space, another group). Rows that repeat a
doc_id share its fate. A null doc_id stays only in a group that has no other
id. Extra columns are ignored. Empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.llm import textnp as tn
from cladewise.session import bounded_batches, written

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 256, 16384, 11
_GEAR = tn._table(4242)
DIGEST_BYTES = 20


def chunk_ends(buf: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """Per text, where its chunks end. Depends on the text's own bytes only."""
    h = _GEAR[buf]
    for w in (1, 2, 4, 8, 16):
        h[w:] = h[w:] + (h[:-w] << np.uint64(w))
    cuts = np.flatnonzero((h >> np.uint64(24)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1
    span = np.searchsorted(cuts, offs)
    cuts = cuts.tolist()
    out = []
    for i in range(len(offs) - 1):
        at, end, ends = int(offs[i]), int(offs[i + 1]), []
        if end - at > MIN_CHUNK:
            for c in cuts[span[i] : span[i + 1]]:
                while c - at > MAX_CHUNK:
                    at += MAX_CHUNK
                    ends.append(at)
                if c - at >= MIN_CHUNK and c < end:
                    ends.append(c)
                    at = c
            while end - at > MAX_CHUNK:
                at += MAX_CHUNK
                ends.append(at)
        ends.append(end)
        out.append(ends)
    return out


def _chunks(buf: np.ndarray, offs: np.ndarray):
    """Recipe lengths, and starts, ends and fingerprints of all chunks."""
    ends = chunk_ends(buf, offs)
    counts = np.fromiter(map(len, ends), np.int64, len(ends))
    to = np.fromiter((e for x in ends for e in x), np.int64, int(counts.sum()))
    at = np.empty_like(to)
    at[1:] = to[:-1]
    heads = np.cumsum(counts) - counts
    at[heads] = offs[:-1]
    return counts, at, to, tn.range_hash(tn.byte_values(buf), at, to).astype(np.int64)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in tn.slices(batch):
            buf, offs = tn.squeezed(buf, offs)
            counts, at, to, fps = _chunks(buf, offs)
            view = memoryview(np.ascontiguousarray(buf))
            shas = [hashlib.sha256(view[offs[i] : offs[i + 1]]).hexdigest() for i in range(len(offs) - 1)]
            digests = [hashlib.blake2b(view[a:b], digest_size=DIGEST_BYTES).digest() for a, b in zip(at.tolist(), to.tolist())]
            chunks = pa.StructArray.from_arrays([pa.array(fps), pa.array(digests, pa.binary())], names=["fp", "digest"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), chunks)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shas), pa.array(np.diff(offs)), lists], names=["doc_id", "text_sha256", "n_bytes", "chunks"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = written(docs.mapInArrow(_recipes, f"doc_id {id_type}, text_sha256 string, n_bytes bigint, chunks array<struct<fp:bigint,digest:binary>>"), "recipes")
    made = made.withColumn("recipe", F.col("chunks.fp")).withColumn("rkey", F.xxhash64("recipe", "n_bytes"))
    # Written, so that Spark can split a hot recipe when it joins.
    shared = written(made.groupBy("rkey").count().filter("count > 1").select("rkey"), "shared-keys")
    wanted = written(made.join(shared, "rkey", "left_semi"), "shared-recipes")

    # Chunk identifiers: a fingerprint, and a number where contents differ under it.
    chunks = wanted.select(F.explode("chunks").alias("c")).select("c.fp", "c.digest").distinct()
    numbered = chunks.withColumn("number", F.row_number().over(W.partitionBy("fp").orderBy("digest")))
    several = written(numbered.withColumn("n", F.count("*").over(W.partitionBy("fp"))).filter("n > 1").select("fp", "digest", "number"), "split-fingerprints")
    none = F.lit(None).cast("array<struct<ord:int,number:int>>")
    if several.isEmpty():
        wanted = wanted.withColumn("numbers", none)
    else:
        at = wanted.select("rkey", "chunks", F.posexplode("chunks").alias("ord", "c")).select("rkey", "chunks", "ord", "c.fp", "c.digest").distinct().join(several, ["fp", "digest"])
        resolved = at.groupBy("rkey", "chunks").agg(F.sort_array(F.collect_set(F.struct("ord", "number"))).alias("numbers"))
        wanted = wanted.join(resolved, ["rkey", "chunks"], "left")

    key = ["rkey", "n_bytes", "recipe", "numbers"]
    groups = written(wanted.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    same = F.lit(True)
    for k in key:
        same &= F.col(f"w.{k}").eqNullSafe(F.col(f"g.{k}"))
    joined = wanted.alias("w").join(groups.alias("g"), same).select("w.doc_id", "g.keep_id", "g.group_size", "w.text_sha256")
    alone = made.join(shared, "rkey", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256")
    return joined.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
