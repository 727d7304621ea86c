"""Contiguous shards of near equal bytes by global prefix sums.

Documents are put in doc_id order by a range shuffle of narrow rows (id, size,
checksum; the texts do not move). Each partition's totals give its offset, and
a running sum inside the partition gives every document's global byte range.
The shard is the one in which the middle of that range falls, so a shard's
bytes differ from the target by less than its two border documents.

Defined results: null text has no bytes. Rows with equal doc_id are ordered by
size and checksum; null doc_id comes first. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.session import written

ORDER = ("doc_id", "size", "text_crc32")


def byte_shards(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, start_byte, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    # The partition number is written with the rows, so that every later step sees the same cut.
    rows = written(rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "by-id")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row per partition of the range shuffle, whatever the number of documents.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy(*ORDER)))
        .join(offsets, "part")
        .withColumn("start_byte", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * start_byte + size) * {int(shards)} div (2 * all_bytes)")).cast("int"))
        .select("part", "doc_id", "size", "text_crc32", "start_byte", "row", "shard")
    )
    # A shard's first row is the least over the partitions it meets: one row per shard.
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "start_byte", "shard", (F.col("row") - F.col("first_row")).cast("bigint").alias("slot"))


def _nibble(c: int) -> int:
    """Four steps of the checksum's shift register."""
    for _ in range(4):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


#: SQL: crc32 of half-bytes (``parts``), the lower half of each byte first.
_CRC = f"xor(list_reduce(parts, lambda c, x: xor(c >> 4, {[_nibble(i) for i in range(16)]}[xor(c, x) % 16 + 1]), 4294967295), 4294967295)"
#: DuckDB SQL for the rows of 24 shards with 8 bytes beside each text.
ORACLE = f"""WITH b AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
l AS (SELECT doc_id, size, list_transform(range(2 * size - 16), lambda i: CAST(strpos('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1 AS BIGINT)) AS parts FROM b),
r AS (SELECT doc_id, size, {_CRC} AS text_crc32 FROM l),
p AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start_byte, CAST(sum(size) OVER () AS BIGINT) AS every FROM r),
s AS (SELECT *, CAST(least(23, (2 * start_byte + size) * 24 // (2 * every)) AS INT) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""
