"""Curation of database segments as they arrive: a file stream through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def segment_hits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of hit rows from Parquet segments that appear under a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def best_over_threshold(stream: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Running best score per target over all passing profiles."""
    ok = stream.join(thresholds, "profile").filter(F.col("score") >= F.col("threshold"))
    return ok.groupBy("target").agg(F.max("score").alias("best_score"), F.count("*").alias("n_hits"))


def run_curation(stream: DataFrame, thresholds: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Curate the targets of each micro-batch from all their hits so far.

    The best domains of a batch are kept beside ``out`` under the batch's number,
    and so are the curated rows of its targets in ``out``: a repeated batch
    replaces itself. ``curated`` gives the row of each target's last batch.
    """
    from cladewise.operators.hits import best_domain, curate

    def each(batch: DataFrame, number: int) -> None:
        spark, best = batch.sparkSession, f"{out}-best"
        best_domain(batch).write.mode("overwrite").parquet(f"{best}/batch={number}")
        seen = spark.read.parquet(best).filter(F.col("batch") <= number).drop("batch")
        touched = spark.read.parquet(f"{best}/batch={number}").select("target").distinct()
        curate(seen.join(touched, "target", "left_semi"), thresholds).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def curated(spark: SparkSession, out: str) -> DataFrame:
    """The current row of each target that ``run_curation`` wrote."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("target").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("target", "batch")]), "batch").alias("r"))
    return last.select("target", "r.*")
