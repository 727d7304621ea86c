"""Session settings that operators read: where shared work tables go."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    It is ``spark.checkpoint.dir``. Where a session on one machine has none
    (tests), a temporary folder is made and remembered in the session; on a
    cluster it must be set, as a folder of the driver is nobody else's.
    """
    for key in ("spark.checkpoint.dir", "spark.cladewise.work.dir"):
        found = spark.conf.get(key, None)
        if found:
            return found
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = tempfile.mkdtemp(prefix="spark-cladewise-", dir="/tmp")
    spark.conf.set("spark.cladewise.work.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def sizes_in_memory(spark: SparkSession) -> None:
    """Let Spark take Parquet files for eight times their size when it looks for a side to broadcast.

    Names and places of trees compress well: a file below the limit may hold a
    million rows, which the driver would collect."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "8.0")


def bounded_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Keep Arrow batches small: texts may be long, and a batch is held whole
    on both sides of the pipe to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextlib.contextmanager
def filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Within, Spark makes a Bloom filter of the small side of a shuffled join, whatever the sizes.

    Its bits are bounded (8 MB); where a side has too many keys it only lets
    more rows pass. Spark asks for a comparison on the filtering side.
    """
    base = "spark.sql.optimizer.runtime.bloomFilter."
    before = {k: spark.conf.get(base + k) for k in ("applicationSideScanSizeThreshold", "creationSideThreshold")}
    spark.conf.set(base + "applicationSideScanSizeThreshold", "1m")
    spark.conf.set(base + "creationSideThreshold", "1t")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(base + k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
