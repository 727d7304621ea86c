"""Corpus pipeline: five stages over ``documents``, each written and read again.

1. quality: documents that the classifier rejects go.
2. exact_dedup: of equal texts the one with the smallest doc_id stays.
3. near_duplicates: of each component of linked documents the one with the
   smallest doc_id stays.
4. mixing: each document comes as often as the mix takes it (a last pass that
   takes at least half of it counts), in training order.
5. bpe: the ids of each row that is left, and digests of ids and decoded text.

All stages but the last return the columns they were given. A null doc_id is
compared like any other value. Rows that share a doc_id share the decisions of
stages 2 to 4. Extra columns are carried along. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from cladewise.llm.queries import word_vocabulary
from cladewise.session import table, written


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``ids``."""
    return docs.alias("d").join(ids.select("doc_id").alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model, quality.THRESHOLD)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return only(docs, exact_dedup.exact_dedup(docs).filter("kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return only(docs, jaccard_join.near_duplicates(docs).filter("doc_id <=> component_id"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, word_vocabulary(), keep=("ids",))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The classifier and the encoding can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
