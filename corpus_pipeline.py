"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Quality filter, near-duplicate removal (five-word shingles, 0.8), removal of documents that hold benchmark
passages, mixing of sources to target weights, and sharding. All but the last return the columns of
``documents``; the last adds shard and slot in place of columns of these names.

In every stage a null or empty text is a document without words: the classifier scores it by its bias, it is
linked with nothing, holds no passage, has size 0 (so the mix takes it no times) and, if it got that far, a slot. A
null doc_id is an id, but is linked with nothing. Rows that repeat a doc_id are judged each by its own text;
of rows that repeat id and text the second stage keeps one. Ties go to the smaller doc_id. Texts are read whole
whatever their length, columns of any name stay with their values, and an empty table gives an empty one. A
table without labels rejects all, as every score is 0.5.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, mixing, neardup, quality, shards
from granary.operators.tables import shared_folder

SHARDS = 8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.with_shards(docs, [1.0] * SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", sharding),
]

#: A trained classifier is not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; the table between two stages lies in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
