"""The corpus pipeline: documents to shards of a clean, mixed training corpus.

Stages, each writing Parquet that the next one reads:

1. ``toxicity``      documents that the classifier chain rejects go
2. ``near_dedup``    one document of each group of near-duplicates stays
3. ``decontaminate`` documents that hold benchmark passages go
4. ``mix``           documents in the order of the Pfair mixture of their sources
5. ``shard``         contiguous shards of equal bytes along that order
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import table, written
from corpusflow.llm.decontaminate import remove_contaminated
from corpusflow.llm.mixing import mixed
from corpusflow.llm.near_dup import keep_one
from corpusflow.llm.sharding import balanced_shards
from corpusflow.llm.toxicity import drop_toxic, train

SHARDS = 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards follow the rows as the mixture was written: by file, then by row in the file."""
    order = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return balanced_shards(docs, SHARDS, order=order)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL cannot express the classifier and the signatures; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
