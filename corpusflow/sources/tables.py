"""Parquet table sources and the binding of corpus concepts onto them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def balanced(df: DataFrame) -> DataFrame:
    """Spread a scan that arrives in fewer splits than the cluster has task slots.

    A small Parquet file written as one row group is one split, i.e. one task for
    all downstream per-row work (regex, chunking, Arrow UDFs). When the scan has
    fewer partitions than ``defaultParallelism`` a round-robin repartition spreads
    it; on large inputs (many files / row groups) this is a no-op, so no shuffle
    is added where the scan is already parallel. Filters and column pruning still
    reach the Parquet scan below the repartition.
    """
    if is_remote():  # a Connect session has no view of partitions
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return balanced(df) if balance else df


def filename_expr():
    """``{source}-{lang}-{doc_id}.txt``: the file name a document was uploaded under."""
    return F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit("-"),
                    F.col("doc_id").cast("string"), F.lit(".txt"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus view: (doc_id, filename, content, lang, source)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        filename_expr().alias("filename"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )
