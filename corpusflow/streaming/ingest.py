"""Structured Streaming forms of ingest.

* K1 ``run_stream_ingest``: arriving documents are cleaned, chunked, embedded and checked in each micro-batch; good documents
  replace their former chunks in the bucketed index, the others go to a quarantine table with a reason, and a log
  has a row per document. All three are written by batch number, so a replayed batch leaves the same tables.
* K2 ``deduplicated``: exact-duplicate suppression by content hash, whose state ends with its horizon.
* K3 ``count_windows``: counts per window and status in a table of updates; windows leave the state when they can't change.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import HASH_DIM, ChunkConfig
from corpusflow.functions.text import clean_text, words
from corpusflow.operators.embedding import EmbeddingProvider, vector_violation
from corpusflow.operators.maintenance import (VECTOR_FIELDS, create_index, delete_path, index_rows, path_exists, replace_in_index,
                                              scratch_path)
from corpusflow.sources.tables import balanced

# States of a document in the ingest log.
STORED, FAILED = "stored", "failed"


def latest_in_batch(docs: DataFrame, version: str, filename: str = "filename") -> DataFrame:
    """One row per file: that with the greatest version (of equal ones, the greatest row)."""
    rest = [c for c in docs.columns if c not in (version, filename)]
    newest = docs.groupBy(filename).agg(F.max(F.struct(version, *rest)).alias("_newest"))
    return newest.select(*[F.col(filename) if c == filename else F.col(f"_newest.{c}").alias(c) for c in docs.columns])


def _by_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The rows of one batch; a replayed batch replaces its own."""
    (df.withColumn("batch", F.lit(batch_id).cast("long")).write.option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").mode("overwrite").parquet(path))


def ingest_batch(docs: DataFrame, batch_id: int, index_path: str, log_path: str, cfg: ChunkConfig = ChunkConfig(), version: str = "doc_id",
                 embedder: Callable[[], EmbeddingProvider] | None = None, dim: int = HASH_DIM, clean: bool = True) -> None:
    """Store one batch of documents (``version, filename, content``). A document fails whole if it has no content, no
    words, or a text the embedder gives no proper vector for; its former version then stays in the index."""
    spark = docs.sparkSession
    content = clean_text("content") if clean else F.col("content")
    empty = F.when(F.col("content").isNull(), F.lit("missing")).when(F.size(words("content")) == 0, F.lit("empty"))
    # The texts are shuffled and compared once: both the rows and the log are made of what is staged.
    arrived = scratch_path(spark, "ingest-newest")
    latest_in_batch(balanced(docs), version).withColumn("_empty", empty).write.parquet(arrived)
    newest = spark.read.parquet(arrived)
    made = embedder() if embedder else None
    info = create_index(spark, index_path, made.dimension if made else dim)
    # Texts are embedded once: the checked rows are staged, and everything below reads them.
    staged = scratch_path(spark, "ingest-batch")
    rows = index_rows(newest.where(F.col("_empty").isNull()).withColumn("content", content), cfg, dim=info.dimension, keep=[version], embedder=embedder,
                      buckets=info.buckets)
    odd = F.coalesce(*[vector_violation(F.col(f), info.dimension) for f in VECTOR_FIELDS])
    rows.withColumn("_odd", odd).write.parquet(staged)
    rows = spark.read.parquet(staged)
    per_file = rows.groupBy("filename").agg(F.count(F.lit(1)).alias("chunks"), F.max("_odd").alias("reason"))
    log = newest.select("filename", "_empty").join(per_file, "filename", "left").select(
        "filename", F.coalesce("_empty", "reason").alias("reason"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    log = log.select("filename", F.when(F.col("reason").isNull(), STORED).otherwise(FAILED).alias("status"),
                     F.when(F.col("reason").isNull(), F.col("chunks")).otherwise(0).cast("bigint").alias("chunks"), "reason")
    bad = per_file.where(F.col("reason").isNotNull()).select("filename")
    replace_in_index(rows.join(bad, "filename", "left_anti").drop("_odd"), index_path, stored=True)
    _by_batch(log, log_path, batch_id)
    delete_path(spark, staged)
    delete_path(spark, arrived)


def ingest_totals(spark: SparkSession, log_path: str) -> DataFrame:
    """(batches, found, stored, failed, chunks) of all batches: found = stored + failed, however often a batch was replayed."""
    log = spark.read.parquet(log_path)
    return log.agg(F.countDistinct("batch").alias("batches"), F.count(F.lit(1)).alias("found"),
                   F.coalesce(F.sum((F.col("status") == STORED).cast("bigint")), F.lit(0)).alias("stored"),
                   F.coalesce(F.sum((F.col("status") == FAILED).cast("bigint")), F.lit(0)).alias("failed"),
                   F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def quarantined(spark: SparkSession, log_path: str) -> DataFrame:
    """The documents that were not stored, in the layout of other quarantines."""
    log = spark.read.parquet(log_path).where(F.col("status") == FAILED)
    return log.select(F.lit("ingest").alias("source"), F.col("filename").alias("key"), "reason",
                      F.format_string("cannot store %s: %s", "filename", "reason").alias("detail"))


def run_stream_ingest(spark: SparkSession, incoming: str, schema, index_path: str, checkpoint: str,
                      cfg: ChunkConfig = ChunkConfig(), files_per_trigger: int = 1, version: str = "doc_id",
                      embedder: Callable[[], EmbeddingProvider] | None = None, dim: int = HASH_DIM, clean: bool = True,
                      log_path: str | None = None) -> dict:
    """All documents that have arrived in ``incoming``, ``files_per_trigger`` files a micro-batch; ``ingest_totals`` as a dict.

    Of several versions of a file in one micro-batch the one with the greatest ``version`` is stored."""
    log_path = log_path or f"{index_path.rstrip('/')}.log"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(incoming)

    def store(docs: DataFrame, batch_id: int) -> None:
        ingest_batch(docs, batch_id, index_path, log_path, cfg, version, embedder, dim, clean)

    q = (stream.writeStream.foreachBatch(store)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, log_path):
        return {"batches": 0, "found": 0, "stored": 0, "failed": 0, "chunks": 0}
    return ingest_totals(spark, log_path).first().asDict()


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Settings of a *new* stateful query: one state partition per task slot (the number is fixed in the checkpoint when the
    query first starts), and a state store on disk (RocksDB), so state is not bounded by the executors' heap. The session's
    settings are restored afterwards."""
    wanted = {"spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deduplicated(stream: DataFrame, key: Column, time: str, horizon: str = "30 days") -> DataFrame:
    """``stream`` with ``key`` (as ``dedup_key``), without rows whose key was seen within ``horizon`` before them by ``time``.

    The state of a key ends ``horizon`` after its first row, as the watermark passes: state holds the keys of one horizon,
    and a copy that comes later counts as new. Rows later than the horizon behind the newest are dropped."""
    return stream.withColumn("dedup_key", key).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["dedup_key"])


def count_windows(stream: DataFrame, time: str, status: str, window: str = "1 day", lateness: str = "31 days") -> DataFrame:
    """Counts by window and status, as updates. Rows of up to ``lateness`` behind the newest are counted; a window that ended longer
    ago leaves the state."""
    return (stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), F.col(status).alias("status"))
            .agg(F.count(F.lit(1)).alias("events")))


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Run ``count_windows`` over what has arrived. Each micro-batch writes only the windows that changed."""
    def store(batch: DataFrame, batch_id: int) -> None:
        _by_batch(batch.select("w.start", "status", "events"), path, batch_id)

    q = (counts.writeStream.outputMode("update").foreachBatch(store)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(start, status, events): of each window and status its last update."""
    return spark.read.parquet(path).groupBy("start", "status").agg(F.max_by("events", "batch").alias("events"))
