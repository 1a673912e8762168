"""Queries of streams and of the stored index over the test tables: tables are bound to arriving files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig
from corpusflow.operators import maintenance as mt
from corpusflow.operators.chunking import chunk_documents
from corpusflow.operators.maintenance import scratch_path
from corpusflow.plans.oracle import CHUNKS_CTE, FILENAME, ORACLE
from corpusflow.plans.queries import register
from corpusflow.sources.tables import documents, table
from corpusflow.streaming import ingest

#: Micro-batches that the arrivals of a query come in, whatever the number of files.
BATCHES = 2


def arrivals(df: DataFrame, path: str) -> int:
    """The rows as files, as the scan's partitions give them; how many files make a micro-batch."""
    df.write.parquet(path)
    files = sum(1 for f in df.sparkSession.read.format("binaryFile").load(path).select("path").toLocalIterator())
    return max(1, -(-files // BATCHES))


def _ingested(spark, sf):
    """A document in 41 comes without content, another with blanks only."""
    root = scratch_path(spark, "stream-ingest")
    d = documents(spark, sf).select("doc_id", "filename", F.expr(
        "CASE WHEN doc_id % 41 = 3 THEN NULL WHEN doc_id % 41 = 4 THEN ' \\n ' ELSE content END").alias("content"))
    incoming, index = os.path.join(root, "incoming"), os.path.join(root, "index")
    per_batch = arrivals(d, incoming)
    expected = mt.stored_bytes(spark, incoming) * 8
    mt.create_index(spark, index, dimension=256, buckets=max(spark.sparkContext.defaultParallelism, -(-expected // mt.BUCKET_BYTES)))
    totals = ingest.run_stream_ingest(spark, incoming, d.schema, index, os.path.join(root, "checkpoint"), files_per_trigger=per_batch)
    return index, f"{index}.log", totals


@register("stream_ingest")
def stream_ingest_q(spark, sf):
    index, _, _ = _ingested(spark, sf)
    return spark.read.parquet(index).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id")


@register("stream_ingest_totals")
def stream_ingest_totals_q(spark, sf):
    """The same ingest's totals; its last batch is replayed before they are read."""
    index, log, _ = _ingested(spark, sf)
    last = spark.read.parquet(log).agg(F.max("batch")).first()[0]
    names = spark.read.parquet(log).where(F.col("batch") == last).select("filename")
    again = documents(spark, sf).join(names, "filename", "left_semi").select("doc_id", "filename", F.expr(
        "CASE WHEN doc_id % 41 = 3 THEN NULL WHEN doc_id % 41 = 4 THEN ' \\n ' ELSE content END").alias("content"))
    ingest.ingest_batch(again, last, index, log)
    return ingest.ingest_totals(spark, log).drop("batches")


@register("stream_quarantine")
def stream_quarantine_q(spark, sf):
    _, log, _ = _ingested(spark, sf)
    return ingest.quarantined(spark, log).select("key", "reason")


@register("delete_stored")
def delete_stored_q(spark, sf):
    """Toxic documents deleted from a stored index, then an unknown one: chunks removed, whether any were, and what is left."""
    path = os.path.join(scratch_path(spark, "delete-stored"), "index")
    d = documents(spark, sf)
    mt.create_index(spark, path, buckets=8)
    mt.replace_in_index(chunk_documents(d, ChunkConfig(), keep=["doc_id"]), path)
    toxic = d.join(table(spark, sf, "labels").where(F.col("toxic") == 1), "doc_id", "left_semi").select("filename")
    removed = [mt.delete_from_index(spark, path, names) for names in (toxic, d.select(F.lit("no such file").alias("filename")))]
    left = mt.index_stats(spark.read.parquet(path)).select("document_count", "files")
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(n).cast("bigint").alias("removed"),
                                         F.lit(n > 0).alias("any_removed")) for i, n in enumerate(removed)]))
    return left.select("document_count", "files", steps.alias("s")).select("s.step", "s.removed", "s.any_removed", "document_count", "files")


@register("stream_dedup")
def stream_dedup_q(spark, sf):
    root = scratch_path(spark, "stream-dedup")
    d = table(spark, sf, "documents").select("doc_id", "text")
    incoming, out = os.path.join(root, "incoming"), os.path.join(root, "unique")
    per_batch = arrivals(d, incoming)
    # Arrival time: rows are never behind the watermark, so every copy that arrives within the horizon is found.
    stream = (spark.readStream.schema(d.schema).option("maxFilesPerTrigger", per_batch).parquet(incoming)
              .withColumn("arrived_at", F.current_timestamp()))
    with ingest.state_store(spark):
        q = (ingest.deduplicated(stream, F.md5("text"), "arrived_at").select(F.col("dedup_key").alias("text_md5"))
             .writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out).select("text_md5")


@register("stream_counts")
def stream_counts_q(spark, sf):
    root = scratch_path(spark, "stream-counts")
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    incoming, out = os.path.join(root, "incoming"), os.path.join(root, "counts")
    per_batch = arrivals(ev, incoming)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", per_batch).parquet(incoming)
    with ingest.state_store(spark):
        ingest.write_counts(ingest.count_windows(stream, "ts", "event_type"), out, os.path.join(root, "checkpoint"))
    return ingest.read_counts(spark, out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "status", "events")


_STORED = "doc_id % 41 <> 3 AND doc_id % 41 <> 4"

ORACLE["stream_ingest"] = f"""
WITH {CHUNKS_CTE}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk_id FROM chunks WHERE {_STORED}"""

ORACLE["stream_ingest_totals"] = f"""
WITH {CHUNKS_CTE}
SELECT (SELECT count(*) FROM documents) AS found, (SELECT count(*) FROM documents WHERE {_STORED}) AS stored,
       (SELECT count(*) FROM documents WHERE NOT ({_STORED})) AS failed,
       (SELECT count(*) FROM chunks WHERE {_STORED})::BIGINT AS chunks"""

ORACLE["stream_quarantine"] = f"""
SELECT {FILENAME} AS key, CASE WHEN doc_id % 41 = 3 THEN 'missing' ELSE 'empty' END AS reason FROM documents WHERE NOT ({_STORED})"""

ORACLE["delete_stored"] = f"""
WITH {CHUNKS_CTE},
t AS (SELECT {FILENAME} AS filename FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
n AS (SELECT count(*) AS gone FROM chunks WHERE filename IN (SELECT filename FROM t)),
l AS (SELECT count(*)::BIGINT AS document_count, count(DISTINCT filename)::BIGINT AS files FROM chunks WHERE filename NOT IN (SELECT filename FROM t))
SELECT 1::BIGINT AS step, gone::BIGINT AS removed, gone > 0 AS any_removed, document_count, files FROM n, l
UNION ALL SELECT 2::BIGINT, 0::BIGINT, false, document_count, files FROM l"""

ORACLE["stream_dedup"] = "SELECT DISTINCT md5(text) AS text_md5 FROM documents"

ORACLE["stream_counts"] = """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS status, count(*)::BIGINT AS events
FROM events GROUP BY ALL"""
