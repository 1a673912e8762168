"""Index table build and maintenance: create, write, schema guard, delete, replace,
duplicates, statistics and ingest status.

The index is a Parquet table partitioned by ``bucket = pmod(xxhash64(filename), buckets)``, so that deleting or
replacing a document rewrites only the buckets it touches (dynamic partition overwrite) instead of the whole table. How
many buckets there are, and the vectors' dimension, stand beside the data in ``_index`` and hold for the table's life.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import HASH_DIM, ChunkConfig
from corpusflow.functions.text import words
from corpusflow.operators.chunking import chunk_documents, combined_text, n_chunks
from corpusflow.operators.embedding import (EmbeddingProvider, embed_column, md5_hash_vector, provenance, split_by_contract,
                                            vector_violation)
from corpusflow.session import bounded_batches, ensure_checkpoint_dir

#: Buckets of a table whose size is not known in advance, and bytes of index meant for one bucket otherwise.
INDEX_BUCKETS = 64
BUCKET_BYTES = 512 << 20
VECTOR_FIELDS = ("content_embedding", "filename_embedding", "combined_embedding")

# Fixed value: status line of a stored document.
STATUS_TEMPLATE = "Indexed %d chunks from %s"


def bucket_of(filename, buckets: int = INDEX_BUCKETS) -> F.Column:
    c = F.col(filename) if isinstance(filename, str) else filename
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


# --------------------------------------------------------------------------- the stored table
@dataclass(frozen=True)
class IndexInfo:
    """What holds for a stored index. ``dimension`` is None for an index without vectors."""

    buckets: int
    dimension: int | None = None


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    fs, p = _hadoop(spark, path)
    return int(fs.getContentSummary(p).getLength())


def index_info(spark: SparkSession, path: str) -> IndexInfo | None:
    """The stored facts of the index at ``path``; None if there is no index."""
    about = f"{path.rstrip('/')}/_index"
    if not path_exists(spark, about):
        return None
    row = spark.read.schema("buckets int, dimension int").json(about).first()
    return IndexInfo(row["buckets"], row["dimension"])


def create_index(spark: SparkSession, path: str, dimension: int | None = None, expected_bytes: int | None = None,
                 buckets: int | None = None) -> IndexInfo:
    """The index at ``path``, created if absent. The bucket count follows ``expected_bytes`` unless given. An existing index
    keeps its own facts; one of another dimension is an error that names both."""
    found = index_info(spark, path)
    if found is None:
        wanted = buckets or (max(1, math.ceil(expected_bytes / BUCKET_BYTES)) if expected_bytes is not None else INDEX_BUCKETS)
        spark.createDataFrame([(wanted, dimension)], "buckets int, dimension int").coalesce(1).write.mode("overwrite").json(
            f"{path.rstrip('/')}/_index")
        return IndexInfo(wanted, dimension)
    if dimension is not None and found.dimension is not None and found.dimension != dimension:
        raise ValueError(f"the index at {path} holds vectors of dimension {found.dimension}, the embedder gives {dimension}: "
                         "build a new index with this embedder, or take the one that built this index")
    return found


def write_buckets(df: DataFrame, path: str, mode: str) -> None:
    """One task per bucket writes that bucket's file (no tasks × buckets file explosion)."""
    df.repartition("bucket").write.partitionBy("bucket").mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _buckets_in(spark: SparkSession, path: str) -> dict:
    """Folder names of the buckets under ``path`` with their Hadoop paths."""
    fs, p = _hadoop(spark, path)
    held = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return {f.getName(): f for f in held if f.getName().startswith("bucket=")}


def replace_buckets(spark: SparkSession, path: str, touched: list[int], rows: DataFrame) -> None:
    """``rows`` become all that the buckets ``touched`` hold (nothing, for those without rows).

    They are written beside the index first and take the place of the old folders by renaming, the old ones aside. A
    call that was cut off between is finished by ``finish_replacements`` before the next one reads the table."""
    staging = f"{path.rstrip('/')}.staging/{uuid.uuid4().hex}"
    write_buckets(rows, staging, "overwrite")
    fs, top = _hadoop(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged = _buckets_in(spark, staging)
    for bucket in [f"bucket={b}" for b in touched]:
        mine, aside = place(top, bucket), place(f"{staging}/_old/{bucket}")
        fs.mkdirs(aside.getParent())
        if fs.exists(mine):
            fs.rename(mine, aside)
        if bucket in staged:
            fs.rename(staged[bucket], mine)
    delete_path(spark, staging)


def finish_replacements(spark: SparkSession, path: str) -> None:
    """Put a bucket in its place whose old folder was moved aside by a call that did not come to its end: the new folder if it
    was written whole, else the old one."""
    waiting = f"{path.rstrip('/')}.staging"
    fs, top = _hadoop(spark, waiting)
    if not fs.exists(top):
        return
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for run in [s.getPath().toString() for s in fs.listStatus(top)]:
        whole = fs.exists(place(f"{run}/_SUCCESS"))
        new, old = _buckets_in(spark, run) if whole else {}, _buckets_in(spark, f"{run}/_old")
        for bucket in old:
            mine = place(f"{path.rstrip('/')}/{bucket}")
            if not fs.exists(mine) and (bucket in new or not whole):
                fs.rename(new.get(bucket, old[bucket]), mine)
        delete_path(spark, run)


def delete_from_index(spark: SparkSession, path: str, filenames: DataFrame, filename: str = "filename") -> int:
    """Remove the chunks of the listed files from the stored index; the number of chunks removed (0: nothing was rewritten).

    Only buckets that hold chunks of these files are read in full and rewritten."""
    info = index_info(spark, path)
    finish_replacements(spark, path)
    if info is None or not _buckets_in(spark, path):
        return 0
    gone = filenames.select(F.col(filename).alias("filename")).distinct().withColumn("bucket", bucket_of("filename", info.buckets))
    index = read_index(spark, path)
    met = index.select("filename", "bucket").join(gone, ["bucket", "filename"], "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    if not met:
        return 0
    touched = [r["bucket"] for r in met]
    kept = index.where(F.col("bucket").isin(touched)).join(gone.select("filename"), "filename", "left_anti")
    replace_buckets(spark, path, touched, kept.select(index.columns))
    return sum(r["n"] for r in met)


def replace_in_index(batch: DataFrame, path: str, filename: str = "filename", stored: bool = False) -> None:
    """Upsert: rows of the batch's files replace their previous rows. Only the buckets the batch touches are rewritten, and a
    repeated call gives the same table. ``stored``: the batch's rows are read from files, so they need not be kept."""
    spark = batch.sparkSession
    info = create_index(spark, path)
    finish_replacements(spark, path)
    batch = batch.withColumn("bucket", bucket_of(filename, info.buckets))
    if not _buckets_in(spark, path):
        write_buckets(batch, path, "append")
        return
    # The batch is read several times below: its names by one column of its files, or its rows are kept rather than made
    # for each use.
    if not stored:
        batch = batch.persist()
    try:
        names = batch.select(filename, "bucket").distinct()
        touched = [r["bucket"] for r in names.select("bucket").distinct().collect()]  # at most the table's buckets
        index = read_index(spark, path)
        survivors = index.where(F.col("bucket").isin(touched)).join(names.select(filename), filename, "left_anti")
        replace_buckets(spark, path, touched, survivors.select(index.columns).unionByName(batch.select(index.columns)))
    finally:
        if not stored:
            batch.unpersist()


# --------------------------------------------------------------------------- rows
def index_rows(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), dim: int = HASH_DIM,
               include_filename: bool = True, provider: str = "hash-md5", model: str = "md5-token-hash",
               keep: list[str] | None = None, embedder: Callable[[], EmbeddingProvider] | None = None,
               buckets: int = INDEX_BUCKETS) -> DataFrame:
    """Chunks with the three vectors and provenance.

    ``embedder`` makes the provider that embeds all three texts (once per task; once here to
    read its dimension and provenance). Without one, vectors are md5 token hashes. A text
    that the provider fails on gets a NULL vector: ``index_parts`` separates such rows.

    The filename vector is computed once per *document* before the chunks are
    exploded (not once per chunk, and without a join back to a filename table).
    Vectors are computed in Arrow batches where every distinct token is hashed
    once, so the combined text's content tokens cost a dictionary lookup.
    """
    bounded_batches(docs.sparkSession)
    keep = list(keep or [])
    made = embedder() if embedder else None
    if made is not None:
        dim = made.dimension
        origin = provenance(made)
    else:
        origin = [F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit("cpu").alias("device"), F.lit(dim).alias("dimension")]

    def vector(text: Column) -> Column:
        return embed_column(text, embedder, dim) if embedder else md5_hash_vector(text, dim, single=True)

    per_doc = docs.select(*keep, "filename", "content", vector(F.col("filename")).alias("filename_embedding"))
    chunks = chunk_documents(per_doc, cfg, keep=[*keep, "filename_embedding"])
    combined = combined_text(F.col("filename"), F.col("content"), include_filename)
    return chunks.select(
        *keep, "filename", "chunk_index", "chunk_id", "content",
        vector(F.col("content")).alias("content_embedding"),
        "filename_embedding",
        vector(combined).alias("combined_embedding"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        *origin,
        bucket_of("filename", buckets).alias("bucket"),
    )


def index_parts(index: DataFrame, dim: int, fields=VECTOR_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(rows to store, quarantined rows with ``reason`` and ``detail``): every vector must keep the contract."""
    good, bad = index, None
    for field in fields:
        good, out = split_by_contract(good, field, dim)
        bad = out if bad is None else bad.unionByName(out)
    return good, bad


def cluster_by_bucket(df: DataFrame, files_per_bucket: int = 1) -> DataFrame:
    """Rows of one bucket go to ``files_per_bucket`` tasks (one file each), so a
    bucketed write produces buckets × files_per_bucket files instead of
    tasks × buckets. Choose both so one file is about the target file size."""
    if files_per_bucket <= 1:
        return df.repartition("bucket")
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_bucket))
    return df.repartition(F.col("bucket"), salt)


def write_index(index: DataFrame, path: str, mode: str = "append", files_per_bucket: int = 1, buckets: int | None = None) -> dict:
    """Append to (or overwrite) the Parquet index, which is created if absent; ``replace_in_index`` replaces single files in it.

    Rows of which a vector does not keep the contract (null, empty, another dimension, not finite) are not stored. Returns
    the number of rows stored and of those left out, observed while writing; ``index_parts`` gives the latter with reasons.
    """
    from pyspark.sql import Observation

    spark = index.sparkSession
    if mode == "overwrite":
        delete_path(spark, path)
    made = index.select("dimension").first() if "dimension" in index.columns else None
    info = create_index(spark, path, made["dimension"] if made else None, buckets=buckets)
    fields = [f for f in VECTOR_FIELDS if f in index.columns]
    odd = F.lit(False)
    for f in fields:
        odd = odd | vector_violation(F.col(f), info.dimension).isNotNull()
    seen = Observation("index_write")
    stamped = index.withColumn("bucket", bucket_of("filename", info.buckets)).withColumn("indexed_at", F.current_timestamp()).withColumn(
        "_odd", odd if info.dimension is not None else F.lit(False))
    stamped = stamped.observe(seen, F.sum(F.when(F.col("_odd"), 0).otherwise(1)).alias("stored"),
                              F.sum(F.when(F.col("_odd"), 1).otherwise(0)).alias("missing_vectors"))
    cluster_by_bucket(stamped.where("not _odd").drop("_odd"), files_per_bucket).write.partitionBy("bucket").mode("append").parquet(path)
    return {name: int(seen.get.get(name) or 0) for name in ("stored", "missing_vectors")}


def dimension_guard(index: DataFrame, expected: int, fields=VECTOR_FIELDS) -> DataFrame:
    """One row per vector field: observed min/max dimension, whether it matches, and a
    message naming both dimensions and the remedy when it does not."""
    aggs = []
    for f in fields:
        aggs += [F.min(F.size(f)).alias(f"{f}__min"), F.max(F.size(f)).alias(f"{f}__max")]
    row = index.agg(*aggs)
    stacked = None
    for f in fields:
        one = row.select(
            F.lit(f).alias("field"),
            F.col(f"{f}__min").cast("bigint").alias("min_dim"),
            F.col(f"{f}__max").cast("bigint").alias("max_dim"),
        )
        stacked = one if stacked is None else stacked.unionByName(one)
    ok = (F.col("min_dim") == expected) & (F.col("max_dim") == expected)
    return stacked.select(
        "field", "min_dim", "max_dim", F.lit(expected).cast("bigint").alias("expected_dim"),
        ok.alias("ok"),
        F.when(ok, F.lit("")).otherwise(F.format_string(
            "stored vectors have %d to %d dimensions, the embedder gives %d: build a new index with this embedder, "
            "or take the one that built this index", F.col("min_dim"), F.col("max_dim"), F.lit(expected))).alias("message"),
    )


def delete_documents(index: DataFrame, filenames: DataFrame, filename: str = "filename") -> DataFrame:
    """Index without the chunks of the listed files (left anti join)."""
    return index.join(filenames.select(F.col(filename).alias(filename)).distinct(), filename, "left_anti")


def latest_versions(index: DataFrame, filename: str = "filename", version: str = "version") -> DataFrame:
    """Replace semantics: keep only the newest version of every file."""
    newest = index.groupBy(filename).agg(F.max(version).alias(version))
    return index.join(newest, [filename, version], "left_semi")


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """Content hashes held by more than one chunk: (content_md5, copies, files)."""
    return (
        chunks.groupBy(F.md5("content").alias("content_md5"))
        .agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("filename").alias("files"))
        .where(F.col("copies") > 1)
    )


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.countDistinct("filename").alias("files"),
        F.sum(F.octet_length("content")).cast("bigint").alias("content_bytes"),
    )


def index_table_stats(spark: SparkSession, path: str) -> DataFrame:
    """``index_stats`` of the stored index, with ``size_bytes`` as it lies on disk."""
    return index_stats(read_index(spark, path)).withColumn("size_bytes", F.lit(stored_bytes(spark, path)).cast("bigint"))


def stored_status(index: DataFrame) -> DataFrame:
    """Per file of the index: the chunks it holds and the status line."""
    held = index.groupBy("filename").agg(F.count(F.lit(1)).alias("chunks"))
    return held.withColumn("status", F.format_string(STATUS_TEMPLATE, F.col("chunks"), F.col("filename")))


def ingest_status(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Per document: stored chunk count and the status line. The count comes from the
    closed-form chunk count on the document row — no shuffle, no join back."""
    n = n_chunks(F.size(words(F.col("content"))), cfg)
    return docs.select(
        "filename",
        n.cast("bigint").alias("chunks"),
        F.format_string(STATUS_TEMPLATE, n, F.col("filename")).alias("status"),
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "corpusflow", f"{name}-{uuid.uuid4().hex}")
