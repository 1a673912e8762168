"""Document chunking (overlapping word windows) and chunk-level projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig
from corpusflow.functions.hashing import chunk_id
from corpusflow.functions.text import words

# Combined search text layout.
COMBINED_FILENAME_PREFIX = "Filename: "
COMBINED_CONTENT_PREFIX = "\nContent: "


def n_chunks(n_words: Column, cfg: ChunkConfig) -> Column:
    """Closed form of the chunk loop: windows start every ``step`` words and the
    loop stops once a window reaches the last word; no words → no chunks."""
    rest = F.greatest(n_words - F.lit(cfg.size), F.lit(0))
    return F.when(n_words <= 0, F.lit(0)).otherwise(
        F.lit(1) + F.ceil(rest / F.lit(cfg.step)).cast("int")
    )


def chunk_documents(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), text_col: str = "content",
                    filename_col: str = "filename", keep: list[str] | None = None,
                    legacy_ids: bool = False) -> DataFrame:
    """One row per chunk: (*keep, filename, chunk_index, chunk_id, content).

    The word array is computed once per document and each chunk string is built
    inside one ``transform``; only finished chunk strings are exploded, so a long
    document is never copied once per chunk. No shuffle: chunking is a narrow map.
    """
    keep = list(keep or [])
    base = docs.select(*keep, F.col(filename_col).alias("filename"), words(F.col(text_col)).alias("_w"))
    nc = n_chunks(F.size("_w"), cfg)
    idx = F.when(nc > 0, F.sequence(F.lit(0), nc - 1)).otherwise(F.array().cast("array<int>"))
    built = F.transform(
        idx,
        lambda i: F.struct(
            i.alias("chunk_index"),
            F.array_join(F.slice(F.col("_w"), i * cfg.step + 1, F.lit(cfg.size)), " ").alias("content"),
        ),
    )
    exploded = base.select(*keep, "filename", F.explode(built).alias("_c"))
    out = exploded.select(
        *keep,
        "filename",
        F.col("_c.chunk_index").cast("int").alias("chunk_index"),
        F.col("_c.content").alias("content"),
    )
    return out.withColumn(
        "chunk_id", chunk_id(F.col("filename"), F.col("chunk_index"), F.col("content"), legacy=legacy_ids)
    ).select(*keep, "filename", "chunk_index", "chunk_id", "content")


def combined_text(filename: Column, content: Column, include_filename: bool = True) -> Column:
    """Text embedded for the combined vector: filename and content, or content alone."""
    if not include_filename:
        return content
    return F.concat(F.lit(COMBINED_FILENAME_PREFIX), filename, F.lit(COMBINED_CONTENT_PREFIX), content)


def fetch_document(chunks: DataFrame, filename: str | None = None, limit: int | None = None) -> DataFrame:
    """The chunks of one document in order (of all given chunks without a ``filename``): all of
    them, or the first ``limit``. Every column comes along, vectors included."""
    found = chunks if filename is None else chunks.where(F.col("filename") == filename)
    found = found.orderBy("chunk_index")
    return found if limit is None else found.limit(limit)
