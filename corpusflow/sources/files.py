"""Text files as a source, with per-file error isolation (quarantine).

``binaryFile`` reads every file as one row (path, length, content bytes); the
routing by suffix, strict UTF-8 validation and quarantine are Column predicates,
so one bad file never fails the job: it becomes a quarantine row with a reason.
``route_files`` takes such rows from any source (a table of stored files, a stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import basename

# Accepted document suffixes (plain text and markdown).
TEXT_SUFFIXES = (".txt", ".md")
REASON_SUFFIX = "unsupported_suffix"
REASON_UTF8 = "invalid_utf8"
REASON_EMPTY = "empty"


def scan_text_files(spark: SparkSession, path: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine).

    documents: (filename, path, content) for readable text files;
    quarantine: (source, key, reason, detail) for every other file.
    """
    return route_files(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path))


def route_files(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of rows of ``path`` and ``content`` (bytes); no content is an empty file."""
    content = F.coalesce(F.col("content"), F.lit(b""))
    name = basename(F.col("path"))
    lower = F.lower(F.coalesce(name, F.lit("")))
    text_suffix = F.lit(False)
    for suffix in TEXT_SUFFIXES:
        text_suffix = text_suffix | lower.endswith(suffix)
    as_text = content.cast("string")
    reason = (F.when(~text_suffix, F.lit(REASON_SUFFIX))
              .when(~F.is_valid_utf8(as_text), F.lit(REASON_UTF8))
              .when(F.octet_length(content) == 0, F.lit(REASON_EMPTY)))
    tagged = raw.select(name.alias("filename"), "path", as_text.alias("content"), reason.alias("reason"))
    docs = tagged.where(F.col("reason").isNull()).select("filename", "path", "content")
    quarantine = tagged.where(F.col("reason").isNotNull()).select(
        F.lit("files").alias("source"), F.col("path").alias("key"), "reason",
        F.format_string("cannot ingest %s: %s", F.col("filename"), F.col("reason")).alias("detail"))
    return docs, quarantine


def assemble_pages(pages: DataFrame, doc: str = "doc", page_no: str = "page_no", text: str = "text") -> DataFrame:
    """Multi-page files: page texts in page order, each followed by a newline."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda x: F.concat(F.coalesce(x["t"], F.lit("")), F.lit("\n"))), "")
        .alias("content"))
