"""The store contract over a stored index, and a registry of stores by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.config import HASH_DIM, ChunkConfig
from corpusflow.operators import maintenance as mt
from corpusflow.operators.chunking import fetch_document
from corpusflow.operators.embedding import EmbeddingProvider
from corpusflow.operators.search import search


class IndexStore:
    """Documents in, ranked chunks out: a Parquet index at ``path`` and the embedder that built it."""

    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[], EmbeddingProvider] | None = None,
                 cfg: ChunkConfig = ChunkConfig(), buckets: int | None = None):
        self.spark, self.path, self.embedder, self.cfg = spark, path, embedder, cfg
        self.info = mt.create_index(spark, path, embedder().dimension if embedder else HASH_DIM, buckets=buckets)

    def rows(self) -> DataFrame:
        return mt.read_index(self.spark, self.path)

    def store(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Documents (``filename, content``) replace their former versions; those with a text that can't be embedded are
        returned (``filename, reason``) and not stored."""
        from pyspark.sql import functions as F

        from corpusflow.plans.cells import frozen

        rows, _ = frozen(mt.index_rows(docs, self.cfg, dim=self.info.dimension, keep=keep, embedder=self.embedder, buckets=self.info.buckets), "store")
        _, bad = mt.index_parts(rows, self.info.dimension)
        bad = bad.groupBy("filename").agg(F.min("reason").alias("reason"))
        mt.replace_in_index(rows.join(bad, "filename", "left_anti"), self.path, stored=True)
        return bad

    def search(self, queries: DataFrame, **options) -> DataFrame:
        return search(self.rows(), queries, vectors="stored", embedder=self.embedder, **options) if self.embedder else search(self.rows(), queries, **options)

    def fetch(self, filename: str) -> DataFrame:
        """The chunks of one file, in order."""
        from pyspark.sql import functions as F

        return fetch_document(self.rows().where((F.col("bucket") == mt.bucket_of(F.lit(filename), self.info.buckets)) & (F.col("filename") == filename)))

    def delete(self, filenames: DataFrame) -> bool:
        """Remove the listed files; whether any chunk went."""
        return mt.delete_from_index(self.spark, self.path, filenames) > 0

    def status(self) -> DataFrame:
        return mt.stored_status(self.rows())

    def stats(self) -> DataFrame:
        return mt.index_table_stats(self.spark, self.path)


_STORES: dict[str, Callable[..., object]] = {"parquet": IndexStore}


def register_store(name: str, factory: Callable[..., object]) -> None:
    _STORES[name.strip().lower()] = factory


def create_store(name: str, *args, **options):
    """The store registered under ``name``, made with the given arguments."""
    key = name.strip().lower()
    if key not in _STORES:
        raise ValueError(f"no store is registered as {key!r}; registered: {', '.join(sorted(_STORES))}")
    return _STORES[key](*args, **options)
