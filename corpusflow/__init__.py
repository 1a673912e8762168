"""corpusflow: corpus ingestion, retrieval and evaluation as Spark DataFrame jobs.

Every public operator takes DataFrames (plus plain Python parameters) and returns a
DataFrame. Neither corpora nor queries pass the driver (see ``plans.cells``).
"""

from corpusflow.config import ChunkConfig, CompressionConfig, SearchConfig, Bm25Config  # noqa: F401
from corpusflow.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = [
    "ChunkConfig",
    "CompressionConfig",
    "SearchConfig",
    "Bm25Config",
    "get_spark",
    "checkpoint_dir",
]
