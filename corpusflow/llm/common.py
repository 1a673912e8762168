"""Helpers shared by the operators of this subpackage.

Row conventions
---------------
* A null text is the empty text; it has no words.
* Operators select the columns they need first, under private names starting
  with ``_cf_``, so extra columns of the input cannot clash.
* A repeated row is a row of its own: results are per input row unless an
  operator says otherwise.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import bounded_batches, ensure_checkpoint_dir  # noqa: F401  (batches: for the operators)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

#: Fixed value: everything that is not a word character (ASCII digits, a-z, all non-ASCII).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same word rule over UTF-8 bytes: A-Z become a-z, ASCII separators become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else. Pure ASCII texts take the plain ``lower``."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, _UPPER, _LOWER)))


def words_of(text: Column) -> Column:
    """Lower-cased words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) in order of the text."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def word_bytes(data: bytes | None) -> list[bytes]:
    """``words_of`` for UTF-8 bytes inside a Python task."""
    return data.translate(WORD_BYTES).split() if data else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(column: str) -> Column:
    """64-bit key of a text (null and empty share one)."""
    return F.xxhash64(text_of(column))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the cluster's shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "corpusflow-llm", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage
    and freezes the rows, so that a lost executor never recomputes them differently."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
