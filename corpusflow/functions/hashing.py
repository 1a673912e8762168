"""Hash-based Column expressions: content-addressed ids and token buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import words

# Fixed value: the id keeps the first 8 hex digits of the content's md5.
CHUNK_ID_HASH_CHARS = 8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_id(filename, chunk_index, content, legacy: bool = False) -> Column:
    """``{filename}_{chunk_index}_{md5(content)[:8]}``.

    ``legacy=True`` reproduces ids computed before the filename is known
    (``_{chunk_index}_{hash}``), under which equal chunks at the same index of
    different files share an id.
    """
    digest = F.substring(F.md5(_col(content)), 1, CHUNK_ID_HASH_CHARS)
    name = F.lit("") if legacy else _col(filename)
    return F.concat_ws("_", name, _col(chunk_index).cast("string"), digest)


def md5_bucket(token, dim: int) -> Column:
    """First 32 bits of md5(token) as an unsigned integer, modulo ``dim`` (BIGINT)."""
    head = F.conv(F.substring(F.md5(_col(token)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dim).cast("bigint"))


def token_buckets(text, dim: int) -> Column:
    """Lower-cased whitespace tokens mapped to md5 buckets, one entry per token.

    The JVM/SQL statement of the token-hash rule (the DuckDB oracle uses the same
    expression). The search and index paths evaluate the same rule inside their
    Arrow tasks (``functions.udfs.md5_text_buckets``); a test pins the two equal.
    """
    return F.transform(words(F.lower(_col(text))), lambda t: md5_bucket(t, dim))
