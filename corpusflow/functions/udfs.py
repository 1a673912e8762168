"""Arrow-batched Python helpers (never row-at-a-time UDFs).

Only work Spark has no built-in for lives here: BLAKE2b token hashing, dense
histogram construction and the full HTML entity table.
"""

from __future__ import annotations

import hashlib
import html
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dense_from_buckets(bucket_lists, dim: int, normalise: bool = True) -> np.ndarray:
    """Rows of bucket ids → (n, dim) float64 count matrix, optionally L2-normalised.

    Zero rows stay zero (the reference divides by 1 when the norm is 0).
    """
    n = len(bucket_lists)
    if n == 0:
        return np.zeros((0, dim), dtype=np.float64)
    lens = np.fromiter((0 if b is None else len(b) for b in bucket_lists), dtype=np.int64, count=n)
    total = int(lens.sum())
    if total == 0:
        return np.zeros((n, dim), dtype=np.float64)
    flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in bucket_lists if b is not None and len(b)])
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    mat = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
    if normalise:
        norms = np.sqrt((mat * mat).sum(axis=1))
        norms[norms == 0] = 1.0
        mat /= norms[:, None]
    return mat


def md5_text_buckets(texts, dim: int) -> list[np.ndarray]:
    """Per text: md5 bucket of every lower-cased whitespace token (Python's own
    ``lower().split()``). Each distinct token is hashed once per call (natural text
    repeats most tokens, so this is several times cheaper than hashing each one)."""
    memo: dict[str, int] = {}
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        ids = []
        for tok in text.lower().split():
            b = memo.get(tok)
            if b is None:
                b = int.from_bytes(hashlib.md5(tok.encode("utf-8")).digest()[:4], "big") % dim
                memo[tok] = b
            ids.append(b)
        out.append(np.asarray(ids, dtype=np.int64))
    return out


def md5_text_vectors(dim: int, single: bool = False):
    """pandas_udf: text → L2-normalised md5-bucket count vector (ARRAY<DOUBLE|FLOAT>)."""
    elem = T.FloatType() if single else T.DoubleType()

    @F.pandas_udf(T.ArrayType(elem))
    def _vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            buckets = md5_text_buckets(list(texts), dim)
            mat = dense_from_buckets(buckets, dim)
            if single:
                mat = mat.astype(np.float32)
            yield pd.Series([None if b is None else row for b, row in zip(buckets, mat)])

    return _vec


def blake2b_buckets(text: str, dim: int) -> list[int]:
    """Reference hash embedder's token → bucket rule (8-byte BLAKE2b, big-endian, mod dim)."""
    out = []
    for token in (text or "").lower().split():
        digest = hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest()
        out.append(int.from_bytes(digest, "big") % dim)
    return out


def blake2b_embed(dim: int):
    """pandas_udf: text → L2-normalised ARRAY<DOUBLE> of length ``dim``."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            mat = dense_from_buckets([blake2b_buckets(t, dim) for t in texts], dim)
            yield pd.Series(list(mat))

    return _embed


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_unescape_nodes(nodes: pd.Series) -> pd.Series:
    """Full HTML5 entity decoding of every text node (stdlib table)."""
    return nodes.map(lambda arr: None if arr is None else [html.unescape(x) for x in arr])
