"""Document fingerprints by Lempel-Ziv phrases.

A text is parsed front to back into dictionary phrases: the shortest run of characters
not yet in the dictionary becomes the next phrase. The set of phrases is hashed, and its
SIZE smallest hashes are the fingerprint. Two fingerprints are alike by the share of
common hashes among the SIZE smallest of both, an estimate of the Jaccard
similarity of the phrase sets (exact for sets of up to SIZE phrases): texts that compress
alike share their phrases.

``neighbour_likeness`` compares each document with an edited version of itself (its last
quarter replaced by the start of the next document) and with the next document, in order of
ids. Documents are sorted within ranges of ids; each range also gets a copy of the first
document behind it, so texts are shuffled once and every task streams through its range.
The edited text shares the parse of its unchanged part.

Defined results: a null text is empty; the empty text has the empty fingerprint, like
itself (1.0) and unlike any other (0.0); ids that are null come first; rows with one id follow the
order of their texts' hashes; the only document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import text_key, text_of, written

SIZE = 128
#: Text bytes of a range of ids, and the most ranges (a range is a sort key, not a memory bound).
RANGE_BYTES = 16 << 20
MAX_RANGES = 20_000
_FIRST = -(1 << 63)


def parse(text: str, seen: set[str], open_phrase: str = "") -> tuple[list[str], str]:
    """New phrases of ``text`` in order, and the unfinished last one; ``seen`` is added to."""
    new, phrase = [], open_phrase
    for character in text:
        phrase += character
        if phrase not in seen:
            seen.add(phrase)
            new.append(phrase)
            phrase = ""
    return new, phrase


def hashed(phrases: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, phrases), np.uint64, len(phrases)) >> np.uint64(16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The SIZE smallest different hashes, in order."""
    return np.unique(hashes)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:][both[1:] == both[:-1]]
    union = np.unique(both)[:SIZE]
    return float(np.searchsorted(twice, union[-1], side="right")) / len(union)


def as_text(found: np.ndarray) -> str:
    return "".join(f"{int(x):012x}" for x in found)


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    return as_text(signature(hashed(parse(text or "", set())[0])))


def with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of ``text`` and of its edited version, and that version."""
    quarter = len(text) // 4
    kept, replaced = text[:len(text) - quarter], following[:quarter]
    seen: set[str] = set()
    head, open_phrase = parse(kept, seen)
    tail, _ = parse(text[len(kept):], seen, open_phrase)
    seen.difference_update(tail)
    other, _ = parse(replaced, seen, open_phrase)
    base = hashed(head)
    return (signature(np.concatenate([base, hashed(tail)])), signature(np.concatenate([base, hashed(other)])), kept + replaced)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and fingerprint. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("_cf_id"), text_of(text_col).alias("_cf_text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _bounds(narrow: DataFrame, range_bytes: int, slots: int) -> np.ndarray:
    """Ids that cut the documents into ranges of about equal bytes: ``range_bytes`` or, of small tables, enough for all slots.
    Finer cuts by rows are weighed first (a few numbers per cut), then joined until a range is full."""
    rows, total = narrow.agg(F.count(F.lit(1)), F.sum("_cf_bytes")).first()
    ranges = int(min(MAX_RANGES, rows, max(2 * slots, -(-(total or 0) // range_bytes))))
    if ranges <= 1:
        return np.empty(0, np.int64)
    fine = min(4 * ranges, 4 * MAX_RANGES)
    cuts = narrow.select(F.col("_cf_order").cast("double").alias("o")).approxQuantile("o", [i / fine for i in range(1, fine)], 1 / (4 * fine))
    cuts = np.unique(np.array(cuts).clip(-2.0**62, 2.0**62).astype(np.int64))

    @F.pandas_udf("int")
    def piece_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right").astype(np.int32))

    held = {r["p"]: r["b"] for r in narrow.groupBy(piece_of("_cf_order").alias("p")).agg(F.sum("_cf_bytes").alias("b")).collect()}
    bounds, size = [], 0
    for piece, cut in enumerate(cuts):
        size += held.get(piece, 0)
        if size >= total / ranges:
            bounds.append(cut)
            size = 0
    return np.array(bounds, np.int64)


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Ids are whole numbers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError("ids must be whole numbers")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    narrow = written(docs.select(order.alias("_cf_order"), text_key(text_col).alias("_cf_key"),
                                 (F.octet_length(text_of(text_col)) + 1).cast("long").alias("_cf_bytes")), "text-sizes")
    bounds = _bounds(narrow, range_bytes, docs.sparkSession.sparkContext.defaultParallelism)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right").astype(np.int32))

    rows = docs.select(F.col(id_col).alias("_cf_id"), order.alias("_cf_order"), text_key(text_col).alias("_cf_key"),
                       text_of(text_col).alias("_cf_text")).withColumn("_cf_range", range_of("_cf_order"))
    # The first document of each range also goes to the end of the range before it (MAX_RANGES rows at most).
    firsts = sorted((r["_cf_range"], r["f"]["_cf_order"], r["f"]["_cf_key"]) for r in
                    narrow.groupBy(range_of("_cf_order").alias("_cf_range")).agg(F.min(F.struct("_cf_order", "_cf_key")).alias("f")).collect())
    before = [(*f[1:], firsts[i - 1][0]) for i, f in enumerate(firsts)]
    firsts_df = F.broadcast(docs.sparkSession.createDataFrame(before, "_cf_forder long, _cf_fkey long, _cf_before int"))
    placed = rows.join(firsts_df, (F.col("_cf_order") == F.col("_cf_forder")) & (F.col("_cf_key") == F.col("_cf_fkey")), "left")
    own = F.struct(F.col("_cf_range").alias("range"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("_cf_before").alias("range"), F.lit(1).alias("copy"))
    placed = placed.withColumn("_cf_to", F.explode(F.when(F.col("_cf_before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    placed = placed.select(F.col("_cf_to.range").alias("_cf_range"), F.col("_cf_to.copy").alias("_cf_copy"),
                           "_cf_order", "_cf_key", "_cf_id", "_cf_text")
    streams = (placed.repartitionByRange(len(bounds) + 1, "_cf_range").sortWithinPartitions("_cf_range", "_cf_copy", "_cf_order", "_cf_key")
               .select("_cf_range", "_cf_copy", "_cf_id", "_cf_text"))

    arrow_id = {"byte": pa.int8(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64()}[kind.typeName()]
    schema = pa.schema([("id", arrow_id), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
            out.clear()
            return batch

        held = None  # range, id, text of the document that waits for its next one
        waiting = None  # its predecessor's row, which waits for the held document's signature
        for batch in batches:
            for rng, copied, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] == rng:
                    own_sig, edited_sig, edited = with_edit(held[2], text)
                    if waiting is not None:
                        out.append((*waiting[1], likeness(waiting[0], own_sig)))
                    waiting = (own_sig, (held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                         as_text(own_sig), as_text(edited_sig), likeness(own_sig, edited_sig)))
                    if copied:  # the range is done
                        last = signature(hashed(parse(text, set())[0]))
                        out.append((*waiting[1], likeness(waiting[0], last)))
                        held = waiting = None
                        continue
                # Further copies of a first document (repeated rows) find no held document.
                held = None if copied else (rng, doc_id, text)
            if len(out) >= 500:
                yield flush()
        yield flush()

    fields = f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, " \
             "edited_fingerprint string, near_edited double, near_next double"
    return streams.mapInArrow(run, fields).withColumnRenamed("id", id_col)
