"""Verbatim containment of many short texts in a large corpus, as an equi-join.

``contains(doc.text, item.text)`` for every (doc, item) pair would be a nested loop join. Instead both sides are
reduced to hashes of fixed-width byte windows that must agree wherever an item occurs:

1. Of every SPAN neighbouring windows of WIDTH bytes, the one with the smallest hash is kept (minimisers). Which ones are kept
   depends on the bytes of those windows alone, so all that an item of WIDTH + SPAN - 1 bytes or more keeps, a text
   that contains it keeps too, at any place.
2. Windows of the items are counted in the corpus. Each item is anchored at its rarest one; an item with a
   window that no document has is in no document.
3. Documents and items meet on the anchor, and ``contains`` confirms each candidate on the JVM.

Shorter items are in length classes of their own (windows of 1, 2, 4, ... bytes, every one kept): a class costs a row per byte of
the corpus and is looked at only if the items have one. Equal item texts are one item. All joins are left to Spark's
choice by size: few items are broadcast, many are shuffled by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans.cells import frozen
from corpusflow.session import bounded_batches

WIDTH, SPAN = 16, 16
#: Window width and span by class: the last one for all texts from WIDTH + SPAN - 1 bytes on, where the windows' order decides.
CLASSES = ((1, 1), (2, 1), (4, 1), (8, 1), (16, 1), (WIDTH, SPAN))
#: Bytes that are hashed together.
_SLAB = 1 << 20
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def length_class(size: int) -> int:
    """The class of an item of so many bytes: the widest whose windows it is sure to share with every text around it."""
    return max(c for c, (width, span) in enumerate(CLASSES) if size >= width + span - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, width: int, span: int) -> np.ndarray:
    """For each place of ``data``, the least hash of the ``span`` windows of ``width`` bytes (powers of two) from there on."""
    if len(data) < width + span - 1:
        return np.zeros(0, np.uint64)
    rolled, power, reach = data.astype(np.uint64) + np.uint64(1), _ODD, 1
    while reach < width:  # the hash of 2n bytes from those of its halves
        rolled = rolled[:-reach] * np.uint64(power) + rolled[reach:]
        power, reach = power * power & _MASK, reach * 2
    least, reach = _mixed(rolled + np.uint64(width)), 1
    while reach < span:  # the least of 2n neighbours from those of their halves
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return least


def text_windows(data: np.ndarray, offsets: np.ndarray, width: int, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of the windows kept of texts that lie one behind the other in ``data``, without neighbouring repeats."""
    reach = width + span - 2
    for start in range(0, max(1, len(data) - reach), _SLAB):
        least = span_hashes(data[start:start + _SLAB + reach], width, span)
        if len(least):
            place = np.arange(start, start + len(least))
            owner = np.searchsorted(offsets, place, side="right") - 1
            first = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]
            first &= place + reach < offsets[owner + 1]  # spans within one text
            yield owner[first], least[first].view(np.int64)


def _windows(rows: DataFrame, classes: list[int]) -> DataFrame:
    """``key, class, hash`` of the windows that are kept of each text, for the given classes."""
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            if not len(texts):
                continue
            _, places, values = texts.buffers()
            offsets = np.frombuffer(places, np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
            data = np.frombuffer(values, np.uint8, count=offsets[-1] - offsets[0], offset=offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            for c in classes:
                for owner, found in text_windows(data, offsets - offsets[0], *CLASSES[c]):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(np.full(len(found), c, np.int32)), pa.array(found)],
                                                     names=["key", "class", "hash"])

    return rows.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(cut, f"key {kind}, class int, hash long")


def contained_items(docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text",
                    item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, doc_key) for every item whose text occurs verbatim in the document.

    Null and empty item texts match nothing (they would match every document); a repeated item or document row gives its
    pairs again.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text")).where(F.col("text").isNotNull())
    wanted, seen = frozen(items.where(F.col(item_text).isNotNull() & (F.length(item_text) > 0)).groupBy(F.col(item_text).alias("text"))
                          .agg(F.count(F.lit(1)).alias("rows")).withColumn("key", F.monotonically_increasing_id())
                          .withColumn("class", _class_of(F.octet_length("text"))), "items", classes=F.collect_set("class"))
    classes = sorted(seen["classes"] or [])
    asked = None
    for c in classes:
        part = _windows(wanted.where(F.col("class") == c), [c])
        asked = part if asked is None else asked.unionByName(part)
    if asked is None:
        return items.select(item_key).limit(0).join(docs.select(doc_key).limit(0))
    asked, _ = frozen(asked, "item-windows")
    hashes = asked.select("class", "hash").distinct()
    # Windows of the corpus that any item has: the only rows of this join that stay.
    hits, _ = frozen(_windows(texts, classes).join(hashes, ["class", "hash"], "left_semi"), "window-hits")
    counts = hits.groupBy("class", "hash").agg(F.count(F.lit(1)).alias("n"))
    anchors = (asked.join(counts, ["class", "hash"], "left").groupBy(F.col("key").alias("item"))
               .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "class", "hash")).alias("a"))
               .where("a.n > 0").select("item", "a.class", "a.hash"))
    candidates = hits.join(anchors, ["class", "hash"]).select("item", "key").distinct()
    found = (candidates.join(wanted.select(F.col("key").alias("item"), F.col("text").alias("needle")), "item")
             .withColumnRenamed("key", "_cf_doc").join(texts, F.col("_cf_doc").eqNullSafe(F.col("key")))
             .where(F.contains(F.col("text"), F.col("needle"))).select("needle", "key"))
    named = items.select(F.col(item_key).alias("_cf_item"), F.col(item_text).alias("needle"))
    return found.join(named, "needle").select(F.col("_cf_item").alias(item_key), F.col("key").alias(doc_key))


def _class_of(size):
    """``length_class`` as a Column."""
    out = F.lit(0)
    for c, (width, span) in enumerate(CLASSES):
        out = F.when(size >= width + span - 1, F.lit(c)).otherwise(out)
    return out
