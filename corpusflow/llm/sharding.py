"""Sharding: global byte-size prefix sums, cut at equal targets, give contiguous
shards of near-equal size.

Rows are ordered by id (nulls first), or as told, then by text checksum and size. A document goes
to the shard in whose byte range its middle lies, so every shard border is off its
target by half a document at most. Slots count the documents of a shard from 0.

Defined results: a null text has size 1, like an empty one (UTF-8 bytes plus 1); a
document longer than a shard's target may leave neighbours empty; repeated rows take
slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import text_of, written
from corpusflow.llm.prefix_sums import with_prefix


def balanced_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    order: list[Column] | None = None) -> DataFrame:
    """One row per document: id, size, checksum, shard, slot. Texts are read once and
    never shuffled; only these few numbers are. ``order`` replaces the order by id."""
    if shards < 1:
        raise ValueError("shards must be positive")
    leading = {f"_cf_order{i}": c for i, c in enumerate(order or [])}
    rows = written(docs.select(
        *[c.alias(n) for n, c in leading.items()],
        F.col(id_col).alias("_cf_id"),
        (F.octet_length(text_of(text_col)) + F.lit(1)).cast("long").alias("_cf_size"),
        F.crc32(text_of(text_col).cast("binary")).alias("_cf_crc"), F.lit(1).cast("long").alias("_cf_one")), "sizes")
    placed = with_prefix(rows, [*leading, "_cf_id", "_cf_crc", "_cf_size"], {"_cf_start": "_cf_size", "_cf_rank": "_cf_one"})
    # Middle of the document on the byte line, doubled to stay in whole numbers.
    shard = F.expr(f"cast((2 * _cf_start + _cf_size) * {int(shards)}L div (2 * _cf_start_total) as int)")
    placed = placed.withColumn("_cf_shard", shard)
    first = (placed.groupBy(F.col("_cf_shard").alias("_cf_fs")).agg(F.min("_cf_rank").alias("_cf_first")))
    # One row per shard.
    out = placed.join(F.broadcast(first), F.col("_cf_shard") == F.col("_cf_fs"))
    return out.select(F.col("_cf_id").alias(id_col), F.col("_cf_size").alias("size"), F.col("_cf_crc").alias("text_crc32"),
                      F.col("_cf_shard").alias("shard"), (F.col("_cf_rank") - F.col("_cf_first")).alias("slot"))
