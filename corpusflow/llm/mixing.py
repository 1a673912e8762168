"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a pseudo-random order (hash of the id) and cut into
blocks of ``block_bytes`` by running byte totals. Source s with whole weight c of C
owns the block windows [floor(j*C/c), ceil((j+1)*C/c)): block j is released at the
first and due at the second. Earliest deadline first among released blocks puts every
block into its window, so at every slot t a source that is not used up has more than
t*c/C - 1 and fewer than t*c/C + 1 blocks. The whole weights are the shares themselves
over their common denominator (a float counts as the decimal number it is shown as),
so the bound holds for the shares, however many blocks or sources there are.

The schedule has one row per existing block, and each block depends on those before it:
the driver computes it in order, with one block per source and a bounded part of the rows in
memory, and writes it to the shared folder; documents get their slots from it by a join.

Sources are as many as the data hold: the driver keeps one entry for each.

A document starts in the block that holds its first byte. Slots without a block (a long
document covers several blocks; a source is used up) stay vacant, and
the remaining sources keep their rates to one another. Nothing is dropped or repeated.

Defined results: a null text has size 1, like an empty one (UTF-8 bytes plus 1); a null source is a
source of its own; sources without a positive given weight get 1/PERIOD of the given sum each; repeated
rows are placed one by one (rows that are alike in all columns are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import shared_path, text_key, text_of, written
from corpusflow.llm.prefix_sums import with_prefix

BLOCK_BYTES = 64 << 10
#: Units of rounded weights (``period``), and what a source without a weight is reckoned by.
PERIOD = 1000
#: Copies of a row that one task writes out.
COPIES = 1024


def exact_weights(shares: dict, more: list = ()) -> dict:
    """Shares as whole weights in exactly their proportions; sources of ``more`` get 1/PERIOD of the sum
    each where their share is missing or 0."""
    exact = {k: Fraction(str(v)) for k, v in shares.items()}
    total = sum(exact.values())
    if total <= 0 or any(v < 0 for v in exact.values()):
        raise ValueError("weights must not be negative and need a positive sum")
    exact |= {k: total / PERIOD for k in more if not exact.get(k)}
    exact = {k: v for k, v in exact.items() if v}
    scale = math.lcm(*(v.denominator for v in exact.values()))
    whole = {k: v.numerator * (scale // v.denominator) for k, v in exact.items()}
    common = math.gcd(*whole.values())
    return {k: v // common for k, v in whole.items()}


def whole_weights(shares: dict, period: int = PERIOD) -> dict:
    """Shares to whole units that sum to about ``period`` (largest remainders, at least 1 each)."""
    total = float(sum(shares.values()))
    if not shares or total <= 0 or any(v < 0 for v in shares.values()):
        raise ValueError("weights must not be negative and need a positive sum")
    exact = {k: v * period / total for k, v in shares.items()}
    units = {k: max(1, int(v)) for k, v in exact.items()}
    spare = period - sum(units.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))[:max(0, spare)]:
        units[k] += 1
    return units


def pfair_slots(units: list[int], counts: list[int], total: int) -> Iterator[tuple[int, int, int]]:
    """(source index, block, slot) by slot: earliest deadline first of ``counts`` blocks a source, with
    ``units`` of ``total`` slots each."""
    waiting = [(0, -(-total // c), s, 0) for s, c in enumerate(units) if counts[s]]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        yield s, j, slot
        slot += 1
        if j + 1 < counts[s]:
            c = units[s]
            heapq.heappush(waiting, ((j + 1) * total // c, -(-(j + 2) * total // c), s, j + 1))


def pfair_period(units: list[int]) -> list[tuple[int, int, int]]:
    """(source index, block in period, slot) of one period of ``sum(units)`` slots."""
    return list(pfair_slots(units, units, sum(units)))


def schedule(spark: SparkSession, units: list[int], counts: list[int], total: int, rows: int = 1 << 20) -> DataFrame:
    """``pfair_slots`` as a table (_cf_ps, _cf_pj, _cf_slot), written ``rows`` at a time."""
    if any(-(-n * total // c) >= 1 << 63 for c, n in zip(units, counts)):
        raise ValueError("a weight is so small that its last block's slot is no 64-bit number")
    fields = pa.schema([("_cf_ps", pa.int32()), ("_cf_pj", pa.int64()), ("_cf_slot", pa.int64())])
    kind = "_cf_ps int, _cf_pj long, _cf_slot long"
    path = shared_path(spark, "schedule")
    found = pfair_slots(units, counts, total)
    spark.createDataFrame([], kind).write.parquet(path)
    while part := list(islice(found, rows)):
        part = pa.table([pa.array(c, f.type) for c, f in zip(zip(*part), fields)], schema=fields)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def source_bytes(sized: DataFrame) -> dict:
    """Bytes of each source, from rows of ``_cf_source`` and ``_cf_size``."""
    return {r["s"]: int(r["n"]) for r in sized.groupBy(F.col("_cf_source").alias("s")).agg(F.sum("_cf_size").alias("n")).collect()}


def mix(docs: DataFrame, shares: dict | None = None, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", block_bytes: int = BLOCK_BYTES, period: int | None = None, alpha: float = 0.5) -> DataFrame:
    """One row per document: its source, block, slot, and ``position`` in the mixture (from 0).

    ``shares`` maps sources to target weights; by default they are the sources' bytes to the power ``alpha``
    (1 keeps the corpus's own shares). They are kept exactly unless ``period`` asks for that many whole units.
    """
    placed = _placed(docs, {}, shares, id_col, source_col, text_col, block_bytes, period, alpha)
    return placed.select(
        F.col("_cf_id").alias(id_col), F.col("_cf_key").alias("text_key"), F.col("_cf_source").alias(source_col),
        F.col("_cf_size").alias("size"), F.col("_cf_start").alias("start_byte"), F.col("_cf_block").alias("block"),
        F.col("_cf_slot").alias("slot"), F.col("_cf_position").alias("position"), F.col("_cf_weight").alias("weight"))


def _placed(docs: DataFrame, more: dict[str, Column], shares: dict | None = None, id_col: str = "doc_id", source_col: str = "source",
            text_col: str = "text", block_bytes: int = BLOCK_BYTES, period: int | None = None, alpha: float = 0.5) -> DataFrame:
    """The places of all documents, with the columns ``more``. Texts are read once, for their sizes and keys."""
    keys = {"_cf_id": F.col(id_col), "_cf_key": text_key(text_col), **more}
    sized = written(docs.select(
        *[c.alias(n) for n, c in keys.items()], F.col(source_col).alias("_cf_source"),
        (F.octet_length(text_of(text_col)) + F.lit(1)).cast("long").alias("_cf_size"))
        .withColumn("_cf_shuffle", F.xxhash64("_cf_id", "_cf_key")), "sizes")
    sizes = source_bytes(sized)
    wanted = shares or {s: float(n) ** alpha for s, n in sizes.items()}
    if period:
        units = {**{s: 1 for s in sizes}, **(whole_weights(wanted, period) if wanted else {})}
    else:
        units = exact_weights(wanted, list(sizes)) if wanted else {}
    names = sorted(units, key=lambda s: (s is not None, str(s)))
    total = sum(units.values())
    spark = docs.sparkSession
    source_type = docs.schema[source_col].dataType
    plan = schedule(spark, [units[s] for s in names], [-(-sizes.get(s, 0) // int(block_bytes)) for s in names], total)
    weights = spark.createDataFrame([(s, i, units[s] / total) for i, s in enumerate(names)], T.StructType([
        T.StructField("_cf_ws", source_type), T.StructField("_cf_wi", T.IntegerType()), T.StructField("_cf_weight", T.DoubleType())]))

    blocks = with_prefix(sized, ["_cf_source", "_cf_shuffle", *keys], {"_cf_start": "_cf_size"}, group="_cf_source")
    blocks = blocks.withColumn("_cf_block", F.expr(f"_cf_start div {int(block_bytes)}"))
    blocks = blocks.join(weights, F.col("_cf_source").eqNullSafe(F.col("_cf_ws")))
    slots = (blocks.join(plan, (F.col("_cf_wi") == F.col("_cf_ps")) & (F.col("_cf_block") == F.col("_cf_pj")))
             .withColumn("_cf_one", F.lit(1).cast("long"))
             .select(*keys, "_cf_source", "_cf_size", "_cf_start", "_cf_block", "_cf_slot", "_cf_weight", "_cf_one"))
    # Documents of a slot are all of one source, in the order of their first bytes.
    return with_prefix(slots, ["_cf_slot", "_cf_start"], {"_cf_position": "_cf_one"})


def _row_keys(docs: DataFrame) -> dict[str, Column]:
    """Two 64-bit hashes of all columns of a row."""
    parts = []
    for name, kind in docs.dtypes:
        column = F.col(f"`{name}`")
        parts += [F.to_json(F.struct(column)) if "map<" in kind or kind == "variant" else column, column.isNull()]
    return {"_cf_row1": F.xxhash64(F.lit(1), *parts), "_cf_row2": F.xxhash64(F.lit(2), *parts)}


def mixed(docs: DataFrame, **params) -> DataFrame:
    """``docs`` in the order of the mixture: written out, file after file holds it row by row.

    Rows that are alike in all columns are one row with a number of copies, which take their places one by one:
    one with more than COPIES copies is spread over tasks by that many.
    """
    keys = _row_keys(docs)
    placed = _placed(docs, keys, **params).select(*keys, "_cf_position", "_cf_start", "_cf_size")
    copies = placed.groupBy(*keys).agg(F.min("_cf_start").alias("_cf_first"), F.count(F.lit(1)).alias("_cf_n"))
    # Copies follow each other in the order of their source, so their first bytes number them.
    numbered = placed.join(copies, [*keys]).select(
        *keys, "_cf_position", "_cf_n", F.expr(f"(_cf_start - _cf_first) div _cf_size div {COPIES}").alias("_cf_chunk"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_cf_doc"), *[c.alias(n) for n, c in keys.items()]).dropDuplicates([*keys])
    often = numbered.filter(F.col("_cf_n") > COPIES)
    single = rows.join(numbered.filter(F.col("_cf_n") <= COPIES), [*keys]).select("_cf_doc", "_cf_position")
    spread = (rows.join(often.select(*keys, "_cf_chunk").distinct(), [*keys])
              .join(often, [*keys, "_cf_chunk"]).select("_cf_doc", "_cf_position"))
    return single.unionByName(spread).orderBy("_cf_position").select("_cf_doc.*")
