"""Every query next to every corpus row, without the driver and without a cross join.

Rows are packed into cells: an Arrow batch of at most CELL_ROWS rows is one binary value. The corpus is cut into
``across`` groups of cells and the queries into ``down`` groups; a query cell is copied to each corpus group, a corpus cell to
each query group, and the two group numbers bring every pair of cells together exactly once.

The query cells are written first, and their bytes decide the shape:

* up to ``max_bytes`` and BROADCAST_BYTES, they are one group that Spark broadcasts; the corpus is one narrow scan, no row of it is shuffled;
* beyond, both sides are shuffled in a grid, each pair of groups to a partition of its own, where the query cells come first: a cell
  is sent to Python once a partition, not once a pair. The grid's sides follow the bytes of both (queries * across + corpus * down is least),
  and no group of queries is larger than GROUP_BYTES, so ten times the queries make more tasks, not larger ones. No side is
  ever held whole anywhere.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import ensure_checkpoint_dir

CELL_ROWS = 2048
#: Bytes of both sides that one task of the grid is meant for.
TASK_BYTES = 256 << 20
#: Query cells of more bytes are not broadcast: each corpus cell goes to Python with each of them.
BROADCAST_BYTES = 8 << 20
#: Bytes of query cells that one task of the grid meets the corpus with: it holds them all.
GROUP_BYTES = 64 << 20


def frozen(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``df`` written as Parquet in the shared folder and read back, with aggregates observed while writing."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "corpusflow", f"{name}-{uuid.uuid4().hex}")
    seen = Observation(name)
    first, *rest = [c.alias(n) for n, c in measures.items()] or [F.count(F.lit(1)).alias("rows")]
    df.observe(seen, first, *rest).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def to_cell(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def of_cell(cell: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(cell.as_buffer()).read_all()


def packed(rows: DataFrame, prepare: Callable[[pa.RecordBatch], pa.RecordBatch | None], cell_rows: int = CELL_ROWS) -> DataFrame:
    """``cell, number, width`` of the rows: ``prepare`` makes the batch that is kept of each slice; ``width`` is the bytes
    of its last column's values, for lists of numbers 8 a number (0 if they have no fixed size)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, cell_rows):
                kept = prepare(batch.slice(start, cell_rows))
                if kept is not None and kept.num_rows:
                    kind = kept.schema.types[-1]
                    width = kind.byte_width if pa.types.is_fixed_size_binary(kind) else 8 * kind.list_size if pa.types.is_fixed_size_list(kind) else 0
                    yield pa.RecordBatch.from_arrays([pa.array([to_cell(kept)], pa.binary()), pa.array([number], pa.int64()),
                                                      pa.array([width], pa.int32())], names=["cell", "number", "width"])
                    number += 1

    return rows.mapInArrow(pack, "cell binary, number long, width int")


def grid(corpus_bytes: int, query_bytes: int, slots: int) -> tuple[int, int]:
    """(across, down): groups of corpus cells and of query cells for about as many tasks as there are slots, or more by size."""
    tasks = max(slots, math.ceil((corpus_bytes + query_bytes) / TASK_BYTES))
    across = min(tasks, max(1, round(math.sqrt(tasks * corpus_bytes / max(1, query_bytes)))))
    return across, math.ceil(tasks / across)


def _labels(spark: SparkSession, n: int) -> DataFrame:
    """``g`` (0 to n - 1) and a number ``x`` that is dealt to the g-th of n partitions: no two groups share one by chance."""
    return spark.range(64 * n).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("g")).agg(F.min("x").alias("x"))


def pairs(queries: DataFrame, query_bytes: int, corpus: DataFrame, max_bytes: int) -> DataFrame:
    """``q, c`` and the query cell's number ``qn``: every query cell with every corpus cell once. Beyond ``max_bytes`` the rows of a
    group ``g`` follow each other, those with a query cell alone first; each row with a corpus cell alone stands for pairs with all of them."""
    spark = corpus.sparkSession
    across = down = 1
    max_bytes = min(max_bytes, BROADCAST_BYTES)
    if query_bytes > max_bytes:
        corpus, seen = frozen(corpus, "corpus-cells", bytes=F.sum(F.octet_length("cell")))
        across, down = grid(int(seen["bytes"] or 0), query_bytes, 2 * spark.sparkContext.defaultParallelism)
        down = max(down, math.ceil(query_bytes / GROUP_BYTES))

    def groups(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def group(n: int) -> Column:
        return F.pmod(F.shiftright("number", 33) + F.col("number").bitwiseAND((1 << 33) - 1), F.lit(n)).cast("int")  # in turn

    left = queries.select(F.col("cell").alias("q"), F.col("number").alias("qn"), group(down).alias("_y"), groups(across).alias("_x"))
    right = corpus.select(F.col("cell").alias("c"), group(across).alias("_x"), groups(down).alias("_y"))
    if query_bytes <= max_bytes:
        return right.join(F.broadcast(left), ["_x", "_y"]).select("q", "qn", "c")
    met = left.unionByName(right, allowMissingColumns=True).withColumn("g", F.col("_x") * down + F.col("_y"))
    met = met.join(F.broadcast(_labels(spark, across * down)), "g", "left").withColumn("x", F.coalesce("x", -1 - F.col("g")))
    return met.repartition(across * down, "x").sortWithinPartitions("g", F.col("q").isNull()).select("g", "q", "qn", "c")
