"""Distributed running totals: rows are range-partitioned by the given order, totals per
partition (one row per partition and group) are summed up front to back, and
each partition adds its own running total. No row passes through a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import written


def with_prefix(rows: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """``rows`` plus, for each ``new: column`` of ``sums``, the exclusive running sum of
    ``column`` in ``order`` (within ``group``, which must then lead ``order``) and its
    group total as ``<new>_total``. Ties in ``order`` take any order among themselves.

    The rows are frozen in the shared folder once they have their partition number,
    because range boundaries come from samples and may differ when computed again.
    """
    frozen = written(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                     .withColumn("_cf_part", F.spark_partition_id()), "prefix")
    keys = ["_cf_part"] + ([group] if group else [])
    totals = frozen.groupBy(*keys).agg(*[F.sum(c).alias(f"_cf_t_{n}") for n, c in sums.items()])
    # One row per partition and group it holds: bounded by partitions + groups.
    spread = Window.partitionBy(*([group] if group else [F.lit(0)]))
    before = spread.orderBy("_cf_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_cf_o_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_cf_t_{n}").over(before), F.lit(0)).alias(f"_cf_b_{n}") for n in sums],
        *[F.sum(f"_cf_t_{n}").over(spread).alias(f"{n}_total") for n in sums])
    on = [F.col(k).eqNullSafe(F.col(f"_cf_o_{k}")) for k in keys]
    within = (Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = frozen.join(F.broadcast(offsets), on, "inner") if not group else frozen.join(offsets, on, "inner")
    for n, c in sums.items():
        joined = joined.withColumn(n, F.col(f"_cf_b_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return joined.select(*rows.columns, *sums, *[f"{n}_total" for n in sums])
