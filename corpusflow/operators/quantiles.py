"""Exact order statistics per group without gathering a group into one task.

``percentile_disc``/``median`` aggregates buffer every value of a group; with a
group holding most of the table that is one task holding most of the data.
Instead:

1. equal values of a group are counted (partial aggregation), so a repeated value is one row;
2. the counted values are range-partitioned by (group, value) and written once: a large group spreads over ranges;
3. counts per range and group, summed range by range, tell which range holds a requested rank;
4. only rows of those ranges are looked at, with a running sum inside one range of one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.sequences import sequenced


def exact_ranks(df: DataFrame, group: list[str], value: str, requests: DataFrame) -> DataFrame:
    """``requests``: (*group, label, r) with 1-based ascending ranks.
    Returns (*group, label, value_at_rank)."""
    counted = (df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
               .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")))
    rows = sequenced(counted, group, ["_v"])
    ranges = rows.groupBy("_part", *group).agg(F.sum("_n").alias("_held"))
    upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_upto", F.sum("_held").over(upto))

    def same(a: DataFrame, b: DataFrame, names: list[str]):
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names])

    target = (requests.join(ranges, same(requests, ranges, group))
              .where((F.col("r") <= F.col("_upto")) & (F.col("r") > F.col("_upto") - F.col("_held")))
              .select(*[requests[c] for c in group], "label", "_part", (F.col("r") - F.col("_upto") + F.col("_held")).alias("_r")))
    inside = Window.partitionBy("_part", *group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = target.select("_part", *group).distinct()
    near = rows.join(wanted, same(rows, wanted, ["_part", *group]), "left_semi").withColumn("_cum", F.sum("_n").over(inside))
    hit = near.join(target, same(near, target, ["_part", *group])).where(F.col("_cum") >= F.col("_r"))
    return hit.groupBy(*[near[c] for c in group], "label").agg(F.min("_v").alias("value_at_rank"))


def summary_stats(df: DataFrame, group: list[str], value: str, disc: dict[str, float], digits: int = 3) -> DataFrame:
    """Per group: n, mean, interpolating median (``p50``) and nearest-rank
    percentiles (``disc``: label → p, index ceil(p·n)-1 clamped), rounded."""
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"))
    reqs = [
        F.struct(F.lit("_med_lo").alias("label"), (F.floor((F.col("n") - 1) / 2) + 1).cast("bigint").alias("r")),
        F.struct(F.lit("_med_hi").alias("label"), (F.ceil((F.col("n") - 1) / 2) + 1).cast("bigint").alias("r")),
    ]
    for label, p in disc.items():
        r = F.least(F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)), F.col("n")).cast("bigint")
        reqs.append(F.struct(F.lit(label).alias("label"), r.alias("r")))
    requests = base.select(*group, F.explode(F.array(*reqs)).alias("_q")).select(*group, "_q.label", "_q.r")
    vals = exact_ranks(df, group, value, requests)
    found = vals.groupBy(*group).agg(*[F.max(F.when(F.col("label") == name, F.col("value_at_rank"))).alias(f"_s_{name}")
                                       for name in ("_med_lo", "_med_hi", *disc)])
    found = found.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[c for c in found.columns if c not in group])
    out = base.join(found, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]), "left")
    cols = [
        *group,
        F.col("n").cast("bigint").alias("n"),
        F.coalesce(F.round("mean", digits), F.lit(0.0)).alias("mean"),
        F.coalesce(F.round((F.col("_s__med_lo") + F.col("_s__med_hi")) / 2, digits), F.lit(0.0)).alias("p50"),
    ]
    cols += [F.coalesce(F.round(F.col(f"_s_{label}"), digits), F.lit(0.0)).alias(label) for label in disc]
    return out.select(*cols)
