"""Connected components of a graph given as links between long ids.

Large-star and small-star steps in turn: each replaces links by links to smaller ids
until every component is a star around its smallest id. The steps are grouped minima and
joins on ids, so a vertex with very many links is pre-aggregated before
the shuffle and its joined rows can be split. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import written


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest of the vertex and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    return (both.filter("v > u").join(lowest, F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links run from larger to smaller; a vertex and its smaller neighbours are linked to the smallest of them."""
    lowest = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    rest = (edges.join(lowest, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return rest.union(lowest.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every vertex of ``links`` but the smallest of each component, which is its name."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links")
    before = _digest(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "stars")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
