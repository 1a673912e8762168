"""Approximate top-k vector search (opt-in): inverted lists around k-means centroids, exact scores inside the probed lists.

Build. Centroids are fitted on a bounded sample; every row of the corpus is then assigned to its nearest one.
A list is cut into slices of about CELL_ROWS rows, each packed into one row of the index table, so a list that holds a
third of the corpus is many rows of it. ``probes``, the number of lists a query looks at, is chosen by measurement: the exact
neighbours of CALIBRATION sampled rows must lie in the nearest ``probes`` lists with share ``recall``.

Search. A query goes to its nearest ``probes`` lists; queries of a list are packed in slices as well, and an equi-join on the
list brings them to its slices. Scores are exact cosines; the merge is that of the exact search.

Bounds, all of them parameters of the fit and none of the data indexed: SAMPLE_ROWS rows for the centroids, MAX_LISTS lists,
CALIBRATION rows for the probes. Rows without a vector are not indexed; queries without one find nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.vector_search import knn_topk, ranked, vector_matrix
from corpusflow.plans.cells import CELL_ROWS, frozen, to_cell

SAMPLE_ROWS = 65_536
MAX_LISTS = 4096
ROWS_PER_LIST = 256
CALIBRATION = 256


@dataclass
class AnnIndex:
    """``lists`` (list, slice, cell) and what is needed to search them."""

    lists: DataFrame
    centroids: np.ndarray
    probes: int
    key: str
    payload: list[str]
    kinds: dict[str, T.DataType] = field(default_factory=dict)


def kmeans(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors; an empty one stays where it was."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(1))
        moved = length > 0
        centroids[moved] = sums[moved] / length[moved, None]
    return centroids


def _sample(rows: DataFrame, key: str, vec: str, n: int, salt: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of their keys."""
    return rows.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(salt)), key).limit(n)


def _to_lists(rows: DataFrame, vec: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows with a vector once for each of their nearest ``probes`` lists: ``list``, the other columns, ``_v``."""
    rest = [c for c in rows.columns if c != vec]
    near = rows.sparkSession.sparkContext.broadcast(centroids)  # MAX_LISTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = near.value.shape[1]
        for batch in batches:
            batch = batch.filter(batch.column(vec).is_valid())
            for start in range(0, batch.num_rows, CELL_ROWS):
                part = batch.slice(start, CELL_ROWS)
                matrix = vector_matrix(part.column(vec), "dense", dim)
                scores = matrix @ near.value.T
                lists = np.argpartition(-scores, probes - 1, axis=1)[:, :probes] if probes < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(matrix), 1))
                at = np.repeat(np.arange(len(matrix)), lists.shape[1])
                vectors = pa.array([v.tobytes() for v in np.ascontiguousarray(matrix, "<f8")], pa.binary()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), *(part.column(c).take(pa.array(at)) for c in rest), vectors],
                                                 names=["list", *rest, "_v"])

    schema = T.StructType([T.StructField("list", T.IntegerType()), *(rows.schema[c] for c in rest), T.StructField("_v", T.BinaryType())])
    return rows.mapInArrow(assign, schema)


def _sliced(rows: DataFrame, key: str, name: str, width: int) -> DataFrame:
    """``list, slice`` and the rows of each slice packed in ``name``, sorted by key."""
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_slices"))
    cut = rows.join(F.broadcast(sizes), "list").withColumn("slice", F.pmod(F.xxhash64(key), F.col("_slices")).cast("int")).drop("_slices")
    kept = [c for c in rows.columns if c not in ("list", "_v")]

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, sort_keys=[(key, "ascending")], null_placement="at_start"))
        vectors = group.column("_v").combine_chunks().cast(pa.binary(width))
        cell = to_cell(pa.table([*(group.column(c) for c in kept), vectors], names=[*kept, "_v"]).combine_chunks())
        return pa.table({"list": group.column("list")[:1], "slice": group.column("slice")[:1], name: pa.array([cell], pa.binary())})

    return cut.groupBy("list", "slice").applyInArrow(pack, f"list int, slice int, {name} binary")


def build_ann(corpus: DataFrame, *, key: str, vec: str, payload: Iterable[str] = (), k: int = 3, recall: float = 0.95) -> AnnIndex:
    """Index of the corpus rows that have a vector. ``k`` and ``recall`` are what ``probes`` is measured for."""
    payload = [p for p in payload if p != key]
    rows = corpus.select(key, *payload, F.col(vec).alias("_vec"))
    n = rows.where(F.col("_vec").isNotNull()).count()
    lists = max(1, min(MAX_LISTS, n // ROWS_PER_LIST))
    sample = _sample(rows, key, "_vec", min(SAMPLE_ROWS, 32 * lists), 1).select("_vec").toArrow().column("_vec").combine_chunks()
    if not len(sample):
        return AnnIndex(rows.sparkSession.createDataFrame([], "list int, slice int, c binary"), np.zeros((1, 1)), 1, key, payload,
                        {c: rows.schema[c].dataType for c in [key, *payload]})
    centroids = kmeans(vector_matrix(sample, "dense", None), lists)
    assigned, _ = frozen(_to_lists(rows, "_vec", centroids, 1), "ann-rows")
    probes = _calibrated(rows, assigned, centroids, key, k, recall)
    packed, _ = frozen(_sliced(assigned, key, "c", 8 * centroids.shape[1]), "ann-lists")
    return AnnIndex(packed, centroids, probes, key, payload, {c: rows.schema[c].dataType for c in [key, *payload]})


def _calibrated(rows: DataFrame, assigned: DataFrame, centroids: np.ndarray, key: str, k: int, recall: float) -> int:
    """The least number of lists that hold a ``recall`` share of the exact neighbours of CALIBRATION sampled rows."""
    asked, _ = frozen(_sample(rows, key, "_vec", CALIBRATION, 2).select(F.col(key).alias("_q"), F.col("_vec").alias("_qv")), "ann-sample")
    exact = knn_topk(rows, asked, corpus_key=key, corpus_vec="_vec", query_key="_q", query_vec="_qv", k=k, query_name="_q")
    held = exact.join(assigned.select(key, "list"), key).select("_q", "list").collect()  # CALIBRATION * k rows
    sample = asked.toArrow()
    order = np.argsort(-(vector_matrix(sample.column("_qv").combine_chunks(), "dense", centroids.shape[1]) @ centroids.T), axis=1, kind="stable")
    place = {q: {int(c): i for i, c in enumerate(row)} for q, row in zip(sample.column("_q").to_pylist(), order)}
    ranks = sorted(place[r["_q"]][r["list"]] for r in held)
    return ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1


def ann_topk(index: AnnIndex, queries: DataFrame, *, query_key: str, query_vec: str, k: int, score_offset: float = 0.0,
             digits: int = 6, query_name: str = "query_id", probes: int | None = None) -> DataFrame:
    """(query_name, key, *payload, score, rank): the ``k`` best rows of the lists that each query probes."""
    probes = min(probes or index.probes, len(index.centroids))
    asked = _to_lists(queries.select(F.col(query_key).alias("_q"), F.col(query_vec).alias("_qv")), "_qv", index.centroids, probes)
    asked = _sliced(asked, "_q", "q", 8 * index.centroids.shape[1])
    asked = asked.withColumn("qn", F.col("list").cast("long") * (1 << 32) + F.col("slice")).drop("slice")
    out = T.StructType([T.StructField(query_name, queries.schema[query_key].dataType, True),
                        *(T.StructField(c, index.kinds[c], True) for c in [index.key, *index.payload]), T.StructField("score", T.DoubleType(), True)])
    return ranked(index.lists.select("list", "c").join(asked, "list"), out, index.key, index.payload, k, score_offset, digits)
