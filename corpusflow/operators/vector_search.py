"""Exact top-k vector search of many queries against a corpus.

Plan shape:

    corpus scan ─(filters pushed to Parquet)─► mapInArrow[vectors of a batch → one cell]
        ─► join with the query cells (broadcast up to a measured size, a shuffled grid beyond: ``plans.cells``)
        ─► mapInArrow[products of two cells, local top-k] ─► Exchange(hashpartitioning(query_id)) ─► row_number() <= k
        ─► join with the payload of the rows found

* Neither side passes the driver. A corpus row is embedded and packed once, however many queries there are. Cells hold
  numbers as narrow as they came (token counts in 16 bits); they become unit vectors where they are multiplied.
* Token counts are searched exactly without the score of every pair: cheaper products rule out the pairs that stay below the
  k-th best score their query has so far (``counts``).
* Scores are ``round(cos + offset, digits)``; ties break on the corpus key. Cells are sorted by key, so a cell's
  candidates are cut exactly, and the shuffle carries at most ``k`` narrow rows per query, cell group and task.
* Payload columns (content, filename, …) never enter a cell: the corpus rows are numbered and written once, cells carry
  the number, and a join on it brings the payload to the ``k`` rows of each query. What a task holds does not depend
  on how wide the rows are or how many queries there are.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.config import SearchConfig
from corpusflow.functions.udfs import dense_from_buckets, md5_text_buckets
from corpusflow.operators.counts import CorpusCounts, Counts, margin
from corpusflow.plans.cells import GROUP_BYTES, frozen, of_cell, packed, pairs
from corpusflow.session import bounded_batches

#: Candidates that a task holds before it cuts them, and hands them on if that leaves more than half as many.
MAX_HELD = 1 << 20
#: Queries that are multiplied with one corpus cell at a time.
BLOCK_QUERIES = 512
#: Rows of its first cell that give a query its first bound.
SEED_ROWS = 512
#: A query with more candidates in a cell is scored against the whole cell, which cuts ties exactly.
MANY = 64
#: A row's number in the corpus as written, for corpora with a payload.
ROW = "_cf_row"


def _normalise(mat: np.ndarray) -> np.ndarray:
    norms = np.sqrt((mat * mat).sum(axis=1))
    norms[norms == 0] = 1.0
    return mat / norms[:, None]


def number_matrix(column: pa.Array, kind: str, dim: int | None) -> np.ndarray:
    """Numbers (a vector a row) of a column without nulls, as narrow as they are given: vectors, or counts of token buckets
    or of texts to be embedded."""
    if kind in ("buckets", "text"):
        lists = column.to_pylist() if kind == "buckets" else md5_text_buckets(column.to_pylist(), dim)
        counts = dense_from_buckets(lists, dim, normalise=False)
        return counts.astype(np.uint16) if not len(counts) or counts.max() < 1 << 16 else counts
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = dim if dim is not None else int(lengths[0])
    odd = int((lengths != width).sum())
    if odd:
        raise ValueError(f"{odd} vectors of a batch do not have dimension {width}; separate them first (embedding.split_by_contract)")
    numbers = column.flatten().to_numpy(zero_copy_only=False)
    return (numbers if numbers.dtype in (np.float32, np.float64) else numbers.astype(np.float64)).reshape(-1, width)


def vector_matrix(column: pa.Array, kind: str, dim: int | None) -> np.ndarray:
    """Unit vectors (rows) of a column without nulls."""
    return _normalise(number_matrix(column, kind, dim).astype(np.float64))


def _cells(rows: DataFrame, key: str, vec: str, kind: str, dim: int | None) -> DataFrame:
    """Cells of the rows with a vector, sorted by key: all columns but the vector, then the vector's numbers."""
    rest = [c for c in rows.columns if c != vec]

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(batch.column(vec).is_valid())
        if not batch.num_rows:
            return None
        batch = batch.take(pa.compute.sort_indices(batch, sort_keys=[(key, "ascending")], null_placement="at_start"))
        matrix = number_matrix(batch.column(vec), kind, dim)
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), vectors], names=[*rest, "_v"])

    return packed(rows, prepare)


def _numbers(table: pa.Table) -> np.ndarray | None:
    """Token counts of a cell (16 bits), None for other vectors."""
    column = table.column("_v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_fixed_size_list(column.type) or column.type.value_type != pa.uint16():
        return None
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _vectors(table: pa.Table) -> np.ndarray:
    """Unit vectors of a cell: its numbers normalised, or the bytes of unit vectors."""
    column = table.column("_v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_fixed_size_list(column.type):
        return _normalise(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))
    width = column.type.byte_width
    return np.frombuffer(column.buffers()[1], "<f8", count=len(column) * (width // 8), offset=column.offset * width).reshape(len(column), -1)


class TopK:
    """The best ``k`` corpus rows of each query of one cell, over the corpus cells seen so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.size = k, 0
        #: Scores below these can't be among the best any more.
        self.floor = np.full(queries, -np.inf)
        #: The best ``k`` scores so far, rising.
        self.best = np.full((queries, k), -np.inf)
        self.held: list[pa.Table] = []

    def add(self, scores: np.ndarray, rows: pa.Table, valid: np.ndarray | None = None, first: int = 0, digits: int | None = None,
            who: np.ndarray | None = None) -> None:
        """``scores`` (queries from number ``first`` on, or ``who``, by rows) of rows that are sorted by key; they are rounded to ``digits``."""
        def exact(values: np.ndarray) -> np.ndarray:
            return values if digits is None else np.round(values, digits)

        if valid is not None:
            scores = np.where(valid, scores, -np.inf)
        who = np.arange(first, first + len(scores)) if who is None else who
        floor = self.floor[who]
        near = scores >= (floor if digits is None else floor - 10.0 ** -digits)[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > self.k)
        if len(many):  # their k-th best here is a bound too; of those equal to it, the first by key
            best = exact(scores[many])
            kth = -np.partition(-best, self.k - 1, axis=1)[:, self.k - 1]
            lowest = np.maximum(floor[many], kth)
            above, equal = best > lowest[:, None], (best == lowest[:, None]) & (best > -np.inf)
            near[many] = above | (equal & (np.cumsum(equal, axis=1) <= (self.k - above.sum(axis=1))[:, None]))
            floor[many] = lowest
        at, row = np.nonzero(near)
        found = exact(scores[at, row])
        self.keep(who[at], row, found, rows)

    def keep(self, at: np.ndarray, row: np.ndarray, scores: np.ndarray, rows: pa.Table) -> None:
        """Rounded ``scores`` of queries ``at`` with single rows; at most the best ``k`` of a query are kept, of equal ones the first."""
        good = (scores >= self.floor[at]) & (scores > -np.inf)
        at, row, scores = at[good], row[good], scores[good]
        if not len(at):
            return
        order = np.lexsort((row, -scores, at))
        at, row, scores = at[order], row[order], scores[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        for p in range(min(self.k, int(place.max()) + 1)):
            these = np.flatnonzero(place == p)
            best = self.best[at[these]]
            best[:, 0] = np.maximum(best[:, 0], scores[these])
            best.sort(axis=1)
            self.best[at[these]] = best
        kept = place < self.k
        at, row, scores = at[kept], row[kept], scores[kept]
        self.floor[at] = np.maximum(self.floor[at], self.best[at, 0])
        self.held.append(rows.take(pa.array(row)).append_column("_score", pa.array(scores)).append_column("_at", pa.array(at)))
        self.size += len(at)

    def cut(self, key: str) -> pa.Table | None:
        """Keep the best ``k`` of each query only."""
        if not self.held:
            return None
        table = pa.concat_tables(self.held)
        if len(self.held) > 1:
            table = table.take(pa.compute.sort_indices(table, sort_keys=[("_at", "ascending"), ("_score", "descending"), (key, "ascending")],
                                                       null_placement="at_start"))
            at = table.column("_at").to_numpy()
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            table = table.filter(pa.array(place < self.k))
        self.held, self.size = [table], table.num_rows
        return table


def knn_topk(corpus: DataFrame, queries: DataFrame, *, corpus_key: str, corpus_vec: str | Column,
             query_key: str, query_vec: str, k: int, kind: str = "dense", dim: int | None = None,
             score_offset: float = 0.0, payload: Iterable[str] = (), exclude_self: bool = False,
             digits: int = 6, max_block_bytes: int = SearchConfig().max_block_bytes,
             query_name: str = "query_id") -> DataFrame:
    """Exact cosine top-k: for every query row, the ``k`` best corpus rows.

    ``kind='dense'``: vector columns are ARRAY<FLOAT|DOUBLE>; ``kind='buckets'``:
    ARRAY<BIGINT> token buckets, densified to ``dim`` counts inside the task;
    ``kind='text'``: STRING columns embedded inside the task with the md5 token-hash
    embedding (tokenised and hashed in the same Arrow batch that is packed). ``corpus_vec`` may be an expression over the
    corpus' columns. Query cells of up to ``max_block_bytes`` together, and ``cells.BROADCAST_BYTES``, are broadcast. Returns (query_name, corpus_key, *payload,
    score, rank).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if dim is None and kind != "dense":
        raise ValueError("dim is required for bucket and text vectors")
    bounded_batches(corpus.sparkSession)
    payload = [p for p in payload if p != corpus_key]
    vector = F.col(corpus_vec) if isinstance(corpus_vec, str) else corpus_vec
    if payload:
        needed = dict.fromkeys([corpus_key, *payload, corpus_vec] if isinstance(corpus_vec, str) else corpus.columns)
        corpus, _ = frozen(corpus.select(*needed, F.monotonically_increasing_id().alias(ROW)), "corpus-rows")
    carried = [ROW] if payload else []
    out = T.StructType(
        [T.StructField(query_name, queries.schema[query_key].dataType, True)]
        + [T.StructField(c, corpus.schema[c].dataType, True) for c in [corpus_key, *carried]]
        + [T.StructField("score", T.DoubleType(), True)])
    asked, seen = frozen(
        _cells(queries.select(F.col(query_key).alias("_q"), F.col(query_vec).alias("_qv")), "_q", "_qv", kind, dim), "query-cells",
        bytes=F.sum(F.octet_length("cell")), least=F.min("width"), most=F.max("width"))
    if seen["least"] != seen["most"]:
        raise ValueError(f"query vectors have mixed dimensions {[seen['least'] // 8, seen['most'] // 8]}")
    if seen["most"] is not None:
        dim = seen["most"] // 8  # one dimension for both sides: another one in the corpus fails in its task
    # NULL vectors are dropped inside the task: a Filter here would evaluate a derived vector expression twice.
    known = _cells(corpus.select(corpus_key, *carried, vector.alias("_cv")), corpus_key, "_cv", kind, dim)
    met = pairs(asked, int(seen["bytes"] or 0), known, max_block_bytes)
    best = ranked(met, out, corpus_key, carried, k, score_offset, digits, exclude_self)
    if payload:
        best = best.join(corpus.select(ROW, *payload), ROW)
    return best.select(query_name, corpus_key, *payload, "score", "rank")


def ranked(met: DataFrame, out: T.StructType, key: str, payload: list[str], k: int, offset: float, digits: int,
           exclude_self: bool = False) -> DataFrame:
    """The best ``k`` rows of each query from pairs of cells (``q, qn, c``), with their ``rank``. ``out`` is the query's column,
    the key, the payload and the score. Rows may have a group ``g``; in a group, rows with ``q`` alone come first, and those with ``c``
    alone are paired with all of them."""
    query_name = out.fields[0].name

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[pa.Table, np.ndarray | Counts, TopK]] = {}
        group, known = None, (None, None, None)

        def handed_on() -> Iterator[pa.RecordBatch]:
            """The candidates held; queries and their bounds stay."""
            for asked, _, top in best.values():
                table = top.cut(key)
                if table is not None:
                    columns = [asked.column("_q").combine_chunks().take(table.column("_at")), *(table.column(c) for c in [key, *payload, "_score"])]
                    yield from pa.Table.from_arrays(columns, names=[f.name for f in out.fields]).to_batches(max_chunksize=10_000)
                top.held, top.size = [], 0

        def bounded() -> Iterator[pa.RecordBatch]:
            if sum(t.size for _, _, t in best.values()) > MAX_HELD:
                for _, _, top in best.values():
                    top.cut(key)
                if sum(t.size for _, _, t in best.values()) > MAX_HELD // 2:
                    yield from handed_on()

        def hold(q: pa.Scalar, number: int) -> None:
            asked = of_cell(pa.scalar(q.as_py(), pa.binary()))  # a copy: the batch is not kept for it
            numbers = _numbers(asked)
            best[number] = asked.drop_columns(["_v"]) if numbers is not None else asked, None if numbers is None else Counts(numbers), TopK(asked.num_rows, k)

        def meet(number: int, rows: pa.Table, cell: np.ndarray | CorpusCounts) -> None:
            asked, counts, top = best[number]

            def others(who: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray | None:
                return own[who][:, None] != keys[None, first:end] if exclude_self else None

            own, keys = (asked.column("_q").to_numpy(), rows.column(key).to_numpy()) if exclude_self else (None, None)
            if isinstance(cell, CorpusCounts) and counts is not None:
                def whole(who: np.ndarray, start: int, end: int) -> None:
                    for first in range(0, len(who), BLOCK_QUERIES):
                        block = who[first:first + BLOCK_QUERIES]
                        scores = cell.all_cosines(counts, block, start, end)
                        scores += offset
                        top.add(scores, rows.slice(start, end - start), others(block, start, end), digits=digits, who=block)

                start, end = 0, len(cell)
                if not np.isfinite(top.floor).any():
                    start = min(SEED_ROWS, end)
                    whole(np.arange(len(counts)), 0, start)
                least = top.floor - offset - 10.0 ** -digits
                cold = ~(least > margin(counts.numbers.shape[1]))
                at, row = cell.candidates(counts, np.flatnonzero(~cold), least)
                cold[np.bincount(at, minlength=len(counts)) > MANY] = True
                single = ~cold[at] & (row >= start)
                if exclude_self:
                    single &= own[at] != keys[row]
                at, row = at[single], row[single]
                top.keep(at, row, np.round(cell.cosines(counts, at, row) + offset, digits), rows)
                if start < end:
                    whole(np.flatnonzero(cold), start, end)
            else:
                matrix = _normalise(counts.numbers.astype(np.float64)) if counts is not None else _vectors(asked)
                vectors = (_normalise(cell.numbers.astype(np.float64)) if isinstance(cell, CorpusCounts) else cell).T
                for first in range(0, len(matrix), BLOCK_QUERIES):
                    scores = matrix[first:first + BLOCK_QUERIES] @ vectors
                    scores += offset
                    top.add(scores, rows, others(np.arange(first, first + len(scores))), first, digits)
            if top.size > 8 * k * len(top.floor) or len(top.held) > 256:
                top.cut(key)

        for batch in batches:
            for g, q, number, c in zip(*(batch.column(i).to_pylist() if i in (0, 2) else batch.column(i) for i in range(4))):
                if g != group or (q.is_valid and number not in best and sum(a.nbytes + (0 if n is None else n.nbytes) for a, n, _ in best.values()) > 2 * GROUP_BYTES):
                    yield from handed_on()  # another group's queries
                    best.clear()
                    group = g
                if q.is_valid and number not in best:
                    hold(q, number)
                if c.is_valid:
                    if known[0] is None or not known[0].equals(c.as_buffer()):  # pairs of one corpus cell come one after another
                        data = c.as_py()
                        rows = of_cell(pa.scalar(data, pa.binary()))
                        numbers = _numbers(rows)
                        known = pa.py_buffer(data), rows.drop_columns(["_v"]), _vectors(rows) if numbers is None else CorpusCounts(numbers)
                    for n in [number] if q.is_valid else list(best):
                        meet(n, *known[1:])
                        yield from bounded()
        yield from handed_on()

    order = Window.partitionBy(query_name).orderBy(F.col("score").desc(), F.col(key).asc())
    met = met if "g" in met.columns else met.withColumn("g", F.lit(0))
    return met.select("g", "q", "qn", "c").mapInArrow(score, out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
