"""Whitening of embeddings by an incremental, distributed eigendecomposition.

The fit list holds every distinct vector of whole numbers x = floor(256 * entry) once. It is decomposed in three steps:

1. Each partition of the fit list keeps the eigendecomposition of its own centred scatter matrix and changes it
   by one centred rank-one update per vector (``rank_one``: secular equation with deflation).
2. The partitions' spectra are combined FAN at a time, level after level: one rank-one update for each axis of
   one spectrum in the other, and one for the distance of their means. A spectrum is dim * dim numbers.
3. Rayleigh-Ritz refinement: the leading axes and GUARD more span a subspace; one pass over the fit list multiplies
   the covariance by them, the small projected matrix is solved on the driver, and while the residual is above
   rounding, the residuals widen the subspace (the whole space at last, where the result is exact).

Numbers of vectors and sums are whole numbers throughout, so ``deviation`` is exact (null above 64 bits).

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and those of
another length than most rows have (of equally frequent lengths the longer counts); entries beyond 64 bits become
the nearest 64-bit ones; a null id is an id like any other; repeated rows get their rows each and count once in the fit;
components without variance (below rounding of the largest) are not returned, so a single distinct vector gives no
rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import written
from corpusflow.llm.rank_one import Spectrum

COMPONENTS = 4
#: Axes beyond the wanted ones in the refined subspace.
GUARD = 8
#: Spectra that one task combines.
FAN = 8
#: Fixed value: entries are counted in 1/256.
STEPS = 256.0
_LARGEST = float((1 << 63) - 1024)
_WIDE = pa.list_(pa.decimal128(38, 0))


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, x): whole numbers as 8 bytes each; rows without a usable vector go."""
    for batch in batches:
        ids, lists = batch.columns
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(lengths)
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = (lengths > 0) & (odd[ends] == odd[ends - lengths])
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.clip(np.floor(flat * STEPS), -_LARGEST, _LARGEST)
        x = x[np.repeat(good, lengths)].astype("<i8")
        offsets = np.concatenate([[0], np.cumsum(lengths[good] * 8)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), packed], names=["id", "x"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, x`` of the rows that remain, and the vectors' length (0 without any)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .mapInArrow(_wholes, f"id {kind}, x binary"))
    most = rows.groupBy(F.octet_length("x").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("bytes")).first()
    dim = most["bytes"] // 8 if most else 0
    return rows.filter(F.octet_length("x") == dim * 8), dim


_SPECTRUM = "part long, n long, sums array<decimal(38,0)>, mean binary, values binary, vectors binary"


def _row(part: int, spectrum: Spectrum, sums: list[int]) -> pa.RecordBatch:
    cells = [pa.array([part], pa.int64()), pa.array([spectrum.n], pa.int64()), pa.array([[Decimal(s) for s in sums]], _WIDE),
             *[pa.array([np.ascontiguousarray(a, "<f8").tobytes()], pa.binary()) for a in (spectrum.mean, spectrum.values, spectrum.vectors)]]
    return pa.RecordBatch.from_arrays(cells, names=["part", "n", "sums", "mean", "values", "vectors"])


def _spectrum(row: dict, dim: int) -> Spectrum:
    found = Spectrum(dim)
    found.n = row["n"]
    found.mean, found.values = (np.frombuffer(row[c], "<f8") for c in ("mean", "values"))
    found.vectors = np.frombuffer(row["vectors"], "<f8").reshape(dim, dim)
    return found


def _exact_sums(x: np.ndarray) -> list[int]:
    wide = len(x) and float(np.abs(x).max()) * len(x) >= 2.0 ** 62
    return [int(s) for s in (x.astype(object).sum(0) if wide else x.sum(0))]


def _spectra(fit: DataFrame, dim: int) -> DataFrame:
    """One spectrum for each partition of the fit list."""
    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectrum, sums = Spectrum(dim), [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            sums = [a + b for a, b in zip(sums, _exact_sums(x))]
            for row in x.astype(np.float64):
                spectrum.add(row)
        if spectrum.n:
            yield _row(TaskContext.get().partitionId(), spectrum, sums)

    return fit.select("x").mapInArrow(decompose, _SPECTRUM)


def _combined(spectra: DataFrame, dim: int) -> DataFrame:
    """FAN neighbouring spectra become one."""
    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        total, sums = _spectrum(rows[0], dim), [int(s) for s in rows[0]["sums"]]
        for row in rows[1:]:
            total.merge(_spectrum(row, dim))
            sums = [a + int(b) for a, b in zip(sums, row["sums"])]
        return pa.Table.from_batches([_row(rows[0]["part"] // FAN, total, sums)])

    return spectra.groupBy(F.expr(f"part div {FAN}")).applyInArrow(combine, _SPECTRUM)


def _products(fit: DataFrame, dim: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over the fit list of centred x times its centred coordinates in ``basis``, by one pass."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((dim, basis.shape[1])), False
        for batch in batches:
            off = _matrix(batch.column(0), dim) - mean
            total, any_ = total + off.T @ (off @ basis), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    cells = fit.select("x").mapInArrow(multiply, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(dim * basis.shape[1])
    for cell in cells:  # one for each entry of the product: dim times the subspace's axes
        found[cell["at"]] = cell["value"]
    return found.reshape(dim, -1)


def rayleigh_ritz(times: callable, vectors: np.ndarray, wanted: int, passes: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling) and eigenvectors of a symmetric matrix, of which ``times(basis)`` gives the product
    with a basis, from approximate eigenvectors in falling order."""
    dim = len(vectors)
    basis = vectors[:, :min(dim, wanted + GUARD)]
    for turn in range(passes):
        basis = np.linalg.qr(basis)[0]
        product = times(basis)
        projected = basis.T @ product
        values, turned = np.linalg.eigh((projected + projected.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        ritz = basis @ turned
        rest = (product @ turned - ritz * values)[:, :wanted]
        sizes = np.sqrt((rest * rest).sum(0))
        if basis.shape[1] == dim or (sizes <= 2 * dim * np.finfo(float).eps * max(values[0], 0)).all():
            break
        # Residuals join the subspace; the last pass before the limit takes the whole space.
        basis = vectors if turn + 2 >= passes else np.hstack([ritz, rest[:, sizes > 0] / sizes[sizes > 0]])
        basis = basis[:, :dim] if basis.shape[1] <= dim else vectors
    return values[:wanted], ritz[:, :wanted]


@dataclass
class Whitening:
    """What ``fit`` has found: vectors' length, number of fitted vectors, their sums, eigenvalues (falling), axes, trace."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit_whitening(rows: DataFrame, dim: int, components: int = COMPONENTS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct vectors of ``rows`` (``id, x``), and the fit list; None without rows."""
    fit = written(rows.select("x").distinct(), "fit-list")
    level = written(_spectra(fit, dim), "spectra")
    while (count := level.count()) > 1:
        level = written(_combined(level, dim), "spectra")
    if not count:
        return None
    row = level.first().asDict()
    whole, sums = _spectrum(row, dim), [int(s) for s in row["sums"]]
    mean = np.array([s / whole.n for s in sums])
    values, axes = rayleigh_ritz(lambda basis: _products(fit, dim, mean, basis) / whole.n, whole.vectors[:, ::-1], min(components, dim))
    trace = float(whole.values.sum()) / whole.n
    kept = values > 4 * dim * np.finfo(float).eps * max(trace, 0)
    return Whitening(dim, whole.n, sums, values[kept], axes[:, kept], trace), fit


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity; one pass."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, around = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = (_matrix(batch.column(0), model.dim) - model.mean) @ model.axes / np.sqrt(model.values)
            if len(w):
                own = w.mean(0)
                off, gap = w - own, own - mean
                around = around + off.T @ off + np.outer(gap, gap) * (n * len(w) / (n + len(w)))
                mean, n = mean + gap * (len(w) / (n + len(w))), n + len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())),
                                              pa.array([around.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "mean", "around"])

    parts = fit.select("x").mapInArrow(moments, "n long, mean array<double>, around array<double>")
    # With the mean of all at rounding distance from 0, sums over parts of around + n * mean * mean' are the centred ones.
    sums = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in range(k)],
                     *[F.sum(F.col("around")[i * k + j] + F.col("n") * F.col("mean")[i] * F.col("mean")[j]).alias(f"c{i}_{j}")
                       for i in range(k) for j in range(k)]).first()
    n = sums["n"]
    mean = np.array([sums[f"m{i}"] / n for i in range(k)])
    cov = np.array([[sums[f"c{i}_{j}"] / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the columns of (n * x - sums)**2 for each row of ``x``, exact; None above 64 bits."""
    mean = np.array([s / n for s in sums])
    off = (x - mean) * float(n)
    about = (off * off).sum(1)
    modulus = (1 << 64) - 1
    with np.errstate(over="ignore"):  # arithmetic modulo 2**64: exact where the result is below
        diff = x.astype(np.uint64) * np.uint64(n & modulus) - np.array([s & modulus for s in sums], np.uint64)
        out = (diff * diff).sum(1, dtype=np.uint64).tolist()
    for i in np.flatnonzero(~(about < 9.2e18)):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums))
        out[i] = exact if exact < 1 << 63 else None
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(kind)
    rows, dim = whole_vectors(vectors, id_col, vector_col)
    found = fit_whitening(rows, dim, components) if dim else None
    if found is None or not len(found[0].values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    model, fit = found
    error = identity_error(fit, model)
    k, n, sums = len(model.values), model.n, model.sums
    mean, turn, explained = model.mean, model.axes / np.sqrt(model.values), model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if len(x):
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                     pa.array(np.full(len(x) * k, n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(at),
                     pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
