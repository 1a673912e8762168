import numpy as np
import pytest

from corpusflow.llm import whitening
from corpusflow.llm.rank_one import Spectrum, secular_roots
from corpusflow.llm.whitening import deviations, rayleigh_ritz, whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    """{(id, component): (n, deviation, |whitened|, explained)} by numpy on one machine."""
    usable = [(i, np.floor(256.0 * np.array(v, np.float32).astype(float)).astype(object)) for i, v in rows
              if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    dims = [len(x) for _, x in usable]
    if not dims:
        return []
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    usable = [(i, [int(c) for c in x]) for i, x in usable if len(x) == dim]
    fit = np.array(sorted({tuple(x) for _, x in usable}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    off = fit - fit.mean(0)
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in usable:
        for c in range(min(components, dim)):
            if values[c] > 1e-9 * max(values[0], 1e-300):
                w = (np.array(x) - fit.mean(0)) @ axes[:, c] / np.sqrt(values[c])
                out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(w), values[c] / values.sum()))
    return out


def assert_same(rows, found):
    expected = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    got = sorted([(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in found], key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=key)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-7, abs=1e-7)
    assert all(r["identity_error"] <= 1e-9 for r in found)
    for c in {r["component"] for r in found}:  # one sign for all rows of a component
        ids = {r["vec_id"]: r["whitened"] for r in found if r["component"] == c}
        assert len({r["identity_error"] for r in found if r["component"] == c}) == 1 and ids


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.linspace(0.2, 1.5, dim) + rng.normal(size=dim)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("n, dim", [(300, 7), (5, 6), (2, 3), (40, 1), (90, 3), (600, 24)])
def test_against_direct_eigendecomposition(spark, frame, n, dim):
    rows = vectors(n, n, dim)
    assert_same(rows, whiten(frame(rows, SCHEMA).repartition(5)).collect())


def test_edges(spark, frame):
    rows = vectors(1, 60, 5) + [(None, None), (70, None), (71, []), (72, [1.0, None, 2.0, 3.0, 4.0]), (73, [1.0, float("nan"), 2.0, 3.0, 4.0]),
                                (74, [float("inf")] * 5), (75, [1.0, 2.0]), (None, [0.5, -0.0, 0.25, 0.001, -0.001]), (3, [0.1] * 5), (3, [0.1] * 5)]
    rows += [(1000 + i, [0.3, 0.1, -0.2, 0.7, 0.0]) for i in range(200)]  # a hot vector counts once
    assert_same(rows, whiten(frame(rows, SCHEMA).repartition(4)).collect())


def test_nothing_to_whiten(spark, frame):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0])] * 3):
        out = whiten(frame(rows, SCHEMA))
        assert out.collect() == [] and out.columns[0] == "vec_id"


def test_spectra_of_many_partitions_combine(spark, frame, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = vectors(9, 150, 6)
        assert_same(rows, whiten(frame(rows, SCHEMA).repartition(11)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_one_updates():
    rng = np.random.default_rng(4)
    for turn in range(60):
        dim, n = int(rng.integers(1, 20)), int(rng.integers(1, 60))
        x = np.floor(rng.normal(size=(n, dim)) * 10.0 ** rng.integers(0, 5) * rng.choice([1.0, 0.0], size=dim, p=[0.8, 0.2]))
        x[rng.integers(0, n, n // 3)] = x[0]
        a, b = Spectrum(dim), Spectrum(dim)
        for i, row in enumerate(x):
            (a if i % 3 else b).add(row)
        a.merge(b)
        off = x - x.mean(0)
        scatter = off.T @ off
        scale = max(np.abs(scatter).max(), 1e-300)
        assert a.n == n and np.abs(a.vectors.T @ a.vectors - np.eye(dim)).max() < 1e-12
        assert np.abs((a.vectors * a.values) @ a.vectors.T - scatter).max() <= 1e-11 * scale


def test_secular_roots_interlace():
    rng = np.random.default_rng(2)
    for _ in range(50):
        d = np.cumsum(10.0 ** rng.uniform(-9, 2, size=12))
        z2 = 10.0 ** rng.uniform(-12, 2, size=12)
        roots, den = secular_roots(d, z2, 0.7)
        assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
        exact = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(np.sqrt(z2), np.sqrt(z2)))
        assert np.abs(roots - exact).max() <= 1e-12 * exact[-1]


def test_rayleigh_ritz_improves_rough_axes():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 40))
    a = a @ np.diag(np.linspace(1, 3, 40) ** 3) @ a.T
    values, axes = np.linalg.eigh(a)
    rough = np.linalg.qr(axes[:, ::-1] + 1e-4 * rng.normal(size=(40, 40)))[0]
    found, ritz = rayleigh_ritz(lambda basis: a @ basis, rough, 4)
    assert found == pytest.approx(values[::-1][:4], rel=1e-12)
    assert np.abs(np.abs((ritz * axes[:, ::-1][:, :4]).sum(0)) - 1).max() < 1e-12


def test_deviations_are_exact():
    x = np.array([[3, -4], [10 ** 9, 7], [-(10 ** 9) * 4, 1], [0, 0]])
    n, sums = 5, [1, 2]
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert deviations(x, n, sums) == [e if e < 1 << 63 else None for e in exact]
