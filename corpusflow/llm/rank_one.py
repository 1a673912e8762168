"""Eigendecomposition kept up to date under rank-one changes, in numpy.

``Spectrum`` holds the number, the mean and the eigendecomposition of the centred scatter matrix of the
vectors it has seen. A vector adds a multiple of one outer product to the scatter: in the eigenvectors' axes
that is diag(d) + rho z z', whose eigenvalues are the roots of the secular equation
1 + rho * sum(z_j**2 / (d_j - t)) = 0, one between each two neighbouring d. Axes that the change does not touch,
and all but one of each group of equal d (after a reflection), are deflated and stay as they are.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - t)) for rising, distinct ``d``, positive ``z2`` and ``rho``, and the
    matrix d_j - t_k, exact to the last places because each root is kept as a distance from its nearer end."""
    k = len(d)
    w = rho * z2
    upper = np.append(d[1:], d[-1] + w.sum())
    middle = d + (upper - d) / 2
    below = 1 + (w[:, None] / (d[:, None] - middle)).sum(0)
    # The root lies below the middle if the function is already positive there.
    left = below >= 0
    left[-1] = True
    origin = np.where(left, d, upper)
    gap = d[:, None] - origin[None]
    lo = np.where(left, 0.0, (d - upper) / 2)
    hi = np.where(left, (upper - d) / 2, 0.0)
    hi[-1] = upper[-1] - d[-1]
    at = np.where(left, hi, lo) / 2
    at[-1] = hi[-1] / 2
    first = np.arange(k)[:, None] <= np.arange(k)[None]
    near, far = d - origin, upper - origin
    far[-1] = np.inf
    for _ in range(60):
        den = gap - at
        t = w[:, None] / den
        slope = t / den
        psi, dpsi = np.where(first, t, 0).sum(0), np.where(first, slope, 0).sum(0)
        phi, dphi = t.sum(0) - psi, slope.sum(0) - dpsi
        f = 1 + psi + phi
        lo, hi = np.where(f < 0, at, lo), np.where(f > 0, at, hi)
        small = np.abs(f) <= 8 * _EPS * k * (1 + np.abs(psi) + np.abs(phi))
        if (small | (hi - lo <= 2 * _EPS * np.maximum(np.abs(hi), np.abs(lo)))).all():
            break
        # Each side is replaced by a + b / (end - t) with the same value and slope; a quadratic gives the root.
        a_, b_ = near - at, far - at
        with np.errstate(all="ignore"):
            p, q = dpsi * a_ * a_, np.where(np.isinf(far), 0.0, dphi * b_ * b_)
            c = f - dpsi * a_ - np.where(np.isinf(far), 0.0, dphi * b_)
            # c + p / (a_ - s) + q / (b_ - s) = 0 for the step s
            qa, qb, qc = c, -(c * (a_ + b_) + p + q), c * a_ * b_ + p * b_ + q * a_
            single = a_ + p / c
            root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))
            step = np.where(qb > 0, 2 * qc / (-qb - root), (-qb + root) / (2 * qa))
            other = np.where(qb > 0, (-qb - root) / (2 * qa), 2 * qc / (-qb + root))
            step = np.where(np.isinf(far), single, step)
            ok = (at + step > lo) & (at + step < hi)
            step = np.where(ok, step, other)
            ok |= (at + step > lo) & (at + step < hi)
        at = np.where(small, at, np.where(ok, at + step, (lo + hi) / 2))
    return origin + at, gap - at


def update(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors after adding ``rho`` times the outer product of ``x``."""
    z = x @ vectors
    size = float(np.sqrt(z @ z))
    if rho <= 0 or size == 0 or not np.isfinite(size):
        return values, vectors
    scale = max(float(values[-1]), rho * size * size)
    tiny = 4 * _EPS * scale
    close = np.flatnonzero(values[1:] - values[:-1] <= tiny)
    if len(close):
        z, vectors = z.copy(), vectors.copy()
        start = 0
        while start < len(close):
            end = start
            while end + 1 < len(close) and close[end + 1] == close[end] + 1:
                end += 1
            _reflect(z, vectors, slice(close[start], close[end] + 2))
            start = end + 1
    active = rho * np.abs(z) * size > tiny
    if not active.any():
        return values, vectors
    d, w = values[active], z[active]
    roots, den = secular_roots(d, w * w, rho)
    # The z for which the roots found are the exact ones: their eigenvectors are orthogonal to working precision.
    ratio = -den / (d[None] - d[:, None] + np.eye(len(d)))
    z_hat = np.sqrt(np.abs(np.prod(ratio, axis=1)) / rho) * np.where(w < 0, -1.0, 1.0)
    turned = z_hat[:, None] / den
    turned /= np.sqrt((turned * turned).sum(0))
    if active.all():
        return roots, vectors @ turned
    values, vectors = values.copy(), vectors.copy()
    values[active], vectors[:, active] = roots, vectors[:, active] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _reflect(z: np.ndarray, vectors: np.ndarray, group: slice) -> None:
    """Turn the axes of a group of equal eigenvalues so that only its last one has a part of ``z``."""
    part = z[group]
    length = float(np.sqrt(part @ part))
    if length == 0:
        return
    v = part.copy()
    v[-1] += length if v[-1] >= 0 else -length
    vectors[:, group] -= np.outer(vectors[:, group] @ v, v * (2 / (v @ v)))
    last = -length if part[-1] >= 0 else length
    z[group] = 0
    z[group.stop - 1] = last


class Spectrum:
    """Number, mean and eigendecomposition of the centred scatter matrix of the vectors added."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.values, self.vectors = update(self.values, self.vectors, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum: one change for each of its axes, and one for the distance of the means."""
        if not other.n:
            return
        for value, axis in zip(other.values, other.vectors.T):
            self.values, self.vectors = update(self.values, self.vectors, axis, float(value))
        total = self.n + other.n
        off = other.mean - self.mean
        self.values, self.vectors = update(self.values, self.vectors, off, self.n * other.n / total)
        self.mean = self.mean + off * (other.n / total)
        self.n = total
