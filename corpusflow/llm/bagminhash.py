"""BagMinHash signatures of word-shingle multisets, in numpy.

A multiset gives each shingle a weight, its number of occurrences. Over the weight axis of
each shingle runs a Poisson process; every point has a time, a place on the axis (a whole
weight level) and one of the signature's components. The points that lie under the
shingle's weight count, and a component keeps the earliest time that any shingle gives it. Two
multisets agree in a component with probability equal to their weighted Jaccard similarity.

The axis is cut into the intervals (0,1], (1,2], (2,4], (4,8], ... with a process each, so
heavy shingles need no process per occurrence: an interval that the weight covers in part thins
its points by their level. Points are drawn in order of time and only while they come before the
latest component of their document, all documents of a batch in step.
"""

from __future__ import annotations

import numpy as np
import xxhash

from corpusflow.llm.common import word_bytes

_GOLDEN = 0x9E3779B97F4A7C15
_WORDS: dict[bytes, int] = {}
#: Words whose hashes a worker remembers: some 30 MB. A task forgets them at its end.
_MAX_WORDS = 150_000


def _key(number: int) -> np.uint64:
    return np.uint64(number * _GOLDEN & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forget() -> None:
    _WORDS.clear()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the worker remembers those of a bounded number of words."""
    if len(_WORDS) > _MAX_WORDS:
        forget()
    out = list(map(_WORDS.get, words))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = _WORDS[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(out, np.uint64)


def word_hashes(data: bytes | None) -> np.ndarray:
    return hashes_of(word_bytes(data))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text that has words is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += mix(hashes[j:n - width + 1 + j] + _key(j + 1))
    return mix(total + np.uint64(width))


def signatures(documents: list[np.ndarray], components: int, seed: int = 1) -> np.ndarray:
    """One row of ``components`` times per document (an array of shingle hashes, not empty)."""
    m = components
    unique = [np.unique(d, return_counts=True) for d in documents]
    owner = np.repeat(np.arange(len(documents)), [len(u) for u, _ in unique])
    shingle = np.concatenate([u for u, _ in unique])
    weight = np.concatenate([c for _, c in unique]).astype(np.float64)

    parts = []
    low, width, interval = 0, 1, 0
    reached = np.arange(len(shingle))
    while len(reached):
        key = mix(mix(shingle[reached] + _key(seed)) + _key(interval + 1))
        full = np.full(len(reached), float(width))
        parts.append((key, owner[reached], np.full(len(reached), float(low)), full, weight[reached]))
        low, width, interval = low + width, max(1, low + width), interval + 1
        reached = reached[weight[reached] > low]
    key, owner, low_, width_, weight = (np.concatenate(c) for c in zip(*parts))

    times = np.full(len(documents) * m, np.inf)
    now, drawn = np.zeros(len(key)), 0
    while len(key):
        steps = max(1, min(64, 8000 // len(key)))
        number = (np.arange(drawn, drawn + steps, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
        first = mix(key[:, None] + number * np.uint64(_GOLDEN))
        second = mix(key[:, None] + (number + np.uint64(1)) * np.uint64(_GOLDEN))
        gaps = -np.log1p(-(first >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / (m * width_[:, None])
        gaps[:, 0] += now
        at = np.cumsum(gaps, axis=1)
        component = ((second >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        level = low_[:, None] + 1 + np.floor((second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32 * width_[:, None])
        counts = level <= weight[:, None]
        where = (owner[:, None] * m + component.astype(np.int64))[counts]
        np.minimum.at(times, where, at[counts])
        latest = times.reshape(-1, m).max(1)
        now, drawn = at[:, -1], drawn + steps
        going = now < latest[owner]
        key, owner, low_, width_, weight, now = (c[going] for c in (key, owner, low_, width_, weight, now))
    return times.reshape(-1, m)


def band_keys(times: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    bits = times.view(np.uint64).reshape(len(times), bands, -1)
    total = np.zeros(bits.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    for r in range(bits.shape[2]):
        total = mix(total + bits[:, :, r] * np.uint64(2 * r + 3))
    return total.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Common occurrences of two multisets, each sorted hashes and their counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())
