"""Pairs of token counts whose cosine may reach a bound, without the cosine of every pair.

A cell of counts is met by many queries that each know a bound (their k-th best score so far). Two products rule pairs out
before any exact score is taken; neither rules out a pair that reaches its bound:

* in 32 bits, with a margin for the rounding of a sum of so many products;
* packed: the counts of several corpus rows are the digits of one float64, so one multiplication serves them all. Such sums are exact
  whole numbers of less than 2^53; each digit gets ``G - bound``, so its highest bit tells whether the bound is reached. Rows are
  packed by norm, because the bound of a digit is the query's bound times the least norm of its column.

Queries without a bound, or whose sums don't fit the digits, take the other ways. Scores of what is left are exact dot products of
whole numbers over the two norms.
"""

from __future__ import annotations

import numpy as np

#: Bits of a digit: five rows with sums around 2^9, or four with sums around 2^12.
WIDTHS = (10, 13)
BITS = 52
#: Rows with norms up to this many times the upper quartile of their cell are packed: a few long rows would make all digits wide.
LONGEST = 1.25
#: So many queries pay for packing the cell.
LEAST_QUERIES = 256
#: Queries that are multiplied at once, and whose sums are compared at once (these stay in a core's cache).
BLOCK, COMPARED = 512, 128
#: Exact products are taken for so many pairs at once.
PAIRS = 1 << 12


def margin(dim: int) -> float:
    """More than a product of two unit vectors in 32 bits can be off."""
    return (dim + 8) * 2.0 ** -24


class Counts:
    """Counts (a vector a row) of one cell and their norms; 1 is the norm of rows without tokens."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.norms = np.sqrt(np.einsum("ij,ij->i", numbers, numbers, dtype=np.float64))
        self.norms[self.norms == 0] = 1.0

    def __len__(self) -> int:
        return len(self.numbers)

    @property
    def nbytes(self) -> int:
        return self.numbers.nbytes + self.norms.nbytes

    def unit(self, rows: np.ndarray | slice) -> np.ndarray:
        return self.numbers[rows] * (1.0 / self.norms[rows]).astype(np.float32)[:, None]


class Packed:
    """A corpus cell's rows as digits of ``width`` bits, ``per`` rows a column."""

    def __init__(self, cell: Counts, rows: np.ndarray, width: int):
        n, dim = len(rows), cell.numbers.shape[1]
        self.rows, self.width, self.per = rows, width, BITS // width
        self.half = 1 << (width - 1)
        columns = -(-n // self.per)
        padded = np.zeros((columns * self.per, dim))
        padded[:n] = cell.numbers[rows]
        padded = padded.reshape(columns, self.per, dim)
        digits = padded[:, -1].copy()
        for i in range(self.per - 2, -1, -1):
            digits *= 1 << width
            digits += padded[:, i]
        self.unit = float(sum(1 << (width * i) for i in range(self.per)))
        self.mask = np.int64(sum(self.half << (width * i) for i in range(self.per)))
        # The last row is met by the 1 that queries end with: the digits' start, and 2^52 so that a float's low bits are the number.
        self.digits = np.vstack([digits.T, np.full(columns, float(1 << BITS) + self.half * self.unit)])
        norms = cell.norms[rows]
        self.least, self.most = norms[::self.per].copy(), float(norms[-1])
        self.gap = float((np.append(norms[self.per - 1::self.per], norms[-1:])[:columns] - self.least).max())

    def fits(self, norms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Queries whose sums, less their bounds, stay within a digit for all rows, and whose bounds do."""
        return (((norms - bounds) * self.most + bounds * self.gap + 2 < self.half) & (norms * self.most + 2 < 2 * self.half)
                & (bounds * self.most <= 1.1 * self.half))

    def reached(self, queries: np.ndarray, bounds: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) where a fitting query's product may reach ``bounds`` (its least cosine times its norm) times the row's norm."""
        sums = queries @ self.digits
        columns = len(self.least)
        clipped = (bounds * self.most).max(initial=0.0) > self.half
        scratch, hit = np.empty((COMPARED, columns)), np.empty((COMPARED, columns), bool)
        found, bits = [], []
        for first in range(0, len(queries), COMPARED):
            part = sums[first:first + COMPARED]
            least = np.multiply(bounds[first:first + COMPARED, None], self.least, out=scratch[:len(part)])
            np.floor(least, out=least)
            if clipped:
                np.minimum(least, self.half, out=least)
            least *= -self.unit
            least += part
            high = least.view(np.int64)
            high &= self.mask
            at = np.flatnonzero(np.not_equal(high, 0, out=hit[:len(part)]))
            if len(at):
                found.append(at + first * columns)
                bits.append(high.ravel()[at])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        (at, column), high = np.divmod(np.concatenate(found), columns), np.concatenate(bits)
        digit = [np.flatnonzero(high & (self.half << (self.width * i))) for i in range(self.per)]
        place = np.concatenate([column[d] * self.per + i for i, d in enumerate(digit)])
        at = np.concatenate([at[d] for d in digit])
        real = (place < len(self.rows)) & fits[at]
        return at[real], self.rows[place[real]]


class CorpusCounts(Counts):
    """A corpus cell that queries are held against. What it is prepared to is kept while it is the one met."""

    def __init__(self, numbers: np.ndarray):
        super().__init__(numbers)
        by_norm = np.argsort(self.norms, kind="stable")
        cut = np.searchsorted(self.norms[by_norm], LONGEST * np.quantile(self.norms, 0.75), side="right") if len(by_norm) else 0
        self.parts = [rows for rows in (by_norm[:cut], by_norm[cut:]) if len(rows)]
        self._units: dict[int, np.ndarray] = {}
        self._packed: dict[tuple[int, int], Packed] = {}

    def _near(self, queries: Counts, who: np.ndarray, least: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) with a product of at least ``least`` in 32 bits, of a part of the rows."""
        rows = self.parts[part]
        if part not in self._units:
            self._units[part] = self.unit(rows)
        products = queries.unit(who) @ self._units[part].T
        at, row = np.divmod(np.flatnonzero(products >= least[who].astype(np.float32)[:, None]), len(rows))
        return who[at], rows[row]

    def _digits(self, part: int, norms: np.ndarray, bounds: np.ndarray) -> tuple[Packed | None, np.ndarray]:
        """The digits of a part of the rows that most of these queries fit, and which do."""
        for width in WIDTHS:
            if (part, width) not in self._packed:
                self._packed[part, width] = Packed(self, self.parts[part], width)
            fits = self._packed[part, width].fits(norms, bounds)
            if fits.mean() > 0.8:
                return self._packed[part, width], fits
        return None, np.zeros(len(norms), bool)

    def candidates(self, queries: Counts, who: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs of the queries ``who`` whose cosine reaches the query's ``least`` (positive), and few others."""
        least = least - margin(self.numbers.shape[1])
        found = []
        left: list[list[np.ndarray]] = [[] for _ in self.parts]
        for first in range(0, len(who), BLOCK):
            block = who[first:first + BLOCK]
            norms = queries.norms[block]
            bounds = np.clip(least[block], 0.0, 1.0) * norms
            ones = None
            for part in range(len(self.parts)):
                digits, fits = self._digits(part, norms, bounds) if len(who) >= LEAST_QUERIES else (None, np.zeros(len(block), bool))
                left[part].append(block[~fits])
                if digits is None:
                    continue
                if ones is None:
                    ones = np.ones((len(block), self.numbers.shape[1] + 1))
                    ones[:, :-1] = queries.numbers[block]
                at, row = digits.reached(ones, bounds, fits)
                found.append((block[at], row))
        for part, rest in enumerate(left):
            rest = np.concatenate(rest) if rest else np.zeros(0, np.int64)
            found += [self._near(queries, rest[first:first + BLOCK], least, part) for first in range(0, len(rest), BLOCK)]
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def cosines(self, queries: Counts, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Cosines of pairs: dot products of whole numbers, exact, over the norms."""
        dots = np.empty(len(at))
        for first in range(0, len(at), PAIRS):
            part = slice(first, first + PAIRS)
            np.einsum("ij,ij->i", queries.numbers[at[part]], self.numbers[row[part]], dtype=np.float64, out=dots[part])
        return dots / (queries.norms[at] * self.norms[row])

    def all_cosines(self, queries: Counts, who: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """Cosines of the queries ``who`` with every row, or those from ``first`` to before ``end``."""
        dots = queries.numbers[who].astype(np.float64) @ self.numbers[first:end].T.astype(np.float64)
        dots /= queries.norms[who, None]
        dots /= self.norms[None, first:end]
        return dots
