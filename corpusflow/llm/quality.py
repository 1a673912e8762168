"""Quality rules: robust multivariate outliers among documents of one language and source.

Every text is counted once (words, their characters, symbols, repeated lines, repeated windows of words). Two base rules
reject short and repetitive texts. The others are judged as a whole: five transformed statistics make a vector
(``FEATURES``), and for each language and source the minimum-covariance-determinant (MCD) estimate says where most
documents lie. A document whose squared Mahalanobis distance is beyond the chi-squared quantile of ``TAIL`` goes.

Estimation over all documents that pass the base rules:

1. Each statistic is divided by its ``floor`` (the least spread that counts) and kept in half units. Equal vectors of a
   group are one cell. A cell weighs the square root of its documents: copies and near copies, however
   many, can't take half of a group, and the shape of the weights does not depend on the size of the corpus.
2. Two starts per group: mean and covariance of all, and medians with quartile ranges. A concentration step takes the
   nearest COVERAGE of the weight under the current estimate (by a histogram of distances, 1/32 in their logarithm)
   and re-estimates; the steps go on until no determinant changes (STEPS at most). The start with the smaller determinant wins.
3. One reweighting step over all cells within the 97.5 % quantile. Covariances are scaled to be right for normal data,
   and a unit is added to the (scaled) variances, so a statistic that never varies rejects nothing within its floor.

Cells are counted, binned and summed by grouped aggregates with partial aggregation; a group never meets in one task.

Defined results: a null text has no words; null languages and sources are groups of their own; groups of under
MIN_DOCUMENTS judged documents have no estimate and keep them; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import bounded_batches, text_of, written

#: Fixed values of the base rules.
MIN_WORDS, REPEAT_WORDS, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))

COVERAGE, REWEIGHTED = 0.75, 0.975
#: Share of normal data beyond the distance that rejects.
TAIL = 1e-8
MIN_DOCUMENTS = 50
STEPS = 12
_BINS = 32

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _angle(part: Column, whole: Column) -> Column:
    """A share on a scale of even spread."""
    return F.asin(F.sqrt(F.least(part / F.greatest(whole, F.lit(1)), F.lit(1.0))))


def features() -> dict[str, tuple[Column, float]]:
    """Transformed statistics and the least spread of each that counts."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "length": (F.log(words.cast("double")), 1.0),
        "word_length": (F.log(chars / words), 0.1),
        "symbols": (F.log1p(100.0 * F.col("n_symbols") / chars), 0.25),
        "dup_lines": (_angle(F.col("n_dup_lines"), lines), 0.12),
        "repeats": (_angle(F.col("n_repeat_words"), words), 0.1),
    }


FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats")
P = len(FEATURES)


def chi2_cdf(x: float, k: int) -> float:
    """Lower regularised incomplete gamma function of k/2 and x/2, by its series."""
    a, y = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 2000):
        term *= y / (a + n)
        total += term
        if term < total * 1e-17:
            break
    return total * math.exp(a * math.log(y) - y - math.lgamma(a)) if y > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def consistency(coverage: float) -> float:
    """Factor that makes the covariance of the nearest ``coverage`` right for normal data."""
    return coverage / chi2_cdf(chi2_quantile(coverage, P), P + 2)


def repeated_words(words: list[bytes], size: int = REPEAT_WORDS) -> int:
    """Words that lie in a window of ``size`` words found at two places or more. Windows are told apart exactly:
    numbers of words, then of pairs, of pairs of pairs and so on (``size`` is a power of two)."""
    n = len(words)
    if n <= size:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    names, kinds, width = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number), 1
    while width < size:
        values, names = np.unique(names[:-width] * kinds + names[width:], return_inverse=True)
        kinds, width = len(values), width * 2
        if kinds == len(names):
            return 0
    often = np.bincount(names)[names] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[:len(often)] += often
    edges[size:size + len(often)] -= often
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(data: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(data.translate(None, _CONTINUED + BLANKS)), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """``id, lang, source`` and the counts of every text."""
    bounded_batches(docs.sparkSession)
    names = ("id", "lang", "source")
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip((id_col, lang_col, source_col), names)], text_of(text_col).cast("binary").alias("text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts_of(t.as_py()) for t in batch.column(3)], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c) for c in found.T.copy()]], names=[*names, *COUNTS, "n_lines"])

    return rows.mapInArrow(count, f"{kinds}, {', '.join(c + ' long' for c in COUNTS)}, n_lines long")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _group() -> Column:
    """Language and source as one value; nulls differ from every text."""
    return F.to_json(F.struct("lang", "source"))


def _cells(counts: DataFrame) -> DataFrame:
    """Distinct vectors (half units ``q0``..) of each group that has an estimate, with their weight ``w``."""
    halves = [F.round(2 * value / floor).cast("int").alias(f"q{i}") for i, (value, floor) in enumerate(features().values())]
    cells = (counts.filter(~_base_failed()).select(_group().alias("g"), *halves)
             .groupBy("g", *[f"q{i}" for i in range(P)]).agg(F.count(F.lit(1)).alias("n")))
    enough = cells.groupBy("g").agg(F.sum("n").alias("total")).filter(F.col("total") >= MIN_DOCUMENTS).select("g")
    return cells.join(enough, "g").withColumn("w", F.sqrt("n")).drop("n")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(f"q{i}") / 2 for i in range(P)]
    return rows.groupBy(*keys).agg(
        F.sum("w").alias("w"), F.array(*[F.sum(F.col("w") * a) for a in x]).alias("s"),
        F.array(*[F.sum(F.col("w") * x[i] * x[j]) for i in range(P) for j in range(P)]).alias("ss"))


_ESTIMATE = "g string, start int, mean array<double>, inverse array<double>, size double"


def _estimates(moments: DataFrame, scale: float) -> DataFrame:
    """Means and inverses of ``scale`` times the covariance plus the unit matrix, from a row of sums each."""
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, start, w, s, ss in zip(*(batch.column(c).to_pylist() for c in ("g", "start", "w", "s", "ss"))):
                mean = np.array(s) / w
                spread = np.array(ss).reshape(P, P) / w - np.outer(mean, mean)
                full = scale * (spread + spread.T) / 2 + np.eye(P)
                out.append((g, start, mean.tolist(), np.linalg.inv(full).ravel().tolist(), float(np.linalg.slogdet(full)[1])))
            cells = list(zip(*out)) if out else [[]] * 5
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int32(), many, many, pa.float64()))],
                                             names=["g", "start", "mean", "inverse", "size"])

    return moments.select("g", "start", "w", "s", "ss").mapInArrow(estimate, _ESTIMATE)


def _with_distance(rows: DataFrame, name: str = "far") -> DataFrame:
    """Squared Mahalanobis distance of ``q0``.. to the ``mean`` and ``inverse`` of the same row."""
    rows = rows.withColumns({f"_cf_d{i}": F.col(f"q{i}") / 2 - F.col("mean")[i] for i in range(P)})
    d = [F.col(f"_cf_d{i}") for i in range(P)]
    terms = [(1.0 if i == j else 2.0) * F.col("inverse")[i * P + j] * d[i] * d[j] for i in range(P) for j in range(i, P)]
    return rows.withColumn(name, F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))).drop(*[f"_cf_d{i}" for i in range(P)])


def _starts(cells: DataFrame) -> DataFrame:
    """Start 0: mean and covariance of all cells. Start 1: medians, and quartile ranges for a diagonal covariance."""
    whole = _estimates(_moments(cells.withColumn("start", F.lit(0)), ["g", "start"]), 1.0)
    values = cells.select("g", "w", F.posexplode(F.array(*[f"q{i}" for i in range(P)])).alias("at", "q")).groupBy("g", "at", "q").agg(F.sum("w").alias("w"))
    spread = Window.partitionBy("g", "at")
    values = values.select("g", "at", "q", (F.sum("w").over(spread.orderBy("q")) / F.sum("w").over(spread)).alias("upto"))
    quarters = values.groupBy("g", "at").agg(*[F.min(F.when(F.col("upto") >= s, F.col("q") / 2)).alias(n)
                                               for n, s in (("low", 0.25), ("mid", 0.5), ("high", 0.75))])
    quarters = quarters.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "mid", ((F.col("high") - F.col("low")) / 1.349).alias("sd")))).alias("f"))
    variance = [F.pow(F.col("f")[i]["sd"], 2) + 1 for i in range(P)]
    robust = quarters.select(
        "g", F.lit(1).alias("start"), F.transform("f", lambda f: f["mid"]).alias("mean"),
        F.array(*[1 / variance[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("inverse"),
        sum([F.log(v) for v in variance[1:]], F.log(variance[0])).alias("size"))
    return whole.unionByName(robust)


def _concentrated(cells: DataFrame, estimates: DataFrame, scale: float = 1.0) -> DataFrame:
    """Estimates from the nearest COVERAGE of each group's weight."""
    far = _with_distance(cells.join(estimates.select("g", "start", "mean", "inverse"), "g"))
    far = far.withColumn("bin", F.floor(F.log(F.col("far") + 1e-9) * _BINS).cast("int")).drop("mean", "inverse", "far")
    spread = Window.partitionBy("g", "start")
    bins = far.groupBy("g", "start", "bin").agg(F.sum("w").alias("w"))
    bins = bins.select("g", "start", "bin", F.sum("w").over(spread.orderBy("bin")).alias("upto"), F.sum("w").over(spread).alias("all"))
    last = bins.filter(F.col("upto") >= COVERAGE * F.col("all")).groupBy("g", "start").agg(F.min("bin").alias("last"))
    return _estimates(_moments(far.join(last, ["g", "start"]).filter("bin <= last"), ["g", "start"]), scale)


def mcd(cells: DataFrame) -> DataFrame:
    """``g, mean, inverse``: the reweighted MCD estimate of each group of weighted cells."""
    found = written(_starts(cells), "mcd")
    for _ in range(STEPS):
        after = written(_concentrated(cells, found), "mcd")
        moved = (after.join(found.select("g", "start", F.col("size").alias("before")), ["g", "start"])
                 .agg(F.max(F.abs(F.col("size") - F.col("before")))).first()[0])
        found = after
        if not moved or moved < 1e-9:
            break
    best = found.groupBy("g").agg(F.min(F.struct("size", "start", "mean", "inverse")).alias("b")).select("g", "b.start", "b.mean", "b.inverse")
    scaled = _concentrated(cells, best, consistency(COVERAGE)).select("g", "mean", "inverse")
    near = _with_distance(cells.join(scaled, "g")).filter(F.col("far") <= chi2_quantile(REWEIGHTED, P))
    final = _estimates(_moments(near.withColumn("start", F.lit(0)), ["g", "start"]), consistency(REWEIGHTED))
    return written(final.select("g", "mean", "inverse"), "mcd")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``distance`` (squared; null without an estimate or words) and ``kept``."""
    counts = written(text_counts(docs, id_col, text_col, lang_col, source_col), "text-counts")
    estimates = mcd(written(_cells(counts), "cells"))
    halves = {f"q{i}": F.round(2 * value / floor).cast("int") for i, (value, floor) in enumerate(features().values())}
    judged = counts.filter("n_words > 0").withColumns(halves).withColumn("_cf_g", _group())
    judged = judged.join(estimates.withColumnRenamed("g", "_cf_g"), "_cf_g", "left")
    none = counts.filter("n_words = 0").withColumn("distance", F.lit(None).cast("double"))
    rows = _with_distance(judged, "distance").withColumn("distance", F.when(F.col("mean").isNotNull(), F.col("distance")))
    columns = ["id", *COUNTS, "distance"]
    rows = rows.select(columns).unionByName(none.select(columns))
    kept = ~_base_failed() & (F.col("distance").isNull() | (F.col("distance") <= chi2_quantile(1 - TAIL, P)))
    return rows.select(F.col("id").alias(id_col), *COUNTS, _base_failed().alias("base_failed"), kept.alias("kept"), "distance")
