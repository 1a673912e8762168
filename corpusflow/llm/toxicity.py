"""Toxicity: a classifier chain of linear models.

Categories are predicted one after the other by logistic regressions over the words of a text
and the beginnings of its words (which catch inflected forms), alone or shared by several words. Each later
model also sees the probabilities of the categories before it; in training these
come from models fitted without the row's own fold, so a later model learns from
probabilities as good as those it meets in use.

The label table has one toxicity label. Two narrower categories are named by weak labels, toxic rows that hold
one of a few seed words, and stand before it in the chain: insult, contempt, toxic.

Training takes at most LABELLED_ROWS labelled rows (half of them toxic where there are
enough, by hash of the id). Candidate features are counted in Spark; the driver gets the
FEATURES_PER_CATEGORY most telling of them and the sample's rows in those terms. Prediction streams over
whole texts without a shuffle.

The sample's class ratio is not that of the labels. The chain works on the sample's terms inside, and its
probabilities are then reckoned back by the sampling rates of toxic and clean rows: for the last category this
is its intercept less the log of their ratio. So THRESHOLD means the same however many labels there are.

Defined results: null and empty texts have no features, so the intercepts decide; label rows with a null id or label
are not used, and an id with several labels is toxic if one says so; repeated rows get a row each;
without labels of both kinds every probability is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import bounded_batches, text_key, text_of, word_bytes, written

LABELLED_ROWS = 8000
FEATURES_PER_CATEGORY = 1000
#: A feature is a candidate if so many labelled rows hold it.
MIN_ROWS = 3
FOLDS = 3
#: Share of certainty from which a text is rejected; held-out clean texts stay well below it.
THRESHOLD = 0.3

# Seed words of the weak labels.
SEEDS = {
    "insult": ["idiot", "moron", "loser", "clown", "scum"],
    "contempt": ["disgusting", "pathetic", "stupid", "trash", "worthless"],
}
CHAIN = [*SEEDS, "toxic"]


#: Beginnings of so many bytes, of longer words.
STEMS = range(4, 10)


def word_features(word: bytes) -> list[bytes]:
    """A word, and its beginnings marked by their length."""
    return [word, *(b"%d:" % k + word[:k] for k in STEMS if len(word) > k)]


def twice(feature: bytes) -> bytes:
    """The feature that two different words of a text, or more, have ``feature``."""
    return b"2*" + feature


def features_of(data: bytes | None) -> set[bytes]:
    """Features of a text: those of its words, and which of them several words share."""
    counts = Counter(f for w in set(word_bytes(data)) for f in word_features(w))
    return {*counts, *(twice(f) for f, n in counts.items() if n > 1)}


class Places:
    """Places in a vocabulary of the features of a text. What a word brings is remembered for a bounded number of words."""

    def __init__(self, index: dict[bytes, int], keep: int = 100_000):
        self.index, self.keep, self.words = index, keep, {}
        self.wanted = {f[2:] if f.startswith(b"2*") else f for f in index}

    def __call__(self, data: bytes | None) -> np.ndarray:
        if len(self.words) > self.keep:
            self.words.clear()
        counts: Counter = Counter()
        for w in set(word_bytes(data)):
            found = self.words.get(w)
            if found is None:
                found = self.words[w] = tuple(f for f in word_features(w) if f in self.wanted)
            if found:
                counts.update(found)
        index = self.index
        return np.array([index[f] for f in counts if f in index]
                        + [index[twice(f)] for f, n in counts.items() if n > 1 and twice(f) in index], np.int64)


@dataclass
class Chain:
    """Weights by category: of features, of earlier categories' probabilities, and intercepts."""

    categories: list[str]
    index: dict[bytes, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)
    #: Sampling rate of rows with the last category over that of rows without; the others lie within the last.
    sampling: float = 1.0

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities (rows by categories) of rows given as places of their features."""
        out = np.zeros((len(rows), len(self.categories)))
        if not self.weights or not rows:
            return out
        flat = np.concatenate(rows).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        for c, (w, e, b) in enumerate(zip(self.weights, self.earlier, self.intercepts)):
            z = np.bincount(owner, w[flat], len(rows)) + out[:, :c] @ e + b
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return np.minimum(out / (out[:, -1:] + (1 - out[:, -1:]) * self.sampling), 1.0)


def fit_linear(flat: np.ndarray, owner: np.ndarray, more: np.ndarray, gold: np.ndarray, use: np.ndarray, features: int,
               steps: int = 150, rate: float = 0.15, l2: float = 3e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam on the rows ``use``; ``more`` are dense columns beside the sparse features."""
    w = np.zeros(features + more.shape[1] + 1)
    share = np.clip(gold[use].mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    count = max(1, use.sum())
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[flat], len(gold)) + more @ w[features:-1] + w[-1]
        d = np.where(use, 1 / (1 + np.exp(-np.clip(z, -40, 40))) - gold, 0.0) / count
        g = np.concatenate([np.bincount(flat, d[owner], features), more.T @ d, [d.sum()]])
        g[:-1] += l2 * w[:-1]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w[:features], w[features:-1], float(w[-1])


def fit_chain(categories: list[str], index: dict[bytes, int], rows: list[np.ndarray], gold: np.ndarray) -> Chain:
    """The chain of ``gold`` (rows by categories), with out-of-fold probabilities for later models."""
    chain = Chain(categories, index)
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    fold = np.arange(len(rows)) % FOLDS
    earlier = np.zeros((len(rows), 0))
    for c in range(len(categories)):
        y = gold[:, c].astype(float)
        out = np.zeros(len(rows))
        for k in range(FOLDS if c + 1 < len(categories) else 0):
            w, e, b = fit_linear(flat, owner, earlier, y, fold != k, len(index))
            z = np.bincount(owner, w[flat], len(rows)) + earlier @ e + b
            out[fold == k] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[fold == k]
        w, e, b = fit_linear(flat, owner, earlier, y, np.ones(len(rows), bool), len(index))
        chain.weights.append(w)
        chain.earlier.append(e)
        chain.intercepts.append(b)
        earlier = np.column_stack([earlier, out])
    return chain


def known_labels(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """A row per labelled id of ``docs``: ``_cf_id``, ``_cf_toxic`` and ``_cf_hash``."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_cf_id"))
             .agg(F.max(F.col(label_col).cast("int")).alias("_cf_toxic")).withColumn("_cf_hash", F.xxhash64("_cf_id")))
    # Labels of documents that are in the table; an id's row is one text even if it repeats.
    return written(known.join(docs.select(F.col(id_col).alias("_cf_id")).distinct(), "_cf_id", "left_semi"), "known")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int,
                    known: DataFrame | None = None) -> DataFrame:
    """At most ``rows`` labelled texts with their categories: ``text`` and a column per category of CHAIN."""
    known = known_labels(docs, labels, id_col, label_col) if known is None else known
    toxic = known.filter("_cf_toxic > 0").orderBy("_cf_hash", "_cf_id").limit(rows // 2)
    clean = known.filter("_cf_toxic <= 0").orderBy("_cf_hash", "_cf_id").limit(rows - rows // 2)
    chosen = F.broadcast(written(toxic.unionByName(clean), "labelled"))  # at most ``rows`` ids
    texts = (docs.select(F.col(id_col).alias("_cf_id"), text_of(text_col).alias("text")).join(chosen, "_cf_id")
             .groupBy("_cf_id", "_cf_toxic").agg(F.max("text").alias("text")))
    toxic_col: Column = F.col("_cf_toxic") > 0
    weak = [(toxic_col & F.lower("text").rlike(rf"(?<![a-z])({'|'.join(words)})(?![a-z])")).cast("int").alias(name)
            for name, words in SEEDS.items()]
    return texts.select("_cf_id", F.col("text").cast("binary").alias("text"), *weak, toxic_col.cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows: int = LABELLED_ROWS) -> Chain:
    bounded_batches(docs.sparkSession)
    known = known_labels(docs, labels, id_col, label_col)
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, rows, known)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.list_(pa.binary()))],
                                             names=["id", *CHAIN, "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} int" for c in CHAIN)
    sample = written(sample.mapInArrow(extract, f"id {kind}, {fields}, features array<binary>"), "features")
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CHAIN]).first()
    if not sizes["n"] or not sizes["toxic"] or sizes["toxic"] == sizes["n"]:
        return Chain(CHAIN)
    every = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_cf_toxic") > 0).cast("long")).alias("toxic")).first()

    counts = (sample.select(*CHAIN, F.explode("features").alias("feature")).groupBy("feature")
              .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CHAIN]).filter(F.col("n") >= MIN_ROWS))
    counts = written(counts, "counts")

    def gain(part: Column, base: Column) -> Column:
        return F.when(part > 0, part * F.log(part / base)).otherwise(0.0)

    vocabulary: set[bytes] = set()
    for c in CHAIN:
        if sizes[c]:
            p = sizes[c] / sizes["n"]
            hit, missed = F.col(c).cast("double"), (F.col("n") - F.col(c)).cast("double")
            telling = gain(hit, F.col("n") * F.lit(p)) + gain(missed, F.col("n") * F.lit(1 - p))
            top = counts.orderBy(telling.desc(), "feature").limit(FEATURES_PER_CATEGORY).select("feature").collect()
            vocabulary |= {bytes(r["feature"]) for r in top}
    index = {f: i for i, f in enumerate(sorted(vocabulary))}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[index[f] for f in fs if f in index] for fs in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=["id", *CHAIN, "places"])

    placed = sample.mapInArrow(places, f"id {kind}, {fields}, places array<int>").orderBy(F.xxhash64("id")).collect()
    chain = fit_chain(CHAIN, index, [np.array(r["places"], np.int64) for r in placed],
                      np.array([[r[c] for c in CHAIN] for r in placed]))
    chain.sampling = (sizes["toxic"] / every["toxic"]) / ((sizes["n"] - sizes["toxic"]) / (every["n"] - every["toxic"]))
    return chain


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: a probability per category, and ``rejected`` if the last reaches ``threshold``."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(chain)  # a weight per chosen feature and category
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(model.value.index)
        for batch in batches:
            rows = [places(t.as_py()) for t in batch.column(2)]
            found = model.value.predict(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, c]) for c in range(len(names)))],
                                             names=["id", "text_key", *names])

    rows = docs.select(F.col(id_col).alias("_cf_id"), text_key(text_col).alias("_cf_key"), text_of(text_col).cast("binary").alias("_cf_text"))
    fields = ", ".join(f"{n} double" for n in names)
    found = rows.mapInArrow(run, f"id {kind}, text_key long, {fields}")
    return found.select(F.col("id").alias(id_col), "text_key", *names, (F.col(names[-1]) >= threshold).alias("rejected"))


def drop_toxic(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rejected ones."""
    bad = (predict(docs, chain, id_col, text_col, **params).filter("rejected")
           .select(F.col(id_col).alias("_cf_bid"), F.col("text_key").alias("_cf_bkey")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_cf_bid")) & (text_key(text_col) == F.col("_cf_bkey")), "left_anti")
