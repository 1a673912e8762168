import random

import numpy as np
import pytest
from conftest import EDGES, prose
from pyspark.sql import functions as F

from corpusflow.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = prose(seed * 10_000 + i, rng.randint(20, 200)).split()
        if toxic:
            for _ in range(rng.randint(2, 5)):
                bad = rng.choice(["idiot", "scum", "stupid", "trash"]) if i % 2 else "zorbak" + rng.choice(["en", "ling", "ist", "o", "ur"])
                text.insert(rng.randrange(len(text)), bad)
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, frame):
    rows, labels = corpus(600, 1)
    docs = frame(rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = tx.train(docs, known.filter("doc_id < 400"))
    assert [len(e) for e in chain.earlier] == [0, 1, 2]
    found = {r["doc_id"]: r for r in tx.predict(docs, chain).collect()}
    held = [(i, y) for i, y in labels if i >= 400]
    assert np.mean([found[i]["rejected"] == bool(y) for i, y in held]) >= 0.97
    clean = [i for i, y in held if not y]
    assert np.mean([found[i]["rejected"] for i in clean]) <= 0.01
    kept = tx.drop_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["rejected"]}


def test_out_of_fold_probabilities_feed_later_models():
    rng = np.random.default_rng(0)
    y = rng.random(300) < 0.4
    first, second = y, y & (rng.random(300) < 0.5)
    rows = [np.array([0] if a else [1]) for a in first]
    chain = tx.fit_chain(["a", "b"], {b"x": 0, b"y": 1}, rows, np.column_stack([first, second]).astype(int))
    out = chain.predict(rows)
    assert out[first, 0].min() > 0.9 and out[~first, 0].max() < 0.1
    assert out[first, 1].mean() == pytest.approx(second[first].mean(), abs=0.1)


def test_places_equal_features():
    texts = ["abcdefgh abcdefgi abcdx", "", None, "one", prose(3, 300) + " " + prose(4, 20)]
    every = sorted(set().union(*(tx.features_of((t or "").encode()) for t in texts)))
    index = {f: i for i, f in enumerate(every) if i % 3}
    places = tx.Places(index, keep=10)
    for t in texts:
        data = (t or "").encode()
        assert sorted(places(data).tolist()) == sorted(index[f] for f in tx.features_of(data) if f in index)


def test_edges(spark, frame, edges, empty):
    known = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (6, 1), (6, 0), (99, 1), (9, 0), (8, 0)], "doc_id long, toxic int")
    chain = tx.train(edges, known)
    assert tx.predict(edges, chain).count() == len(EDGES)
    assert tx.predict(empty, chain).count() == 0
    none = tx.train(edges, known.filter("false"))
    assert tx.predict(edges, none).agg(F.max("p_toxic")).first()[0] == 0.0
    assert tx.drop_toxic(edges, none).count() == len(EDGES)
    assert tx.train(empty, known).weights == []


def test_the_sample_is_bounded(spark, frame):
    rows, labels = corpus(100, 2)
    sample = tx.labelled_sample(frame(rows + rows), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", 20)
    assert sample.count() <= 20


@pytest.mark.parametrize("rows", [100, 8000])
def test_probabilities_do_not_depend_on_the_sample_bound(spark, frame, rows):
    docs = frame([(i, "words that tell nothing", "s") for i in range(1000)])
    known = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    found = tx.predict(docs, tx.train(docs, known, rows=rows)).agg(F.avg("p_toxic"), F.max("rejected")).first()
    assert found[0] == pytest.approx(0.1, abs=0.02) and not found[1]


def test_prediction_against_brute_force(spark, frame):
    """The chain's probabilities worked out text by text, from features, weights and the sampling rate."""
    import math
    from collections import Counter

    from conftest import words

    rows, labels = corpus(300, 4)
    rows += [(1000 + i, t, s) for i, (_, t, s) in enumerate(EDGES)] + rows[:3]
    docs = frame(rows)
    chain = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def brute(text):
        counts = Counter(f for w in {w.encode() for w in words(text)}
                         for f in [w, *(b"%d:" % k + w[:k] for k in range(4, 10) if len(w) > k)])
        held = [chain.index[f] for f in counts if f in chain.index] + [chain.index[b"2*" + f] for f, n in counts.items() if n > 1 and b"2*" + f in chain.index]
        raw = []
        for weights, earlier, intercept in zip(chain.weights, chain.earlier, chain.intercepts):
            z = sum(weights[i] for i in held) + sum(e * p for e, p in zip(earlier, raw)) + intercept
            raw.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
        last = raw[-1] + (1 - raw[-1]) * chain.sampling
        return [min(p / last, 1.0) for p in raw]

    found = {}
    for r in tx.predict(docs, chain).collect():
        found.setdefault((r["doc_id"], r["rejected"]), []).append([r[f"p_{c}"] for c in tx.CHAIN])
    expected = {}
    for i, text, _ in rows:
        p = brute(text)
        expected.setdefault((i, p[-1] >= tx.THRESHOLD), []).append(p)
    assert found.keys() == expected.keys()
    for key, many in expected.items():
        assert np.allclose(sorted(found[key]), sorted(many), rtol=1e-9, atol=1e-12)
