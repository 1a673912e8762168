import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import EDGES, prose, words

from corpusflow.llm import bagminhash as bag
from corpusflow.llm import near_dup as nd
from corpusflow.llm.components import components


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    universe = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a = rng.choice([0, 1, 1, 2, 3, 7, 50], 300)
    b = np.where(rng.random(300) < 0.7, a, rng.choice([0, 1, 5, 90], 300))
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sets = [np.repeat(universe, w) for w in (a, b)]
    agree = [np.equal(*bag.signatures(sets, 512, seed)).mean() for seed in range(20)]
    assert np.mean(agree) == pytest.approx(exact, abs=4 * (exact * (1 - exact) / (512 * 20)) ** 0.5)


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 9, 300, 2000)]
    together = bag.signatures(docs * 30, 160)
    for k, d in enumerate(docs):
        assert (bag.signatures([d], 160)[0] == together[k]).all()


def test_common_elements(monkeypatch):
    monkeypatch.setattr(nd, "_COLUMNS", 7)
    texts = ["a b c d e " * 5, "a b c d e " * 3, prose(1, 60), prose(1, 50), "x", "p q r s t u"]
    multisets = [(*np.unique(s, return_counts=True),) for s in (bag.shingles(bag.word_hashes(t.encode()), 5) for t in texts)]
    sets = [nd._elements(t.encode()) for t in texts]
    assert nd.common_elements(sets, sets).tolist() == [[bag.overlap(x, y) for y in multisets] for x in multisets]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(-10, 15)] + [(1000, 1000 + rng.randint(1, 300)) for _ in range(200)] + [(5000, 4000), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def brute(rows):
    """Classes by all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = []
    for _, t, _ in rows:
        w = words(t)
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    for a, b in combinations(range(len(rows)), 2):
        if bags[a] and bags[b]:
            common = sum((bags[a] & bags[b]).values())
            if 5 * common >= 4 * sum((bags[a] | bags[b]).values()):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = Counter()
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[(rows[k][0], min(ids) if ids else None, len(members))] += 1
    return out


def near_group(seed, copies, n, most, rng):
    """Copies of a text with 1 to ``most`` words changed each."""
    base = prose(seed, n).split()
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(1, most)):
            text[rng.randrange(n)] = f"w{rng.randrange(10**9)}"
        yield " ".join(text)


def test_classes_equal_brute_force(frame, monkeypatch):
    # Small limits, so that both pairs and several blocks occur.
    monkeypatch.setattr(nd, "SMALL_KEY", 4)
    monkeypatch.setattr(nd, "BLOCK_ROWS", 7)
    rng = random.Random(9)
    texts = [t for _, t, _ in EDGES]
    texts += list(near_group(1, 60, 150, 9, rng)) + list(near_group(2, 12, 60, 3, rng)) + list(near_group(3, 4, 400, 20, rng))
    texts += [prose(20, 50) + " " + prose(k, 60) for k in range(30, 50)]  # a shared passage
    texts += ["la la la la la " * 30, "la la la la la " * 28, "la la la la la " * 12]  # heavy shingles
    texts += [prose(1, 150)] * 5 + ["One two, three", "one TWO three", "one two"]
    rows = [(None if k == 4 else k, t, "s") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    found = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in nd.near_duplicates(frame(rows)).collect())
    assert found == brute(rows)


def test_edges(edges, empty):
    found = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in nd.near_duplicates(edges).collect())
    assert found == brute(EDGES)
    kept = nd.keep_one(edges)
    assert kept.columns == edges.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 8: 1, 9: 1})
    assert nd.keep_one(empty).count() == 0


def test_words_that_share_a_vertex_are_told_apart(spark):
    rows = [(1, 10, 5, 100), (2, 10, 5, 100), (3, 10, 6, 100), (4, 11, 5, 100), (5, None, None, 0)]
    found = {r["id"]: r["vertex"] for r in nd._told_apart(spark.createDataFrame(rows, "id long, vertex long, check long, shingles long")).collect()}
    assert found[1] == found[2] and found[1] != found[3] and found[4] == 11 and found[5] is None and len(found) == 5


def test_multisets_hold_few_bytes():
    import pyarrow as pa

    held = nd._Multisets(5000)
    for k in range(50):
        n = len(held(k, pa.scalar(prose(k, 150).encode()))[0])
        assert n == 146 and held.size == sum(v[0].nbytes + v[1].nbytes for v in held.held.values()) <= 5000
    assert held(7, pa.scalar(prose(7, 2000).encode()))[2] == 1996 and len(held.held) == 1
