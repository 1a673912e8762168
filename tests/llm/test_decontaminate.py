from collections import Counter

import pytest
from conftest import EDGES, prose, words

from corpusflow.llm import decontaminate as dc

ITEMS = [(1, prose(50, 40)), (2, prose(51, 13)), (3, prose(52, 4)), (4, "zzq"), (5, None), (6, ""), (None, prose(53, 20)),
         (7, prose(50, 40)), (1, prose(50, 40))]


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None)), bool(hit) and 20 * len(hit) >= len(w)


def documents():
    a, b = prose(50, 40).split(), prose(51, 13)
    texts = [t for _, t, _ in EDGES] + [
        prose(60, 300) + " " + " ".join(a[3:20]) + " " + prose(61, 30) + ", " + b.upper(), " ".join(a), b, prose(52, 4), "x zzq. y",
        " ".join(a[:13] + a[:13] + a[5:30]), prose(62, 2000) + " " + b, prose(53, 20) + " " + prose(63, 9), " ".join(b.split()[:12])]
    return [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (12, texts[12], "s")]


@pytest.mark.parametrize("limit", [dc.MAX_BROADCAST_BYTES, 0])
def test_counts_equal_brute_force(spark, frame, monkeypatch, limit):
    monkeypatch.setattr(dc, "MAX_BROADCAST_BYTES", limit)  # 0: both sides are shuffled
    rows = documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS _cf_item", "0 AS _cf_hash")
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])
                    for r in dc.find_contamination(frame(rows), items).collect())
    assert found == Counter((i, *brute(t, ITEMS)) for i, t, _ in rows)


def test_removal(spark, frame):
    rows = documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(rows)
    kept = dc.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t, _ in rows if not brute(t, ITEMS)[3])
    cut = dc.remove_contaminated(docs, items, mode="span")
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert len(texts) == len({i for i, _, _ in rows})
    for i, t, _ in rows:
        n, hit, _, _ = brute(t, ITEMS)
        assert len(words(texts[i])) == n - hit
        assert texts[i] == t or hit


def test_empty_tables(spark, edges, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.find_contamination(empty, some).count() == 0
    assert dc.find_contamination(edges, none).filter("contaminated or n_items > 0").count() == 0
    assert dc.find_contamination(edges, none).count() == len(EDGES)
