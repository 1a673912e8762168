import numpy as np
import pytest

from corpusflow.operators import ann
from corpusflow.operators.ann import ann_topk, build_ann
from corpusflow.operators.vector_search import knn_topk


def _clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, [float(c) for c in centres[i % 12] + 0.6 * rng.normal(size=dim)], f"p{i}") for i in range(n)]


def test_recall_against_exact_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 64)
    rows = _clustered(3000, 16, 1) + [(5000, None, "none")]
    rows += [(6000 + i, rows[0][1], "hot") for i in range(1500)]  # one list holds a third of the rows
    corpus = spark.createDataFrame(rows, "id long, v array<float>, name string").repartition(4)
    index = build_ann(corpus, key="id", vec="v", payload=("name",), k=3)
    assert 1 < index.probes < len(index.centroids) // 2
    sizes = {}
    for r in index.lists.collect():
        sizes.setdefault(r["list"], []).append(r["slice"])
    assert len(sizes) <= len(index.centroids) and max(map(len, sizes.values())) == 1  # 1,500 rows fit one slice
    queries = corpus.where("id % 50 = 0")
    found = {(r["query_id"], r["rank"]): r for r in ann_topk(index, queries, query_key="id", query_vec="v", k=3).collect()}
    exact = {(r["query_id"], r["rank"]): r for r in knn_topk(corpus, queries, corpus_key="id", corpus_vec="v", query_key="id", query_vec="v", k=3).collect()}
    score = {(q, r["id"]): r["score"] for (q, _), r in exact.items()}
    assert sum((q, r["id"]) in score for (q, _), r in found.items()) >= 0.9 * len(exact)
    assert all(abs(r["score"] - score[q, r["id"]]) < 1e-9 for (q, _), r in found.items() if (q, r["id"]) in score)
    assert all(r["name"] == ("hot" if r["id"] >= 6000 else f"p{r['id']}") for r in found.values())
    every = ann_topk(index, queries, query_key="id", query_vec="v", k=3, probes=len(index.centroids)).collect()
    assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in every} == {(q, k, r["id"], r["score"]) for (q, k), r in exact.items()}


def test_hot_lists_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 50)
    rows = [(i, [1.0, 0.0], "a") for i in range(500)] + [(1000 + i, [0.0, 1.0], "b") for i in range(20)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>, name string")
    index = build_ann(corpus, key="id", vec="v")
    per_list = index.lists.groupBy("list").count().collect()
    assert max(r["count"] for r in per_list) >= 8
    got = ann_topk(index, corpus, query_key="id", query_vec="v", k=2, probes=len(index.centroids)).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == {
        (i, k): (0 if i < 1000 else 1000) + k - 1 for i, _, _ in rows for k in (1, 2)}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_index(spark, rows):
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    index = build_ann(corpus, key="id", vec="v")
    assert ann_topk(index, corpus, query_key="id", query_vec="v", k=2).collect() == []
