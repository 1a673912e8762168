import math
import random

import numpy as np
import pytest

from corpusflow.operators.fusion import fuse
from corpusflow.operators.lexical import bm25_topk
from corpusflow.operators.matching import contained_items
from corpusflow.operators.vector_search import knn_topk


def _brute(queries, corpus, k, offset=0.0, exclude_self=False):
    out = {}
    for qid, qv in queries:
        scored = []
        for cid, cv in corpus:
            if exclude_self and cid == qid:
                continue
            qa, ca = np.asarray(qv, float), np.asarray(cv, float)
            nq, nc = np.linalg.norm(qa), np.linalg.norm(ca)
            cos = 0.0 if nq == 0 or nc == 0 else float(qa @ ca / (nq * nc))
            scored.append((-round(cos + offset, 6), cid))
        scored.sort()
        out[qid] = [(cid, -s) for s, cid in scored[:k]]
    return out


def _vectors(n, dim, seed, ties=False):
    rnd = random.Random(seed)
    vs = []
    for i in range(n):
        if ties and i % 3 == 0:
            v = [1.0] + [0.0] * (dim - 1)
        elif i % 17 == 5:
            v = [0.0] * dim
        else:
            v = [rnd.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(dim)]
        vs.append((i, v))
    return vs


@pytest.mark.parametrize("max_block_bytes", [64 * 1024 * 1024, 2_000])
def test_knn_matches_brute_force(spark, max_block_bytes):
    corpus = _vectors(300, 8, 1, ties=True)
    queries = _vectors(40, 8, 2, ties=True)
    cdf = spark.createDataFrame(corpus, "id long, v array<double>").repartition(5)
    qdf = spark.createDataFrame(queries, "qid long, v array<double>")
    res = knn_topk(cdf, qdf, corpus_key="id", corpus_vec="v", query_key="qid", query_vec="v", k=4,
                   score_offset=1.0, max_block_bytes=max_block_bytes).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == _brute(queries, corpus, 4, offset=1.0)


def test_knn_exclude_self_and_payload(spark):
    corpus = _vectors(60, 4, 3)
    cdf = spark.createDataFrame([(i, v, f"doc{i}") for i, v in corpus], "id long, v array<float>, name string")
    res = knn_topk(cdf, cdf, corpus_key="id", corpus_vec="v", query_key="id", query_vec="v", k=2,
                   exclude_self=True, payload=("name",)).collect()
    assert all(r["query_id"] != r["id"] and r["name"] == f"doc{r['id']}" for r in res)
    exp = _brute([(i, list(np.float32(v))) for i, v in corpus], [(i, list(np.float32(v))) for i, v in corpus], 2,
                 exclude_self=True)
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == exp


def test_knn_plan_has_no_cartesian_product(spark):
    cdf = spark.createDataFrame(_vectors(10, 3, 4), "id long, v array<double>")
    plan = knn_topk(cdf, cdf, corpus_key="id", corpus_vec="v", query_key="id", query_vec="v", k=2) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan and plan.count("MapInArrow") == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = knn_topk(cdf, cdf, corpus_key="id", corpus_vec="v", query_key="id", query_vec="v", k=2, max_block_bytes=10)
        plan = wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "hashpartitioning(x" in plan


def test_grid_follows_the_bytes_of_both_sides():
    from corpusflow.plans.cells import TASK_BYTES, grid

    assert grid(100, 100, 16) == (4, 4)
    assert grid(10**6, 1, 16) == (16, 1)
    assert grid(1, 10**6, 16) == (1, 16)
    across, down = grid(TASK_BYTES * 1000, TASK_BYTES * 10, 16)
    assert across * down >= 1010 and 60 < across / down < 160


def test_ten_times_the_queries_leave_the_driver_flat(spark):
    """Only the number and size of query cells reach the driver: nothing is collected or broadcast from Python."""
    import inspect

    from corpusflow.operators import vector_search
    from corpusflow.plans import cells

    for module in (vector_search, cells):
        code = inspect.getsource(module)
        assert "toPandas" not in code and ".collect()" not in code and "sparkContext.broadcast" not in code
    corpus = spark.createDataFrame(_vectors(50, 4, 3), "id long, v array<double>")
    for n in (300, 3000):
        queries = spark.createDataFrame(_vectors(n, 4, 5), "qid long, v array<double>")
        found = knn_topk(corpus, queries, corpus_key="id", corpus_vec="v", query_key="qid", query_vec="v", k=1, max_block_bytes=20_000)
        assert found.count() == n


def _bm25_spec(docs, queries, k, k1=1.2, b=0.75):
    import re
    tok = lambda s: [t for t in re.split(r"[^\w]+|_", s.lower()) if t]
    toks = {d: tok(t) for d, t in docs}
    n = len(docs)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = {}
    for t in toks.values():
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = {}
    for qid, qt in queries:
        scores = []
        for d, t in toks.items():
            s = 0.0
            for term in set(tok(qt)):
                tf = t.count(term)
                if tf:
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    s += idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl)))
            if s > 0:
                scores.append((-round(s, 6), d))
        scores.sort()
        out[qid] = [(d, -s) for s, d in scores[:k]]
    return out


def test_bm25_matches_spec(spark):
    docs = [(i, n) for i, n in enumerate(["garden.md", "travel-notes.txt", "project-aurora.txt", "budget.txt",
                                           "garden-plan.txt", "notes.md", "aurora garden notes", ""])]
    queries = [(1, "garden notes"), (2, "aurora"), (3, "nothing matches"), (4, "txt txt notes")]
    cdf = spark.createDataFrame(docs, "id long, name string")
    qdf = spark.createDataFrame(queries, "qid long, text string")
    res = bm25_topk(cdf, qdf, corpus_key="id", field="name", query_key="qid", query_text="text", k=3).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    want = {q: v for q, v in _bm25_spec(docs, queries, 3).items() if v}
    assert got == want


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 3), (3, 5), (4, 2)])
def test_bm25_on_random_rows_with_hot_terms(spark, seed, k):
    """One term in nearly all rows, many alike rows, weak terms that must not be lost, salted postings."""
    rnd = random.Random(seed)
    rare = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join((["txt"] if rnd.random() < 0.95 else []) + (["en"] if rnd.random() < 0.5 else [])
                         + [rnd.choice(rare) for _ in range(rnd.choice([0, 0, 1, 1, 2, 6]))] + ["x"] * rnd.randint(0, 2))) for i in range(600)]
    queries = [(q, " ".join(["txt", "en", *(rnd.choice(rare + ["none"]) for _ in range(rnd.randint(0, 3)))][rnd.randint(0, 1):])) for q in range(40)]
    queries += [(50, ""), (51, "txt"), (52, "absent")]
    cdf = spark.createDataFrame([(i, t, f"p{i}") for i, t in docs], "id long, name string, extra string").repartition(3)
    qdf = spark.createDataFrame([*queries, (60, None)], "qid long, text string")
    res = bm25_topk(cdf, qdf, corpus_key="id", field="name", query_key="qid", query_text="text", k=k, payload=("extra",), postings_per_salt=5).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        assert r["extra"] == f"p{r['id']}"
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == {q: v for q, v in _bm25_spec(docs, queries, k).items() if v}


def test_bm25_has_no_python_and_deals_hot_terms(spark):
    rows = spark.range(3000).selectExpr("id", "concat('hot w', id) AS name")
    asked = spark.range(20).selectExpr("id AS qid", "concat('hot w', id * 7) AS text")
    res = bm25_topk(rows, asked, corpus_key="id", field="name", query_key="qid", query_text="text", k=2, postings_per_salt=100)
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "salt" in plan
    got = {(r["query_id"], r["rank"]): r["id"] for r in res.collect()}
    assert all(got[q, 1] == 7 * q and got[q, 2] == (0 if q else 1) for q in range(20))


def test_fuse_sums_by_key(spark):
    a = spark.createDataFrame([(1, "c1", 2.0), (1, "c2", 1.5)], "query_id long, chunk_id string, score double")
    b = spark.createDataFrame([(1, "c2", 3.0), (1, "c3", 1.0)], "query_id long, chunk_id string, score double")
    res = fuse([(a, 0.7), (b, 0.3)], k=3, payload=()).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in res] == [("c2", 1.95), ("c1", 1.4), ("c3", 0.3)]


def test_contained_items(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "lazy dog"), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "quick brown"), (11, "dog"), (12, ""), (13, "cat")], "item_id long, text string")
    got = sorted(tuple(r) for r in contained_items(docs, items).collect())
    assert got == [(10, 1), (11, 2)]


def test_contained_items_against_plain_search(spark, monkeypatch):
    """Items of every length class, at every place, in hot boilerplate, repeated, with null ids and texts that cross slabs."""
    from corpusflow.operators import matching

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdé漢 ") for _ in range(rnd.randint(1, 9)))
    boiler = "the same passage stands in very many of these texts, word for word"
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60))) + (boiler if i % 2 else "")) for i in range(300)]
    docs += [(500, None), (501, ""), (None, boiler + " null id"), (7, docs[7][1]), (502, "ab" * 4000 + "needle in a long text " + "ba" * 4000)]
    items = [(k, t) for k, t in enumerate([boiler, boiler[5:40], "a", "é", "漢", "ab", "bcd", "never there", "needle in a long", "abab" * 12, "",
                                           None, "null id", boiler])]
    for k in range(100, 160):
        text = rnd.choice(docs)[1] or "zz"
        start = rnd.randrange(max(1, len(text)))
        items.append((k, text[start:start + rnd.choice([1, 2, 3, 5, 9, 17, 30, 31, 40, 90])]))
    want = sorted((str(k), str(d)) for k, t in items for d, text in docs if t and text is not None and t in text)
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    idf = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["item_id"]), str(r["doc_id"])) for r in matching.contained_items(ddf, idf).collect())
    assert got == want
    assert matching.contained_items(ddf, idf.where("item_id = 10")).collect() == []
    assert matching.contained_items(ddf.limit(0), idf).collect() == []


def test_containment_reads_texts_in_bounded_batches(spark):
    """A task gets 8 MB of texts at a time, also if no search was made in the session before."""
    from corpusflow.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        docs = spark.createDataFrame([(1, "the quick brown fox"), (2, None)], "doc_id long, text string")
        found = contained_items(docs, spark.createDataFrame([(10, "quick brown")], "item_id long, text string"))
        assert int(spark.conf.get(key).rstrip("b")) == BATCH_BYTES
        assert [tuple(r) for r in found.collect()] == [(10, 1)]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_windows_of_a_passage_are_those_of_the_text_around_it(monkeypatch):
    from corpusflow.operators import matching

    rng = np.random.default_rng(2)
    for _ in range(200):
        data = rng.integers(97, 100, rng.integers(40, 400)).astype(np.uint8)
        a = rng.integers(0, len(data) - 35)
        b = rng.integers(a + 1, len(data) + 1)
        c = matching.length_class(b - a)
        width, span = matching.CLASSES[c]
        inner = matching.span_hashes(data[a:b], width, span)
        assert len(inner) and set(inner) <= set(matching.span_hashes(data, width, span))
        monkeypatch.setattr(matching, "_SLAB", 50)  # slabs and texts that follow each other lose no window
        texts = [data, data[a:b], data[:3], data[a:]]
        offsets = np.cumsum([0, *map(len, texts)])
        kept = [set() for _ in texts]
        for owner, hashes in matching.text_windows(np.concatenate(texts), offsets, width, span):
            for o, h in zip(owner, hashes.view(np.uint64)):
                kept[o].add(h)
        assert all(set(matching.span_hashes(t, width, span)) == k for t, k in zip(texts, kept))


def test_search_dispatch_and_filters(spark):
    from corpusflow.config import ChunkConfig
    from corpusflow.operators.chunking import chunk_documents
    from corpusflow.operators.search import search

    docs = spark.createDataFrame([(1, "garden.md", "tomatoes water compost"), (2, "travel.txt", "train to montreal"),
                                  (3, "garden-plan.txt", "plant tomatoes in spring")],
                                 "doc_id long, filename string, content string")
    chunks = chunk_documents(docs, ChunkConfig(50, 5), keep=["doc_id"])
    q = spark.createDataFrame([(1, "garden tomatoes")], "query_id long, text string")
    for strategy in ("content_only", "filename_only", "filename_text", "combined", "hybrid"):
        rows = search(chunks, q, strategy=strategy, k=2).collect()
        assert 1 <= len(rows) <= 2 and all(r["query_id"] == 1 for r in rows)
    only = search(chunks, q, strategy="content_only", k=3, filters={"filename": "travel.txt"}).collect()
    assert [r["filename"] for r in only] == ["travel.txt"]
    with pytest.raises(ValueError):
        search(chunks, q, strategy="nope")


def test_search_on_stored_index_vectors_matches_text_path(spark):
    from corpusflow.operators.maintenance import index_rows
    from corpusflow.operators.search import search

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "doc_id", "concat(source, '-', lang, '-', cast(doc_id as string), '.txt') AS filename", "text AS content")
    idx = index_rows(docs, keep=["doc_id"]).cache()
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS query_id", "text")
    for strategy in ("content_only", "combined", "filename_only"):
        a = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"])
             for r in search(idx, q, strategy=strategy, k=3, payload=()).collect()}
        b = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"])
             for r in search(idx, q, strategy=strategy, k=3, payload=(), vectors="stored").collect()}
        assert a.keys() == b.keys()
        # float32 at rest: scores agree to 1e-6; ids agree except on float-level near-ties
        assert all(abs(a[x][1] - b[x][1]) <= 2e-6 for x in a), strategy
        same = sum(a[x][0] == b[x][0] for x in a)
        assert same >= 0.95 * len(a), strategy
    idx.unpersist()


def test_a_users_embedder_builds_and_searches_the_index(spark, tmp_path):
    """Two embedders give different, checked rankings; a text that fails loses its own row only."""
    import numpy as np
    from pyspark.sql import functions as F

    from corpusflow.operators.embedding import CallableProvider
    from corpusflow.operators.maintenance import index_parts, index_rows, write_index
    from corpusflow.operators.search import search

    def letters(alphabet):
        def fn(text):
            if "poison" in text:
                raise ValueError("poison")
            return [1.0 + text.count(c) for c in alphabet]

        return fn

    docs = spark.createDataFrame([("a.txt", "aaa bb"), ("b.txt", "b bbb a"), ("c.txt", "ccc xx"), ("p.txt", "poison")], "filename string, content string")
    queries = spark.createDataFrame([(1, "aa"), (2, "bbbb"), (3, "x")], "query_id long, text string")
    for alphabet in ("abc", "xyc"):
        fn = letters(alphabet)
        embedder = lambda fn=fn: CallableProvider(fn, 3, name="letters", model=alphabet)
        good, bad = index_parts(index_rows(docs, embedder=embedder), 3)
        assert [r["filename"] for r in bad.select("filename").distinct().collect()] == ["p.txt"]
        path = str(tmp_path / alphabet)
        write_index(good, path)
        index = spark.read.parquet(path)
        assert {(r["provider"], r["model"], r["dimension"]) for r in index.collect()} == {("letters", alphabet, 3)}
        found = search(index, queries, strategy="content_only", k=3, embedder=embedder, payload=("filename", "metadata")).collect()

        def cos(a, b):
            a, b = np.array(fn(a)), np.array(fn(b))
            return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) + 1, 6)

        for q, text in [(1, "aa"), (2, "bbbb"), (3, "x")]:
            want = {f: cos(text, t) for f, t in [("a.txt", "aaa bb"), ("b.txt", "b bbb a"), ("c.txt", "ccc xx")]}
            got = {r["filename"]: r["score"] for r in found if r["query_id"] == q}
            assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 2e-6 for f in want)
            ranked = [r["score"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
            assert ranked == sorted(ranked, reverse=True)


def test_ties_give_k_candidates_and_odd_vectors_fail(spark):
    import pyarrow as pa

    from corpusflow.operators.vector_search import TopK

    rng = np.random.default_rng(1)
    for _ in range(50):
        top, want = TopK(5, 4), [[] for _ in range(5)]
        for cell in range(rng.integers(1, 6)):
            scores = rng.integers(0, 3, (5, 40)).astype(float)
            valid = rng.random((5, 40)) < 0.8
            keys = np.sort(rng.permutation(1000)[:40])
            top.add(scores, pa.table({"c": keys, "p": keys * 7}), valid)
            if rng.random() < 0.5:
                top.cut("c")
            for q in range(5):
                want[q] += [(-scores[q, i], int(keys[i])) for i in range(40) if valid[q, i]]
        got = [(r["_at"], -r["_score"], r["c"], r["p"]) for r in top.cut("c").to_pylist()]
        assert sorted(got) == [(q, s, c, 7 * c) for q in range(5) for s, c in sorted(want[q])[:4]]
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "c long, v array<double>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)], "q long, v array<double>")
    hits = knn_topk(same, queries, corpus_key="c", corpus_vec="v", query_key="q", query_vec="v", k=3).collect()
    assert len(hits) == 900 and {r["c"] for r in hits} == {0, 1, 2}
    odd = same.union(spark.createDataFrame([(999, [1.0])], "c long, v array<double>"))
    with pytest.raises(Exception, match="do not have dimension 2"):
        knn_topk(odd, queries, corpus_key="c", corpus_vec="v", query_key="q", query_vec="v", k=3).collect()


def test_payload_stays_out_of_the_cells(spark, monkeypatch):
    """Wide columns are joined to the hits: what a scoring task holds does not depend on them. Rows of one key keep their own."""
    from corpusflow.operators import vector_search

    seen, cells = [], vector_search._cells

    def spy(rows, *args):
        seen.append(rows.columns)
        return cells(rows, *args)

    monkeypatch.setattr(vector_search, "_cells", spy)
    rows = [(i % 30, [float(i % 30 == j) for j in range(30)], f"text {i}", None if i == 4 else i) for i in range(60)]
    corpus = spark.createDataFrame(rows, "id long, v array<float>, body string, n long").repartition(3)
    asked = spark.createDataFrame([(7, rows[7][1]), (4, rows[4][1])], "qid long, v array<float>")
    for size in (64 << 20, 100):
        hits = knn_topk(corpus, asked, corpus_key="id", corpus_vec="v", query_key="qid", query_vec="v", k=2, payload=("body", "n"), max_block_bytes=size)
        assert hits.columns == ["query_id", "id", "body", "n", "score", "rank"]
        got = {(r["query_id"], r["id"], r["body"], r["n"], r["score"]) for r in hits.collect()}
        assert got == {(q, q, f"text {i}", None if i == 4 else i, 1.0) for q in (7, 4) for i in (q, q + 30)}
    assert seen and not any({"body", "n"} & set(columns) for columns in seen)


def test_bounds_rise_with_the_first_cell():
    """Later cells are cut by what the first one gave, so candidates don't grow with the corpus; rounding keeps its ties."""
    import pyarrow as pa

    from corpusflow.operators.vector_search import TopK

    rng, top, held = np.random.default_rng(2), TopK(600, 3), []
    cells = [rng.random((600, 200)) for _ in range(40)]
    cells[1][0, :5] = cells[0][0].max() + 4e-7  # equal after rounding to 6 digits, or one step apart
    for n, scores in enumerate(cells):
        keys = pa.table({"c": np.arange(200) * 40 + n})
        for first in (0, 512):
            top.add(scores[first:first + 512], keys, first=first, digits=6)
        held.append(top.size)
        assert (top.floor > 0.5).all()
    assert held[-1] < 20 * held[0]  # the k best of each cell would be 40 times as many
    keys = np.stack([np.arange(200) * 40 + n for n in range(40)]).ravel()
    scores = np.round(np.concatenate(cells, axis=1), 6)
    got = {}
    for r in top.cut("c").to_pylist():
        got.setdefault(r["_at"], []).append((-r["_score"], r["c"]))
    assert got == {q: sorted(zip(-scores[q], keys.tolist()))[:3] for q in range(600)}


@pytest.mark.parametrize("kind, column, value, most", [("dense", "array<float>", [0.5] * 256, 4.2), ("text", "string", "some words of a text", 2.2)])
def test_cells_hold_numbers_as_narrow_as_given(spark, kind, column, value, most):
    from corpusflow.operators.vector_search import _cells

    rows = spark.createDataFrame([(i, value) for i in range(400)], f"id long, v {column}").coalesce(1)
    sizes = [len(r["cell"]) for r in _cells(rows, "id", "v", kind, 256).collect()]
    assert sum(sizes) < 400 * 256 * most
