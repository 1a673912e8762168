import json
import os
import tempfile

from pyspark.sql import functions as F

from corpusflow.functions.udfs import blake2b_embed
from corpusflow.operators.evaluation import run_evaluation
from corpusflow.operators.vector_search import knn_topk
from corpusflow.sources.eval_corpus import read_eval_corpus
from sample_corpus import SAMPLE_CORPUS


def _load(spark):
    root = tempfile.mkdtemp(prefix="cf-golden-")
    path = os.path.join(root, "corpus.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(SAMPLE_CORPUS, f, indent=2)
    return read_eval_corpus(spark, path)


def test_baseline_top3_golden(spark):
    docs, queries = _load(spark)
    emb = blake2b_embed(256)
    corpus = docs.select("pos", "id", emb(F.col("content")).alias("v"))
    q = queries.select("query_id", emb(F.col("text")).alias("qv"))
    res = knn_topk(corpus, q, corpus_key="pos", corpus_vec="v", query_key="query_id", query_vec="qv", k=3,
                   payload=("id",)).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got[0] == [("travel", 0.402911), ("health", 0.151186), ("project", 0.078811)]
    assert got[1] == [("project", 0.472866), ("garden", 0.218218), ("finance", 0.173422)]
    assert [d for d, _ in got[4]] == ["travel", "health", "garden"]


def test_report_golden(spark):
    docs, queries = _load(spark)
    rep = run_evaluation(docs, queries, k=3).first()
    assert rep["corpus"]["documents"] == 6 and rep["corpus"]["characters"] == 726
    b, c = rep["retrieval_baseline"], rep["retrieval_with_compression"]
    assert b["recall_at_k"] == 0.8 and c["recall_at_k"] == 0.8
    assert (b["query_chars_before"], b["query_chars_after"]) == (201, 201)
    assert (c["query_chars_before"], c["query_chars_after"]) == (201, 448)
    assert (b["context_chars_before"], b["context_chars_after"], b["context_reduction_ratio"]) == (2167, 2167, 0.0)
    assert (c["context_chars_before"], c["context_chars_after"]) == (2162, 1999)
    assert c["context_reduction_ratio"] == 0.0754


def test_measured_sections(spark, tmp_path):
    from corpusflow.operators.evaluation import measured_evaluation
    from corpusflow.sources.eval_corpus import write_report

    docs, queries = _load(spark)
    report, sections = measured_evaluation(docs, queries, k=3, repeats=2)
    assert sections["ingest"]["documents_per_second"] > 0 and sections["latency"]["p50_ms"] <= sections["latency"]["p95_ms"]
    write_report(report, str(tmp_path / "report"), sections)
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert sorted(json.loads(text)) == ["corpus", "ingest", "latency", "provider", "retrieval_baseline", "retrieval_with_compression"]
