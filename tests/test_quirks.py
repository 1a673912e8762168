"""One test per quirk decision: what we do where the reference's
behaviour is accidental."""

import pytest
from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig, CompressionConfig
from corpusflow.functions import text as tx
from corpusflow.operators import context as ctx
from corpusflow.operators import maintenance as mt
from corpusflow.operators.chunking import chunk_documents
from corpusflow.operators.embedding import split_by_contract
from corpusflow.operators.search import STRATEGIES, compare_strategies, search


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(
        [(1, "garden notes.md", "tomatoes water compost garden"), (2, "travel.txt", "train to montreal"),
         (3, "garden.txt", "plant tomatoes in spring")], "doc_id long, filename string, content string")
    return chunk_documents(docs, ChunkConfig(50, 5), keep=["doc_id"])


def test_q1_ids_include_filename_by_default(spark):
    docs = spark.createDataFrame([(1, "a.txt", "same"), (2, "b.txt", "same")], "doc_id long, filename string, content string")
    ids = {r["chunk_id"] for r in chunk_documents(docs, ChunkConfig(5, 1)).collect()}
    assert len(ids) == 2 and all(i.startswith(("a.txt_", "b.txt_")) for i in ids)


def test_q2_q3_every_strategy_runs(spark, corpus):
    q = spark.createDataFrame([(1, "garden tomatoes")], "query_id long, text string")
    got = {r["strategy"] for r in compare_strategies(corpus, q, k=2).collect()}
    assert got == set(STRATEGIES)


def test_q4_delete_uses_exact_filename(spark, corpus):
    rest = mt.delete_documents(corpus, spark.createDataFrame([("garden notes.md",)], "filename string"))
    assert sorted({r["filename"] for r in rest.collect()}) == ["garden.txt", "travel.txt"]


def test_q6_c6_missing_vectors_are_quarantined_not_stored(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, None)], "id int, v array<double>")
    good, bad = split_by_contract(df, "v", 2)
    assert good.count() == 1 and bad.first()["reason"] == "null_vector"


def test_q7_hybrid_accepts_filters(spark, corpus):
    q = spark.createDataFrame([(1, "garden tomatoes")], "query_id long, text string")
    rows = search(corpus, q, strategy="hybrid", k=3, filters={"filename": "garden.txt"}).collect()
    assert {r["filename"] for r in rows} == {"garden.txt"}


def test_q8_overlap_not_smaller_than_size_rejected():
    with pytest.raises(ValueError):
        ChunkConfig(10, 10)


def test_q10_history_newlines_vanish(spark):
    conv = spark.createDataFrame([(1, 0, "user", "line one\nline two"), (1, 1, "assistant", "ok"),
                                  (1, 2, "user", "next")], "conv_id long, turn long, role string, text string")
    q = ctx.retrieval_queries(conv, CompressionConfig(enabled=True)).where("turn = 2").first()["query"]
    assert q == "Recent conversation:\nUser: line one line two Assistant: ok\nCurrent question:\nnext"


def test_q11_markup_with_gt_in_attribute(spark):
    rows = [('<p title="a>b">text</p>', "text"), ("<a href='x>y' b=\"<>\">one</a> two", "one\ntwo"), ("caf&eacute; &#8217;x &amp;lt; A&B", "café ’x &lt; A&B"),
            ("1 < 2 and <b>3 > 2</b>", "1 < 2 and\n3 > 2"), ('<p title="open>text</p>', "text"), ("&copy; &quot;x&quot;", '© "x"'), (None, "")]
    df = spark.createDataFrame([(h,) for h, _ in rows], "h string")
    assert [r[0] for r in df.select(tx.html_to_text("h")).collect()] == [t for _, t in rows]


def test_q14_index_write_reports_stored_count(spark, tmp_path, corpus):
    idx = mt.index_rows(corpus.select("doc_id", "filename", "content").dropDuplicates(["doc_id"]), keep=["doc_id"])
    assert mt.write_index(idx, str(tmp_path / "idx"))["stored"] == 3


def test_q15_bad_search_request_fails_loudly(spark, corpus):
    q = spark.createDataFrame([(1, "x")], "query_id long, text string")
    with pytest.raises(ValueError):
        search(corpus, q, strategy="semantic")
