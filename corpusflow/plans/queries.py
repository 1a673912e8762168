"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads whole tables (no id subsets, no row caps except where the
limit is the operator itself) and aliases every computed column to the name
used by the matching DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import EVAL_COMPRESSION, HASH_DIM, ChunkConfig, CompressionConfig, SearchConfig
from corpusflow.functions import text as tx
from corpusflow.functions.hashing import chunk_id
from corpusflow.functions.vectors import cosine, l2_normalise, norm
from corpusflow.operators import context as ctx
from corpusflow.operators.ann import ann_topk, build_ann
from corpusflow.operators.answers import answer_prompts
from corpusflow.operators import maintenance as mt
from corpusflow.operators.chunking import chunk_documents, combined_text, fetch_document
from corpusflow.operators.embedding import (md5_hash_vector, sparse_entries, split_by_contract,
                                            vector_violation)
from corpusflow.operators.evaluation import ratio_reduction, recall_at_k
from corpusflow.operators.search import compare_strategies, search
from corpusflow.operators.lexical import bm25_topk
from corpusflow.operators.matching import contained_items
from corpusflow.operators.quantiles import summary_stats
from corpusflow.operators.vector_search import knn_topk
from corpusflow.sources import files
from corpusflow.sources.tables import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = SearchConfig().k
SEARCH = SearchConfig()


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _chunks(spark, sf) -> DataFrame:
    return chunk_documents(documents(spark, sf), ChunkConfig(), keep=["doc_id"])


def _ranked(df: DataFrame, key: str) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("bigint").alias("rank"), key, "score")


# =========================================================================== A: sources / sinks
@register("corpus_scan")
def corpus_scan(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", "filename", F.length("content").cast("bigint").alias("n_chars"),
                    F.octet_length("content").cast("bigint").alias("n_bytes"))


def _stored_files(spark, sf) -> DataFrame:
    """Documents as file rows: some of another suffix, some of upper-case suffix, some with a byte that is no UTF-8, some empty."""
    suffix = F.expr("CASE WHEN doc_id % 11 = 3 THEN '.pdf' WHEN doc_id % 11 = 5 THEN '.MD' ELSE '.txt' END")
    body = F.encode(F.col("text"), "UTF-8")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("inbox/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.expr("doc_id % 17 = 2").alias("none"), F.expr("doc_id % 13 = 4").alias("odd"), body.alias("body")).select(
        "path", F.when(F.col("none"), F.lit(b"")).when(F.col("odd"), F.concat("body", F.lit(b"\xff"))).otherwise(F.col("body")).alias("content"))


@register("file_routing")
def file_routing(spark, sf):
    docs, quarantine = files.route_files(_stored_files(spark, sf))
    kept = docs.select("path", "filename", F.length("content").cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(quarantine.select(F.col("key").alias("path"), F.lit(None).cast("string").alias("filename"),
                                              F.lit(None).cast("bigint").alias("n_chars"), "reason"))


@register("ingest_quarantine")
def ingest_quarantine(spark, sf):
    d = documents(spark, sf)
    status = (F.when(F.col("content").isNull(), F.lit("missing"))
              .when(F.length(tx.compact("content")) == 0, F.lit("empty"))
              .otherwise(F.lit("stored")))
    return d.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("documents"))


@register("assemble_pages")
def assemble_pages(spark, sf):
    turns = table(spark, sf, "conversations")
    return files.assemble_pages(turns, "conv_id", "turn", "text").join(
        turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages")), "conv_id").select("conv_id", "pages", "content")


@register("select_recent")
def select_recent(spark, sf):
    ev = table(spark, sf, "events")
    as_of = ev.agg(F.max("ts").alias("m")).first()["m"]
    recent = ev.where((F.col("event_type") == "view") & (F.col("ts") >= F.lit(as_of) - F.expr("INTERVAL 7 DAYS")))
    return recent.orderBy(F.col("ts").desc(), F.col("event_id").asc()).limit(200).select(
        "event_id", "user_id", "value")


@register("index_rows")
def index_rows_q(spark, sf):
    idx = mt.index_rows(documents(spark, sf), keep=["doc_id"])

    def nnz(c):
        return F.size(F.filter(c, lambda x: x != 0)).cast("bigint")

    return idx.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id", "provider", "model",
        F.col("dimension").cast("bigint").alias("dimension"),
        nnz(F.col("content_embedding")).alias("content_nnz"),
        nnz(F.col("filename_embedding")).alias("filename_nnz"),
        nnz(F.col("combined_embedding")).alias("combined_nnz"),
    )


@register("dimension_guard")
def dimension_guard_q(spark, sf):
    emb = table(spark, sf, "embeddings")
    a = mt.dimension_guard(emb, 64, fields=("embedding",))
    b = mt.dimension_guard(emb, 768, fields=("embedding",))
    return a.unionByName(b)


# =========================================================================== B: text operators
@register("chunk_documents")
def chunk_documents_q(spark, sf):
    return _chunks(spark, sf).select("doc_id", "filename", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                                     "content")


@register("chunk_ids")
def chunk_ids_q(spark, sf):
    c = _chunks(spark, sf)
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id",
                    chunk_id("filename", "chunk_index", "content", legacy=True).alias("legacy_chunk_id"))


@register("combined_text")
def combined_text_q(spark, sf):
    c = _chunks(spark, sf)
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                    combined_text(F.col("filename"), F.col("content")).alias("combined_text"))


@register("compact_text")
def compact_text_q(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.compact("text").alias("compacted"))


@register("truncate_head")
def truncate_head_q(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.truncate("text", EVAL_COMPRESSION.max_chunk_chars).alias("truncated"))


@register("truncate_tail")
def truncate_tail_q(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.truncate("text", EVAL_COMPRESSION.max_chunk_chars, keep_tail=True).alias("truncated"))


@register("clean_text")
def clean_text_q(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_text("text").alias("cleaned"))


@register("html_to_text")
def html_to_text_q(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.html_to_text("html").alias("text"))


@register("base64_text_roundtrip")
def base64_roundtrip_q(spark, sf):
    d = table(spark, sf, "documents")
    # URL-safe, unpadded, unwrapped (the JVM encoder may wrap lines at 76 characters).
    enc = F.translate(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\\r\\n=]", ""), "+/", "-_")
    dec = F.unbase64(F.translate(enc, "-_", "+/")).cast("string")
    fixed = F.when(F.is_valid_utf8(dec), dec).otherwise(F.translate(F.make_valid_utf8(dec), "\ufffd", ""))
    return d.select("doc_id", F.length(enc).cast("bigint").alias("encoded_len"), fixed.alias("decoded"))


MAIL_PREFIX = "mail:"


@register("mail_documents")
def mail_documents_q(spark, sf):
    d = table(spark, sf, "documents")
    subject = tx.first_non_empty(tx.compact(F.left("text", F.lit(40))), "(no subject)")
    content = F.concat(F.lit("Subject: "), subject, F.lit("\nFrom: "), F.coalesce("source", F.lit("")),
                       F.lit("\nDate: "), F.coalesce("lang", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return d.select(F.concat(F.lit(MAIL_PREFIX), F.col("doc_id").cast("string")).alias("filename"),
                    content.alias("content"))


# =========================================================================== C: embeddings
@register("hash_embed_sparse")
def hash_embed_sparse_q(spark, sf):
    d = table(spark, sf, "documents")
    v = d.select("doc_id", F.explode(sparse_entries(md5_hash_vector("text"))).alias("e"))
    return v.select("doc_id", F.col("e.bucket").alias("bucket"), F.round("e.weight", 9).alias("weight"))


@register("hash_embed_blake2b")
def hash_embed_blake2b_q(spark, sf):
    from corpusflow.functions.udfs import blake2b_embed

    d = table(spark, sf, "documents")
    v = d.select("doc_id", blake2b_embed(HASH_DIM)("text").alias("v"))
    return v.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).cast("bigint").alias("nnz"),
                    F.round(norm("v"), 6).alias("norm"))


@register("l2_normalise")
def l2_normalise_q(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(l2_normalise("embedding")).alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("value"))


@register("three_vectors")
def three_vectors_q(spark, sf):
    idx = mt.index_rows(documents(spark, sf), keep=["doc_id"])
    return idx.select(
        "chunk_id",
        F.round(cosine("content_embedding", "combined_embedding"), 6).alias("content_combined_cos"),
        F.round(cosine("content_embedding", "filename_embedding"), 6).alias("content_filename_cos"),
    )


def _odd_vectors(spark, sf) -> DataFrame:
    """The embeddings, of which some are null, empty, too short, or hold a value that is none."""
    v = F.col("embedding")
    kind = F.col("vec_id") % 50
    return table(spark, sf, "embeddings").withColumn("embedding", F.when(kind == 1, F.lit(None)).when(kind == 2, F.slice(v, 1, 63)).when(
        kind == 3, F.transform(v, lambda x, i: F.when(i == 5, F.lit(float("nan")).cast("float")).otherwise(x))).when(
        kind == 4, F.slice(v, 1, 0)).when(kind == 5, F.transform(v, lambda x, i: F.when(i == 7, F.lit(None)).otherwise(x))).otherwise(v))


@register("vector_contract")
def vector_contract_q(spark, sf):
    status = F.coalesce(vector_violation(F.col("embedding"), 64), F.lit("ok"))
    return _odd_vectors(spark, sf).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("vectors"))


@register("null_vector_rows")
def null_vector_rows_q(spark, sf):
    _, bad = split_by_contract(_odd_vectors(spark, sf), "embedding", 64)
    return bad.select("vec_id", "reason", "detail")


# =========================================================================== D/E: search
def _dense_knn(spark, sf, corpus_filter=None, k=K, offset=SEARCH.score_offset, exclude_self=False):
    e = table(spark, sf, "embeddings")
    corpus = e if corpus_filter is None else e.where(corpus_filter)
    return knn_topk(corpus, e, corpus_key="vec_id", corpus_vec="embedding", query_key="vec_id",
                    query_vec="embedding", k=k, kind="dense", score_offset=offset, exclude_self=exclude_self)


@register("cosine_pairs")
def cosine_pairs_q(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    j = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return j.select("a_id", "b_id", F.round(cosine("a", "b"), 6).alias("cosine"))


@register("vector_topk")
def vector_topk_q(spark, sf):
    return _ranked(_dense_knn(spark, sf), "vec_id")


@register("filtered_vector_topk")
def filtered_vector_topk_q(spark, sf):
    return _ranked(_dense_knn(spark, sf, corpus_filter=F.col("label") == 3), "vec_id")


@register("ann_recall")
def ann_recall_q(spark, sf):
    """The approximate index over all embeddings, searched for every 50th of them and held against the exact search."""
    e = table(spark, sf, "embeddings")
    index = build_ann(e, key="vec_id", vec="embedding", k=K)
    asked = e.where(F.col("vec_id") % 50 == 0)
    near = ann_topk(index, asked, query_key="vec_id", query_vec="embedding", k=K)
    exact = knn_topk(e, asked, corpus_key="vec_id", corpus_vec="embedding", query_key="vec_id", query_vec="embedding", k=K)
    both = exact.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
                    (F.sum(F.coalesce("_hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


@register("label_precision_at_k")
def label_precision_q(spark, sf):
    e = table(spark, sf, "embeddings")
    res = _dense_knn(spark, sf, offset=0.0, exclude_self=True)
    lab = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    nl = e.select("vec_id", F.col("label").alias("nl"))
    j = res.join(lab, "query_id").join(nl, "vec_id")
    per_q = j.groupBy("query_id").agg(F.avg((F.col("ql") == F.col("nl")).cast("double")).alias("p"))
    return per_q.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("p"), 4).alias("precision_at_k"))


def _item_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _search(spark, sf, strategy: str, k: int) -> DataFrame:
    # Only ids and scores are reported: no payload travels with the candidates.
    return search(_chunks(spark, sf), _item_queries(spark, sf), strategy=strategy, k=k, payload=())


@register("content_vector_topk")
def content_vector_topk_q(spark, sf):
    return _ranked(_search(spark, sf, "content_only", K), "chunk_id")


@register("combined_vector_topk")
def combined_vector_topk_q(spark, sf):
    return _ranked(_search(spark, sf, "combined", K), "chunk_id")


@register("filename_vector_topk")
def filename_vector_topk_q(spark, sf):
    return _ranked(_search(spark, sf, "filename_only", K), "chunk_id")


@register("bm25_filename")
def bm25_filename_q(spark, sf):
    return _ranked(_search(spark, sf, "filename_text", K), "chunk_id")


@register("bm25_url")
def bm25_url_q(spark, sf):
    p = table(spark, sf, "pages")
    res = bm25_topk(p, _item_queries(spark, sf), corpus_key="page_id", field="url", query_key="query_id",
                    query_text="text", k=K)
    return _ranked(res, "page_id")


@register("hybrid_search")
def hybrid_search_q(spark, sf):
    return _ranked(_search(spark, sf, "hybrid", K), "chunk_id")


@register("strategy_compare")
def strategy_compare_q(spark, sf):
    res = compare_strategies(_chunks(spark, sf), _item_queries(spark, sf), k=5, payload=())
    return res.select("strategy", "query_id", "rank", "chunk_id", "score")


@register("document_chunks")
def document_chunks_q(spark, sf):
    d = documents(spark, sf)
    target = d.orderBy(F.length("content").desc(), F.col("doc_id").asc()).limit(1).select("filename")
    c = chunk_documents(d.join(F.broadcast(target), "filename", "left_semi"), ChunkConfig())
    return fetch_document(c).select(
        "filename", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id", "content")


# =========================================================================== E8 / F2: evaluation
def _benchmark_truth(spark, sf):
    """(item_id, doc_id) containment pairs, materialised once: the queries below use
    them three or four times (item selection, hit test per variant)."""
    docs = table(spark, sf, "documents")
    items = table(spark, sf, "benchmark")
    truth = contained_items(docs, items, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text")
    return truth.checkpoint(eager=True)


def _doc_hash_topk(spark, sf, queries: DataFrame, k: int = K, qkey: str = "item_id", qtext: str = "text",
                   payload=()):
    docs = documents(spark, sf).select(*dict.fromkeys(["doc_id", *payload, "content"]))
    q = queries.select(qkey, F.col(qtext).alias("qvec"))
    return knn_topk(docs, q, corpus_key="doc_id", corpus_vec="content", query_key=qkey, query_vec="qvec",
                    k=k, kind="text", dim=HASH_DIM, score_offset=0.0, payload=payload)


@register("eval_topk")
def eval_topk(spark, sf):
    res = _doc_hash_topk(spark, sf, table(spark, sf, "benchmark"))
    return res.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


@register("recall_at_k")
def recall_at_k_q(spark, sf):
    truth = _benchmark_truth(spark, sf)
    items = table(spark, sf, "benchmark").join(truth.select("item_id").distinct(), "item_id", "left_semi")
    res = _doc_hash_topk(spark, sf, items)
    return recall_at_k(res, truth, items.withColumnRenamed("item_id", "query_id"))


# =========================================================================== F: aggregations
@register("index_stats")
def index_stats_q(spark, sf):
    return mt.index_stats(_chunks(spark, sf))


@register("latency_percentiles")
def latency_percentiles_q(spark, sf):
    ev = table(spark, sf, "events")
    return summary_stats(ev, ["event_type"], "value", {"p95": 0.95})


@register("corpus_stats")
def corpus_stats_q(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count(F.lit(1)).alias("documents"),
                 F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("characters"))


@register("ingest_status")
def ingest_status_q(spark, sf):
    return mt.ingest_status(documents(spark, sf))


@register("ingest_summary")
def ingest_summary_q(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("events"))


@register("duplicate_chunks")
def duplicate_chunks_q(spark, sf):
    return mt.duplicate_chunks(_chunks(spark, sf))


# =========================================================================== G: conversation / context
def _conv_queries(spark, sf, cfg: CompressionConfig) -> DataFrame:
    conv = table(spark, sf, "conversations")
    q = ctx.retrieval_queries(conv, cfg)
    return q.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
                    "message", "query")


def _answer_hits(spark, sf) -> DataFrame:
    """Chat retrieval: every user turn (raw message) against the combined chunk vectors."""
    q = _conv_queries(spark, sf, CompressionConfig(enabled=False)).select(
        F.col("qid").alias("query_id"), F.col("query").alias("text"))
    return search(_chunks(spark, sf), q, strategy="combined", k=K, payload=("filename", "content"))


@register("turn_pairs")
def turn_pairs_q(spark, sf):
    return ctx.turn_pairs(table(spark, sf, "conversations"))


@register("retrieval_queries")
def retrieval_queries_q(spark, sf):
    q = ctx.retrieval_queries(table(spark, sf, "conversations"), CompressionConfig(enabled=True))
    return q.select("conv_id", "turn", "query")


@register("context_plain")
def context_plain_q(spark, sf):
    return ctx.pack_context(_answer_hits(spark, sf), CompressionConfig(enabled=False))


@register("pack_context")
def pack_context_q(spark, sf):
    return ctx.pack_context(_answer_hits(spark, sf), EVAL_COMPRESSION)


@register("sources_block")
def sources_block_q(spark, sf):
    return ctx.sources_block(_answer_hits(spark, sf))


@register("build_prompts")
def build_prompts_q(spark, sf):
    hits = _answer_hits(spark, sf)
    contexts = ctx.pack_context(hits, CompressionConfig(enabled=False))
    msgs = _conv_queries(spark, sf, CompressionConfig(enabled=False)).select(
        F.col("qid").alias("query_id"), "message")
    return ctx.build_prompts(msgs, contexts)


@register("answer_compressed")
def answer_compressed_q(spark, sf):
    """Every user turn with its history, through search and packing, to the prompt and its sources."""
    return answer_prompts(table(spark, sf, "conversations"), _chunks(spark, sf), EVAL_COMPRESSION, k=K).select("query_id", "query", "prompt", "sources")


def _eval_variant(spark, sf, queries: DataFrame, qkey: str, message: str, query: str,
                  cfg: CompressionConfig, truth: DataFrame | None, variant: str) -> DataFrame:
    """One evaluation variant. The hits are read once: hit flags, plain and packed
    contexts all come out of one aggregate per query."""
    hits = _doc_hash_topk(spark, sf, queries, qkey=qkey, qtext=query, payload=("filename", "content"))
    extra = []
    if truth is not None:
        flag = truth.select(F.col("item_id").alias("query_id"), "doc_id").withColumn("_hit", F.lit(1))
        hits = hits.join(flag, ["query_id", "doc_id"], "left")
        extra = [F.max(F.coalesce("_hit", F.lit(0))).alias("_hit")]
    ctxs = ctx.contexts(hits.select("query_id", "rank", "filename", "content", *(["_hit"] if extra else [])),
                        cfg, extra_aggs=extra)
    per_q = (queries.select(F.col(qkey).alias("query_id"), F.length(message).alias("qb"), F.length(query).alias("qa"))
             .join(ctxs, "query_id", "left"))
    n = F.count(F.lit(1))
    rec = ([F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.sum(F.coalesce("_hit", F.lit(0))) / n, 4))
            .alias("recall_at_k")] if extra else [])
    sums = per_q.agg(
        n.alias("queries"),
        *rec,
        F.coalesce(F.sum("qb"), F.lit(0)).cast("bigint").alias("query_chars_before"),
        F.coalesce(F.sum("qa"), F.lit(0)).cast("bigint").alias("query_chars_after"),
        F.coalesce(F.sum(F.length("context_plain")), F.lit(0)).cast("bigint").alias("context_chars_before"),
        F.coalesce(F.sum(F.length("context_packed")), F.lit(0)).cast("bigint").alias("context_chars_after"),
    ).withColumn("context_reduction_ratio",
                 ratio_reduction(F.col("context_chars_before"), F.col("context_chars_after")))
    return sums.select(F.lit(variant).alias("variant"), "*")


@register("context_reduction")
def context_reduction_q(spark, sf):
    q = _conv_queries(spark, sf, EVAL_COMPRESSION)
    return _eval_variant(spark, sf, q, "qid", "message", "query", EVAL_COMPRESSION, None, "compressed")


@register("eval_report")
def eval_report_q(spark, sf):
    truth = _benchmark_truth(spark, sf)
    items = table(spark, sf, "benchmark").join(truth.select("item_id").distinct(), "item_id", "left_semi")
    base_q = items.select("item_id", F.col("text").alias("message"), F.col("text").alias("query"))
    comp_q = items.select("item_id", F.col("text").alias("message"), tx.compact("text").alias("query"))
    a = _eval_variant(spark, sf, base_q, "item_id", "message", "query", CompressionConfig(enabled=False), truth,
                      "baseline")
    b = _eval_variant(spark, sf, comp_q, "item_id", "message", "query", EVAL_COMPRESSION, truth, "compressed")
    return a.unionByName(b)


@register("recent_ingest_log")
def recent_ingest_log_q(spark, sf):
    ev = table(spark, sf, "events")
    return ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000).select(
        "event_id", "event_type", "value")


# =========================================================================== J: maintenance
@register("after_delete")
def after_delete_q(spark, sf):
    d = documents(spark, sf)
    c = chunk_documents(d, ChunkConfig(), keep=["doc_id"])
    toxic = d.join(table(spark, sf, "labels").where(F.col("toxic") == 1), "doc_id", "left_semi").select("filename")
    rest = mt.delete_documents(c, toxic)
    return rest.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id")


@register("replace_documents")
def replace_documents_q(spark, sf):
    d = documents(spark, sf)
    v1 = chunk_documents(d, ChunkConfig(), keep=["doc_id"]).withColumn("version", F.lit(1))
    good = d.join(table(spark, sf, "labels").where(F.col("quality") == 1), "doc_id", "left_semi")
    v2 = chunk_documents(good.withColumn("content", F.lower("content")), ChunkConfig(), keep=["doc_id"]).withColumn(
        "version", F.lit(2))
    latest = mt.latest_versions(v1.unionByName(v2))
    return latest.select("doc_id", F.col("version").cast("bigint").alias("version"),
                         F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpusflow.plans import mail_queries, table_queries  # noqa: F401  (they register theirs)

    return dict(QUERIES)
