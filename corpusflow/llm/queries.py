"""The registered queries of the operators in this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16
TOKENIZER = "word_bpe_49k.json"

#: The word rule in DuckDB: lower-case A-Z, then runs of ASCII digits, a-z and non-ASCII characters.
_SQL_WORDS = ("regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.expr("cast(get(places, 0).word as bigint)").alias("first_word"),
        F.expr("cast(try_element_at(places, -1).word as bigint)").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def _op1_sql() -> str:
    """Brute force: every phrase at every word, every notice against every block."""
    from corpusflow.llm.licenses import NOTICES, PHRASES, STRIDE

    def words(t) -> str:
        return "[" + ", ".join(f"'{w}'" for w in t.words) + "]"

    phrases = ", ".join(f"({k}, '{t.label}', {words(t)})" for k, t in enumerate(PHRASES))
    notices = ", ".join(f"('{t.label}', list_distinct({words(t)}), {t.needed})" for t in NOTICES)
    return f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents),
     phrase(k, label, p) AS (VALUES {phrases}), notice(label, t, needed) AS (VALUES {notices}),
     pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
     place AS (SELECT doc_id, label, k, i - 1 AS i FROM pos JOIN phrase ON w[i] = p[1] AND list_slice(w, i, i + len(p) - 1) = p),
     base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list(DISTINCT label)) AS l FROM place GROUP BY 1),
     block AS (SELECT doc_id, list_slice(w, i + 1, i + {2 * STRIDE}) AS b
               FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS i FROM d)),
     held AS (SELECT doc_id, label, needed, len(t) AS size, len(list_intersect(t, b)) AS n FROM block, notice),
     more AS (SELECT doc_id, list(DISTINCT label) AS l, max(n / size) AS score FROM held WHERE n >= needed GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word,
       coalesce(array_to_string(base.l, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base.l, []) || coalesce(more.l, []))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents),
     b AS (SELECT item_id, {_SQL_WORDS.format('text')} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS t
             FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT n FROM win),
     pos AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
             FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
     hit AS (SELECT p.doc_id, p.n, p.i, win.item_id FROM pos p JOIN win ON win.n = p.n AND win.t = p.t),
     cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
     its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                    sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS s FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.warc import read_warc, write_warc

    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(spark, path)
    # The digest of what was read; a revisit has the one that it was archived under.
    return read.select(F.expr("try_cast(page as bigint)").alias("page_id"), "payload_bytes",
                       F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
                       "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"), "error")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, max(page_id) AS top FROM p WHERE strlen(t) >= 1000 GROUP BY 1)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN g ON g.d = p.d AND strlen(t) >= 1000
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("text_key")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.toxicity import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text_key")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.sharding import balanced_shards

    placed = balanced_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.fingerprints import neighbour_likeness

    return neighbour_likeness(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusflow.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.pii import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                   s["end"].cast("string"))), ",") for c in ("base", "spans")}
    return found.select("doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.dialogues import damaged, repair_report

    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), ids=conversations)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_counts": op8_token_counts,
    "op9_personal_data": op9_personal_data,
    "op10_near_dedup": op10_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _op1_sql(),
    "op2_decontaminate": OP2_SQL,
    "op3_warc": OP3_SQL,
}
