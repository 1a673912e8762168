"""DuckDB oracle SQL for the registered queries (same column names and types).

The oracle is deliberately written the plain, set-at-a-time way (sparse bucket
joins, term joins, cross joins over small vector tables) — it checks results, it
is not the execution strategy. Text in the driver tables only uses U+0020 and
U+000A as whitespace, so RE2's ``\\s`` is an exact stand-in for Python's set there.
"""

from __future__ import annotations

HASH_DIM = 256
SIZE, STEP = 500, 450  # chunk size 500 - overlap 50
NL = "chr(10)"
WS = "\\s+"

FILENAME = "source || '-' || lang || '-' || CAST(doc_id AS VARCHAR) || '.txt'"


def compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"


def trunc_head(x: str, lim: str) -> str:
    c = compact(x)
    return (f"(CASE WHEN ({lim}) <= 0 THEN '' WHEN length({c}) <= ({lim}) THEN {c} "
            f"WHEN ({lim}) <= 3 THEN left({c}, ({lim})) "
            f"ELSE rtrim(left({c}, ({lim}) - 3)) || '...' END)")


def trunc_tail(x: str, lim: str) -> str:
    c = compact(x)
    return (f"(CASE WHEN ({lim}) <= 0 THEN '' WHEN length({c}) <= ({lim}) THEN {c} "
            f"WHEN ({lim}) <= 3 THEN right({c}, ({lim})) "
            f"ELSE '...' || right({c}, ({lim}) - 3) END)")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> '')"


def lex_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def hash_vec_ctes(name: str, source: str, key: str, text: str, dim: int = HASH_DIM) -> str:
    """Sparse md5-bucket count vectors (id, bucket, c) and their norms (id, nrm)."""
    return f"""{name}_tok AS (
  SELECT {key} AS id, unnest({words(f'lower({text})')}) AS t FROM {source}),
{name} AS (
  SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS bucket, count(*)::DOUBLE AS c
  FROM {name}_tok GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM {name} GROUP BY id)"""


def sparse_cosine_cte(name: str, q: str, d: str, offset: float = 0.0) -> str:
    return f"""{name} AS (
  SELECT q.id AS query_id, d.id AS doc_key,
         round(sum(q.c * d.c) / (qn.nrm * dn.nrm) + {offset}, 6) AS score
  FROM {q} q JOIN {d} d USING (bucket)
  JOIN {q}_n qn ON qn.id = q.id JOIN {d}_n dn ON dn.id = d.id
  GROUP BY q.id, d.id, qn.nrm, dn.nrm)"""


def topk_cte(name: str, scores: str, k: int, key: str = "doc_key") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT query_id, {key}, score,
                        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank
                 FROM {scores}) WHERE rank <= {k})"""


CHUNKS_CTE = f"""cw AS (
  SELECT doc_id, {FILENAME} AS filename, {words('text')} AS w FROM documents),
cn AS (
  SELECT *, CASE WHEN len(w) = 0 THEN 0
                 ELSE 1 + CAST(ceil(greatest(len(w) - {SIZE}, 0) / {STEP}.0) AS BIGINT) END AS n_chunks
  FROM cw),
chunks0 AS (
  SELECT doc_id, filename, i AS chunk_index,
         array_to_string(w[i * {STEP} + 1 : i * {STEP} + {SIZE}], ' ') AS content
  FROM (SELECT doc_id, filename, w, unnest(range(n_chunks)) AS i FROM cn)),
chunks AS (
  SELECT *, filename || '_' || CAST(chunk_index AS VARCHAR) || '_' || substr(md5(content), 1, 8) AS chunk_id
  FROM chunks0)"""

DOCS_CTE = f"docs AS (SELECT doc_id, {FILENAME} AS filename, text AS content FROM documents)"

TRUTH_CTE = """truth AS (
  SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  WHERE length(b.text) > 0)"""

COMBINED = f"'Filename: ' || filename || {NL} || 'Content: ' || content"

ORACLE: dict[str, str] = {}

# ----------------------------------------------------------------------------- A
ORACLE["corpus_scan"] = f"""
SELECT doc_id, {FILENAME} AS filename, length(text)::BIGINT AS n_chars, strlen(text)::BIGINT AS n_bytes
FROM documents"""

ORACLE["file_routing"] = """
SELECT 'inbox/' || source || '/' || name AS path, CASE WHEN reason IS NULL THEN name END AS filename,
       CASE WHEN reason IS NULL THEN length(text)::BIGINT END AS n_chars, reason
FROM (SELECT source, text, CAST(doc_id AS VARCHAR) || CASE doc_id % 11 WHEN 3 THEN '.pdf' WHEN 5 THEN '.MD' ELSE '.txt' END AS name,
             CASE WHEN doc_id % 11 = 3 THEN 'unsupported_suffix' WHEN doc_id % 17 = 2 OR text IS NULL OR (text = '' AND doc_id % 13 <> 4) THEN 'empty'
                  WHEN doc_id % 13 = 4 THEN 'invalid_utf8' END AS reason
      FROM documents)"""

ORACLE["ingest_quarantine"] = f"""
SELECT CASE WHEN text IS NULL THEN 'missing' WHEN length({compact('text')}) = 0 THEN 'empty'
            ELSE 'stored' END AS status, count(*)::BIGINT AS documents
FROM documents GROUP BY ALL"""

ORACLE["assemble_pages"] = f"""
SELECT conv_id, count(*)::BIGINT AS pages, string_agg(text || {NL}, '' ORDER BY turn) AS content
FROM conversations GROUP BY conv_id"""

ORACLE["select_recent"] = """
SELECT event_id, user_id, value FROM events
WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS
ORDER BY ts DESC, event_id LIMIT 200"""


def _nnz(text: str) -> str:
    return f"(SELECT count(DISTINCT ('0x' || substr(md5(t), 1, 8))::BIGINT % {HASH_DIM}) FROM (SELECT unnest({words(f'lower({text})')}) AS t))"


ORACLE["index_rows"] = f"""
WITH {CHUNKS_CTE}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk_id, 'hash-md5' AS provider, 'md5-token-hash' AS model,
       {HASH_DIM}::BIGINT AS dimension,
       {_nnz('content')}::BIGINT AS content_nnz,
       {_nnz('filename')}::BIGINT AS filename_nnz,
       {_nnz(COMBINED)}::BIGINT AS combined_nnz
FROM chunks"""

_GUARD_MSG = ("'stored vectors have ' || CAST(min_dim AS VARCHAR) || ' to ' || CAST(max_dim AS VARCHAR) "
              "|| ' dimensions, the embedder gives ' || CAST(e AS VARCHAR) "
              "|| ': build a new index with this embedder, or take the one that built this index'")
ORACLE["dimension_guard"] = f"""
WITH d AS (SELECT min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim FROM embeddings),
ex AS (SELECT unnest([64, 768])::BIGINT AS e)
SELECT 'embedding' AS field, min_dim, max_dim, e AS expected_dim, (min_dim = e AND max_dim = e) AS ok,
       CASE WHEN min_dim = e AND max_dim = e THEN '' ELSE {_GUARD_MSG} END AS message
FROM d, ex"""

# ----------------------------------------------------------------------------- B
ORACLE["chunk_documents"] = f"""
WITH {CHUNKS_CTE}
SELECT doc_id, filename, chunk_index::BIGINT AS chunk_index, content FROM chunks"""

ORACLE["chunk_ids"] = f"""
WITH {CHUNKS_CTE}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk_id,
       '_' || CAST(chunk_index AS VARCHAR) || '_' || substr(md5(content), 1, 8) AS legacy_chunk_id
FROM chunks"""

ORACLE["combined_text"] = f"""
WITH {CHUNKS_CTE}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, {COMBINED} AS combined_text FROM chunks"""

ORACLE["compact_text"] = f"SELECT doc_id, {compact('text')} AS compacted FROM documents"
ORACLE["truncate_head"] = f"SELECT doc_id, {trunc_head('text', '160')} AS truncated FROM documents"
ORACLE["truncate_tail"] = f"SELECT doc_id, {trunc_tail('text', '160')} AS truncated FROM documents"

ORACLE["clean_text"] = """
SELECT doc_id,
       regexp_replace(
         regexp_replace(
           regexp_replace(replace(text, chr(13), ''), '\\n{3,}', chr(10) || chr(10), 'g'),
           '[^\\S\\n]+\\n', chr(10), 'g'),
         '^\\s+|\\s+$', '', 'g') AS cleaned
FROM documents"""

_SENT = "chr(1)"
_STRIP_CLASS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _unescape(x: str) -> str:
    out = x
    for ent, ch in [("&quot;", "'\"'"), ("&apos;", "''''"), ("&#39;", "''''"), ("&lt;", "'<'"), ("&gt;", "'>'"),
                    ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&reg;", "chr(174)"),
                    ("&middot;", "chr(183)"), ("&ndash;", "chr(8211)"), ("&mdash;", "chr(8212)"),
                    ("&hellip;", "chr(8230)"), ("&amp;", "'&'")]:
        out = f"replace({out}, '{ent}', {ch})"
    return out


def html_text_sql(x: str) -> str:
    h = f"regexp_replace({x}, '(?s)<!--.*?-->', {_SENT}, 'g')"
    for tag in ("script", "style", "template"):
        h = f"regexp_replace({h}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', {_SENT}, 'g')"
    h = f"regexp_replace({h}, '(?s)<[^>]*>', {_SENT}, 'g')"
    node = f"regexp_replace({_unescape('n')}, '^{_STRIP_CLASS}+|{_STRIP_CLASS}+$', '', 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({h}, {_SENT}), lambda n: {node}), "
            f"lambda n: n <> ''), {NL})")


ORACLE["html_to_text"] = f"SELECT page_id, {html_text_sql('html')} AS text FROM pages"

ORACLE["base64_text_roundtrip"] = """
SELECT doc_id, length(rtrim(to_base64(encode(text)), '='))::BIGINT AS encoded_len, text AS decoded
FROM documents"""

ORACLE["mail_documents"] = f"""
SELECT 'mail:' || CAST(doc_id AS VARCHAR) AS filename,
       'Subject: ' || coalesce(nullif({compact('left(text, 40)')}, ''), '(no subject)') || {NL} ||
       'From: ' || coalesce(source, '') || {NL} || 'Date: ' || coalesce(lang, '') || {NL} || {NL} ||
       coalesce(text, '') AS content
FROM documents"""

# ----------------------------------------------------------------------------- C
ORACLE["hash_embed_sparse"] = f"""
WITH {hash_vec_ctes('dv', 'documents', 'doc_id', 'text')}
SELECT dv.id AS doc_id, dv.bucket::BIGINT AS bucket, round(dv.c / n.nrm, 9) AS weight
FROM dv JOIN dv_n n USING (id)"""

ORACLE["l2_normalise"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v)
SELECT vec_id, pos::BIGINT AS pos, round(x / CASE WHEN nrm = 0 THEN 1 ELSE nrm END, 6) AS value
FROM (SELECT vec_id, nrm, unnest(range(len(e))) AS pos, unnest(e) AS x FROM n)"""


def _pair_cos(a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE round(sum(x.c * y.c) / ((SELECT sqrt(sum(c*c)) FROM {a}) * (SELECT sqrt(sum(c*c)) FROM {b})), 6) END
        FROM {a} x JOIN {b} y USING (bucket))"""


ORACLE["three_vectors"] = f"""
WITH {CHUNKS_CTE},
{hash_vec_ctes('cv', 'chunks', 'chunk_id', 'content')},
{hash_vec_ctes('bv', 'chunks', 'chunk_id', COMBINED)},
{hash_vec_ctes('fv', 'chunks', 'chunk_id', 'filename')},
cb AS (SELECT x.id, round(sum(x.c * y.c) / (xn.nrm * yn.nrm), 6) AS s
       FROM cv x JOIN bv y ON x.id = y.id AND x.bucket = y.bucket JOIN cv_n xn ON xn.id = x.id JOIN bv_n yn ON yn.id = x.id
       GROUP BY x.id, xn.nrm, yn.nrm),
cf AS (SELECT x.id, round(sum(x.c * y.c) / (xn.nrm * yn.nrm), 6) AS s
       FROM cv x JOIN fv y ON x.id = y.id AND x.bucket = y.bucket JOIN cv_n xn ON xn.id = x.id JOIN fv_n yn ON yn.id = x.id
       GROUP BY x.id, xn.nrm, yn.nrm)
SELECT c.chunk_id, coalesce(cb.s, 0.0) AS content_combined_cos, coalesce(cf.s, 0.0) AS content_filename_cos
FROM chunks c LEFT JOIN cb ON cb.id = c.chunk_id LEFT JOIN cf ON cf.id = c.chunk_id"""

_VIOLATION = """CASE WHEN embedding IS NULL THEN 'null_vector' WHEN len(embedding) = 0 THEN 'empty_vector'
     WHEN len(embedding) <> 64 THEN 'wrong_dimension'
     WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'non_finite_value' END"""

ORACLE["vector_contract"] = """
SELECT CASE vec_id % 50 WHEN 1 THEN 'null_vector' WHEN 2 THEN 'wrong_dimension' WHEN 3 THEN 'non_finite_value' WHEN 4 THEN 'empty_vector'
            WHEN 5 THEN 'non_finite_value' ELSE 'ok' END AS status, count(*) AS vectors
FROM embeddings GROUP BY 1"""

ORACLE["null_vector_rows"] = """
SELECT vec_id, CASE vec_id % 50 WHEN 1 THEN 'null_vector' WHEN 2 THEN 'wrong_dimension' WHEN 4 THEN 'empty_vector'
                    ELSE 'non_finite_value' END AS reason,
       CASE vec_id % 50 WHEN 1 THEN 'null_vector' WHEN 2 THEN 'vector has 63 dimensions; set the embedding dimension to 64 or re-embed'
            WHEN 4 THEN 'empty_vector' ELSE 'non_finite_value' END AS detail
FROM embeddings WHERE vec_id % 50 BETWEEN 1 AND 5"""

# ----------------------------------------------------------------------------- D / E
_DENSE = """ev AS (SELECT vec_id, label, embedding::DOUBLE[] AS e,
                   sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm FROM embeddings)"""


def _dense_topk(corpus_filter: str = "TRUE", offset: float = 1.0, k: int = 3, exclude_self: bool = False) -> str:
    self_cond = "AND q.vec_id <> c.vec_id" if exclude_self else ""
    return f"""{_DENSE},
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             round(CASE WHEN q.nrm = 0 OR c.nrm = 0 THEN 0.0
                        ELSE list_dot_product(q.e, c.e) / (q.nrm * c.nrm) END + {offset}, 6) AS score
      FROM ev q JOIN ev c ON ({corpus_filter.replace('label', 'c.label')}) {self_cond}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


ORACLE["cosine_pairs"] = f"""
WITH {_DENSE}
SELECT a.vec_id AS a_id, b.vec_id AS b_id,
       round(CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0 ELSE list_dot_product(a.e, b.e) / (a.nrm * b.nrm) END, 6) AS cosine
FROM ev a JOIN ev b ON b.vec_id = a.vec_id + 1"""

ORACLE["vector_topk"] = f"""
WITH {_dense_topk()}
SELECT query_id, rank::BIGINT AS rank, vec_id, score FROM r WHERE rank <= 3"""

ORACLE["ann_recall"] = """
SELECT count(*) AS queries, count(*) * least(3, (SELECT count(*) FROM embeddings)) AS neighbours, true AS recall_reached
FROM embeddings WHERE vec_id % 50 = 0"""

ORACLE["filtered_vector_topk"] = f"""
WITH {_dense_topk('label = 3')}
SELECT query_id, rank::BIGINT AS rank, vec_id, score FROM r WHERE rank <= 3"""

ORACLE["label_precision_at_k"] = f"""
WITH {_dense_topk(offset=0.0, exclude_self=True)},
j AS (SELECT r.query_id, avg(CASE WHEN q.label = c.label THEN 1.0 ELSE 0.0 END) AS p
      FROM r JOIN ev q ON q.vec_id = r.query_id JOIN ev c ON c.vec_id = r.vec_id
      WHERE r.rank <= 3 GROUP BY r.query_id)
SELECT count(*)::BIGINT AS queries, round(avg(p), 4) AS precision_at_k FROM j"""


def chunk_vector_ranked(field: str, k: int, queries: str = "benchmark", qkey: str = "item_id",
                        qtext: str = "text", name: str = "r") -> str:
    """CTE text (after CHUNKS_CTE) producing ``name``(query_id, doc_key=chunk_id, score, rank)."""
    text = {"content": "content", "combined": COMBINED, "filename": "filename"}[field]
    p = f"{name}_"
    return f"""{hash_vec_ctes(p + 'cv', 'chunks', 'chunk_id', text)},
{hash_vec_ctes(p + 'qv', queries, qkey, qtext)},
{sparse_cosine_cte(p + 's', p + 'qv', p + 'cv', 1.0)},
{topk_cte(name, p + 's', k)}"""


def bm25_ranked(k: int, corpus: str = "chunks", key: str = "chunk_id", field: str = "filename",
                name: str = "b", queries: str = "benchmark", qkey: str = "item_id", qtext: str = "text") -> str:
    p = f"{name}_"
    return f"""{p}ct AS (SELECT {key} AS id, {lex_tokens(field)} AS toks FROM {corpus}),
{p}st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {p}ct),
{p}tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM {p}ct) GROUP BY ALL),
{p}dl AS (SELECT id, len(toks) AS dl FROM {p}ct),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}qt AS (SELECT DISTINCT qid, term FROM (SELECT {qkey} AS qid, unnest({lex_tokens(qtext)}) AS term FROM {queries})),
{p}s AS (
  SELECT qt.qid AS query_id, tf.id AS doc_key,
         round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5))
                   * (tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl)))), 6) AS score
  FROM {p}qt qt JOIN {p}tf tf USING (term) JOIN {p}df df USING (term) JOIN {p}dl dl ON dl.id = tf.id, {p}st st
  GROUP BY qt.qid, tf.id),
{topk_cte(name, p + 's', k)}"""


def hybrid_ranked(k: int, name: str = "h") -> str:
    return f"""{chunk_vector_ranked('content', 2 * k, name=name + 'c')},
{bm25_ranked(2 * k, name=name + 'b')},
{name}_u AS (SELECT query_id, doc_key, score * 0.7 AS ws FROM {name}c
             UNION ALL SELECT query_id, doc_key, score * 0.3 AS ws FROM {name}b),
{name}_s AS (SELECT query_id, doc_key, round(sum(ws), 9) AS score FROM {name}_u GROUP BY query_id, doc_key),
{topk_cte(name, name + '_s', k)}"""


def _emit(name: str, key: str = "chunk_id") -> str:
    return f"SELECT query_id, rank::BIGINT AS rank, doc_key AS {key}, score FROM {name}"


ORACLE["content_vector_topk"] = f"WITH {CHUNKS_CTE},\n{chunk_vector_ranked('content', 3)}\n{_emit('r')}"
ORACLE["combined_vector_topk"] = f"WITH {CHUNKS_CTE},\n{chunk_vector_ranked('combined', 3)}\n{_emit('r')}"
ORACLE["filename_vector_topk"] = f"WITH {CHUNKS_CTE},\n{chunk_vector_ranked('filename', 3)}\n{_emit('r')}"
ORACLE["bm25_filename"] = f"WITH {CHUNKS_CTE},\n{bm25_ranked(3)}\n{_emit('b')}"
ORACLE["bm25_url"] = f"WITH {bm25_ranked(3, corpus='pages', key='page_id', field='url')}\n{_emit('b', 'page_id')}"
ORACLE["hybrid_search"] = f"WITH {CHUNKS_CTE},\n{hybrid_ranked(3)}\n{_emit('h')}"

ORACLE["strategy_compare"] = f"""
WITH {CHUNKS_CTE},
{chunk_vector_ranked('content', 5, name='sc')},
{chunk_vector_ranked('filename', 5, name='sf')},
{bm25_ranked(5, name='st')},
{chunk_vector_ranked('combined', 5, name='sb')},
{hybrid_ranked(5, name='sh')}
SELECT 'content_only' AS strategy, query_id, rank::BIGINT AS rank, doc_key AS chunk_id, score FROM sc
UNION ALL SELECT 'filename_only', query_id, rank::BIGINT, doc_key, score FROM sf
UNION ALL SELECT 'filename_text', query_id, rank::BIGINT, doc_key, score FROM st
UNION ALL SELECT 'combined', query_id, rank::BIGINT, doc_key, score FROM sb
UNION ALL SELECT 'hybrid', query_id, rank::BIGINT, doc_key, score FROM sh"""

ORACLE["document_chunks"] = f"""
WITH {CHUNKS_CTE},
target AS (SELECT {FILENAME} AS filename FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1)
SELECT filename, chunk_index::BIGINT AS chunk_index, chunk_id, content
FROM chunks WHERE filename = (SELECT filename FROM target) ORDER BY chunk_index LIMIT 1000"""

# ----------------------------------------------------------------------------- evaluation
ORACLE["eval_topk"] = f"""
WITH {hash_vec_ctes('qv', 'benchmark', 'item_id', 'text')},
{hash_vec_ctes('dv', 'documents', 'doc_id', 'text')},
{sparse_cosine_cte('s', 'qv', 'dv')},
{topk_cte('r', 's', 3)}
SELECT query_id, rank::BIGINT AS rank, doc_key AS doc_id, score FROM r"""

ORACLE["recall_at_k"] = f"""
WITH {TRUTH_CTE},
items AS (SELECT * FROM benchmark WHERE item_id IN (SELECT item_id FROM truth)),
{hash_vec_ctes('qv', 'items', 'item_id', 'text')},
{hash_vec_ctes('dv', 'documents', 'doc_id', 'text')},
{sparse_cosine_cte('s', 'qv', 'dv')},
{topk_cte('r', 's', 3)},
hits AS (SELECT DISTINCT r.query_id FROM r JOIN truth t ON t.item_id = r.query_id AND t.doc_id = r.doc_key)
SELECT (SELECT count(*) FROM items)::BIGINT AS queries,
       (SELECT count(*) FROM hits)::BIGINT AS hits,
       CASE WHEN (SELECT count(*) FROM items) = 0 THEN 0.0
            ELSE round((SELECT count(*) FROM hits) / (SELECT count(*) FROM items), 4) END AS recall_at_k"""

# ----------------------------------------------------------------------------- F
ORACLE["index_stats"] = f"""
WITH {CHUNKS_CTE}
SELECT count(*)::BIGINT AS document_count, count(DISTINCT filename)::BIGINT AS files,
       sum(strlen(content))::BIGINT AS content_bytes FROM chunks"""

ORACLE["latency_percentiles"] = """
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
g AS (SELECT event_type, n,
             max(CASE WHEN rn = floor((n - 1) / 2) + 1 THEN value END) AS lo,
             max(CASE WHEN rn = ceil((n - 1) / 2) + 1 THEN value END) AS hi,
             max(CASE WHEN rn = least(greatest(ceil(0.95 * n), 1), n) THEN value END) AS p95
      FROM o GROUP BY event_type, n),
m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type)
SELECT g.event_type, n::BIGINT AS n, round(m.mean, 3) AS mean, round((lo + hi) / 2, 3) AS p50, round(p95, 3) AS p95
FROM g JOIN m USING (event_type)"""

ORACLE["corpus_stats"] = """
SELECT count(*)::BIGINT AS documents, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM documents"""

ORACLE["ingest_status"] = f"""
WITH c AS (SELECT {FILENAME} AS filename, len({words('text')}) AS n FROM documents),
k AS (SELECT filename, CASE WHEN n = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(n - {SIZE}, 0) / {STEP}.0) AS BIGINT) END AS chunks FROM c)
SELECT filename, chunks::BIGINT AS chunks, 'Indexed ' || CAST(chunks AS VARCHAR) || ' chunks from ' || filename AS status
FROM k"""

ORACLE["ingest_summary"] = "SELECT event_type AS status, count(*)::BIGINT AS events FROM events GROUP BY ALL"

ORACLE["duplicate_chunks"] = f"""
WITH {CHUNKS_CTE}
SELECT md5(content) AS content_md5, count(*)::BIGINT AS copies, count(DISTINCT filename)::BIGINT AS files
FROM chunks GROUP BY md5(content) HAVING count(*) > 1"""

# ----------------------------------------------------------------------------- G
PAIRS_CTE = f"""pairs_all AS (
  SELECT u.conv_id, u.turn, {compact('u.text')} AS usr, coalesce({compact('a.text')}, '') AS asst
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def history_query_cte(limit: int, name: str = "rq") -> str:
    line = (f"concat_ws({NL}, CASE WHEN p.usr <> '' THEN 'User: ' || p.usr END, "
            f"CASE WHEN p.asst <> '' THEN 'Assistant: ' || p.asst END)")
    return f"""{PAIRS_CTE},
{name}_m AS (SELECT conv_id, turn, text AS message, {compact('text')} AS cur FROM conversations WHERE role = 'user'),
{name}_h AS (
  SELECT m.conv_id, m.turn, string_agg(nullif({line}, ''), {NL} ORDER BY p.turn) AS hist
  FROM {name}_m m JOIN pairs_all p
    ON p.conv_id = m.conv_id AND p.turn < m.turn AND NOT (p.usr = m.cur AND p.asst = '')
  GROUP BY m.conv_id, m.turn),
{name}_t AS (SELECT m.*, {trunc_tail('h.hist', str(limit))} AS htext
             FROM {name}_m m LEFT JOIN {name}_h h USING (conv_id, turn)),
{name} AS (
  SELECT conv_id, turn, message,
         CASE WHEN htext = '' THEN cur
              ELSE 'Recent conversation:' || {NL} || htext || {NL} || 'Current question:' || {NL} || cur END AS query
  FROM {name}_t)"""


ORACLE["turn_pairs"] = f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn, usr AS "user", asst AS assistant FROM pairs_all WHERE usr <> '' OR asst <> ''"""

ORACLE["retrieval_queries"] = f"WITH {history_query_cte(2000)}\nSELECT conv_id, turn, query FROM rq"

_MSGS = ("msgs AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, text AS message "
         "FROM conversations WHERE role = 'user')")
ANSWER_HITS = f"""{CHUNKS_CTE},
{_MSGS},
{chunk_vector_ranked('combined', 3, queries='msgs', qkey='qid', qtext='message', name='ar')},
hits AS (SELECT ar.query_id, ar.rank, ar.score, c.filename, c.content
         FROM ar JOIN chunks c ON c.chunk_id = ar.doc_key)"""


def section_sql(filename: str, content: str) -> str:
    return f"'From ' || {filename} || ':' || {NL} || {content}"


def packed_sql(hits: str, chunk: int, budget: int, name: str) -> str:
    return f"""{name}_sec AS (SELECT query_id, rank, {section_sql('filename', trunc_head('content', str(chunk)))} AS s FROM {hits}),
{name}_run AS (SELECT *, CAST({budget} - coalesce(sum(length(s) + 2) OVER (PARTITION BY query_id ORDER BY rank
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rem FROM {name}_sec),
{name}_kept AS (SELECT query_id, rank, CASE WHEN length(s) <= rem THEN s ELSE {trunc_head('s', 'rem')} END AS o
                FROM {name}_run WHERE rem > 0),
{name} AS (SELECT q.query_id, coalesce(string_agg(k.o, {NL} || {NL} ORDER BY k.rank) FILTER (WHERE k.o <> ''), '') AS context
           FROM (SELECT DISTINCT query_id FROM {hits}) q LEFT JOIN {name}_kept k USING (query_id)
           GROUP BY q.query_id)"""


def plain_sql(hits: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, string_agg({section_sql('filename', 'content')}, {NL} || {NL} ORDER BY rank) AS context
            FROM {hits} GROUP BY query_id)"""


ORACLE["context_plain"] = f"WITH {ANSWER_HITS},\n{plain_sql('hits', 'cp')}\nSELECT query_id, context FROM cp"
ORACLE["pack_context"] = f"WITH {ANSWER_HITS},\n{packed_sql('hits', 160, 400, 'pc')}\nSELECT query_id, context FROM pc"


def _score_text(x: str) -> str:
    micro = f"CAST(round({x} * 1000000) AS BIGINT)"
    milli = f"((abs({micro}) + 500) // 1000)"
    return (f"(CASE WHEN {micro} < 0 THEN '-' ELSE '' END || CAST({milli} // 1000 AS VARCHAR) || '.' || "
            f"lpad(CAST({milli} % 1000 AS VARCHAR), 3, '0'))")


ORACLE["sources_block"] = f"""
WITH {ANSWER_HITS}
SELECT query_id, {NL} || {NL} || 'Sources:' || {NL} ||
       string_agg('- ' || filename || ' (score: ' || {_score_text('score')} || ')', {NL} ORDER BY rank) AS sources
FROM hits GROUP BY query_id"""

_PROMPT = ("'Answer the question using only the context taken from the user''s documents.' || {nl} || {nl} || "
           "'Context:' || {nl} || cp.context || {nl} || {nl} || 'Question: ' || m.message || {nl} || {nl} || 'Answer:'")
ORACLE["build_prompts"] = f"""
WITH {ANSWER_HITS},
{plain_sql('hits', 'cp')}
SELECT m.qid AS query_id,
       CASE WHEN cp.context IS NOT NULL THEN {_PROMPT.format(nl=NL)}
            ELSE 'Question: ' || m.message || {NL} || {NL} || 'Answer:' END AS prompt
FROM msgs m LEFT JOIN cp ON cp.query_id = m.qid"""


ORACLE["answer_compressed"] = f"""
WITH {CHUNKS_CTE},
{history_query_cte(800)},
msgs AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, message, query FROM rq),
{chunk_vector_ranked('combined', 3, queries='msgs', qkey='qid', qtext='query', name='ar')},
hits AS (SELECT ar.query_id, ar.rank, ar.score, c.filename, c.content FROM ar JOIN chunks c ON c.chunk_id = ar.doc_key),
{packed_sql('hits', 160, 400, 'cp')},
src AS (SELECT query_id, {NL} || {NL} || 'Sources:' || {NL} ||
               string_agg('- ' || filename || ' (score: ' || {_score_text('score')} || ')', {NL} ORDER BY rank) AS sources
        FROM hits GROUP BY query_id)
SELECT m.qid AS query_id, m.query, CASE WHEN cp.context IS NOT NULL THEN {_PROMPT.format(nl=NL)}
            ELSE 'Question: ' || m.message || {NL} || {NL} || 'Answer:' END AS prompt, coalesce(src.sources, '') AS sources
FROM msgs m LEFT JOIN cp ON cp.query_id = m.qid LEFT JOIN src ON src.query_id = m.qid"""


def eval_variant_sql(queries: str, variant: str, packed: bool, truth: bool) -> str:
    """``queries``: CTE with (qid, message, query). Doc-level hash top-3 + contexts + sums."""
    p = variant[:2]
    after = packed_sql(f"{p}_hits", 160, 400, f"{p}_ca") if packed else plain_sql(f"{p}_hits", f"{p}_ca")
    rec = ""
    rec_col = ""
    if truth:
        rec = f""",
{p}_hit AS (SELECT DISTINCT h.query_id FROM {p}_hits h JOIN truth t ON t.item_id = h.query_id AND t.doc_id = h.doc_id)"""
        rec_col = (f"CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(hh.query_id) / count(*), 4) END AS recall_at_k, ")
    hit_join = f"LEFT JOIN {p}_hit hh ON hh.query_id = q.qid" if truth else ""
    return f"""{hash_vec_ctes(p + '_qv', queries, 'qid', 'query')},
{p}_s AS (
  SELECT q.id AS query_id, d.id AS doc_key, round(sum(q.c * d.c) / (qn.nrm * dn.nrm), 6) AS score
  FROM {p}_qv q JOIN dv d USING (bucket) JOIN {p}_qv_n qn ON qn.id = q.id JOIN dv_n dn ON dn.id = d.id
  GROUP BY q.id, d.id, qn.nrm, dn.nrm),
{topk_cte(p + '_r', p + '_s', 3)},
{p}_hits AS (SELECT r.query_id, r.rank, r.doc_key AS doc_id, d.filename, d.content
             FROM {p}_r r JOIN docs d ON d.doc_id = r.doc_key),
{plain_sql(p + '_hits', p + '_cb')},
{after}{rec},
{p}_out AS (
  SELECT '{variant}' AS variant, count(*)::BIGINT AS queries, {rec_col}
         coalesce(sum(length(q.message)), 0)::BIGINT AS query_chars_before,
         coalesce(sum(length(q.query)), 0)::BIGINT AS query_chars_after,
         coalesce(sum(length(cb.context)), 0)::BIGINT AS context_chars_before,
         coalesce(sum(length(ca.context)), 0)::BIGINT AS context_chars_after
  FROM {queries} q LEFT JOIN {p}_cb cb ON cb.query_id = q.qid LEFT JOIN {p}_ca ca ON ca.query_id = q.qid
  {hit_join})"""


def _ratio(p: str) -> str:
    return (f"SELECT *, CASE WHEN context_chars_before = 0 THEN 0.0 "
            f"ELSE round(1 - context_chars_after / context_chars_before, 4) END AS context_reduction_ratio FROM {p}_out")


ORACLE["context_reduction"] = f"""
WITH {DOCS_CTE},
{hash_vec_ctes('dv', 'docs', 'doc_id', 'content')},
{history_query_cte(800)},
cq AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, message, query FROM rq),
{eval_variant_sql('cq', 'compressed', True, False)}
{_ratio('co')}"""

ORACLE["eval_report"] = f"""
WITH {DOCS_CTE},
{TRUTH_CTE},
{hash_vec_ctes('dv', 'docs', 'doc_id', 'content')},
bq AS (SELECT item_id AS qid, text AS message, text AS query FROM benchmark WHERE item_id IN (SELECT item_id FROM truth)),
kq AS (SELECT item_id AS qid, text AS message, {compact('text')} AS query FROM benchmark
       WHERE item_id IN (SELECT item_id FROM truth)),
{eval_variant_sql('bq', 'baseline', False, True)},
{eval_variant_sql('kq', 'compressed', True, True)}
{_ratio('ba')}
UNION ALL
{_ratio('co')}"""

ORACLE["recent_ingest_log"] = """
SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000"""

# ----------------------------------------------------------------------------- J
ORACLE["after_delete"] = f"""
WITH {CHUNKS_CTE}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk_id FROM chunks
WHERE filename NOT IN (SELECT {FILENAME} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""

ORACLE["replace_documents"] = f"""
WITH cw1 AS (SELECT doc_id, 1 AS version, {FILENAME} AS filename, {words('text')} AS w FROM documents),
cw2 AS (SELECT doc_id, 2 AS version, {FILENAME} AS filename, {words('lower(text)')} AS w FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cw AS (SELECT * FROM cw1 UNION ALL SELECT * FROM cw2),
cn AS (SELECT *, CASE WHEN len(w) = 0 THEN 0
                      ELSE 1 + CAST(ceil(greatest(len(w) - {SIZE}, 0) / {STEP}.0) AS BIGINT) END AS n_chunks FROM cw),
ch AS (SELECT doc_id, version, filename, i AS chunk_index,
              array_to_string(w[i * {STEP} + 1 : i * {STEP} + {SIZE}], ' ') AS content
       FROM (SELECT doc_id, version, filename, w, unnest(range(n_chunks)) AS i FROM cn)),
latest AS (SELECT filename, max(version) AS version FROM ch GROUP BY filename)
SELECT doc_id, version::BIGINT AS version, chunk_index::BIGINT AS chunk_index,
       filename || '_' || CAST(chunk_index AS VARCHAR) || '_' || substr(md5(content), 1, 8) AS chunk_id
FROM ch JOIN latest USING (filename, version)"""

# ----------------------------------------------------------------------------- K
def oracle_sql() -> dict[str, str]:
    from corpusflow.plans import mail_queries, table_queries  # noqa: F401  (they add theirs)

    return dict(ORACLE)
