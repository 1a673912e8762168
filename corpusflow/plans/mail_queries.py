"""Queries of the mail source over the test tables: documents are bound to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.plans.oracle import ORACLE, compact as sql_compact
from corpusflow.plans.queries import register
from corpusflow.sources import mail
from corpusflow.sources.tables import table


def _b64(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\\r\\n=]", ""), "+/", "-_")


def _escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _js(value: Column) -> Column:
    """A string Column as a JSON string literal (quoted, escaped); null → JSON null."""
    arr = F.to_json(F.array(value.cast("string")))
    return F.when(value.isNull(), F.lit("null")).otherwise(arr.substr(F.lit(2), F.length(arr) - 2))


def _obj(**fields: Column) -> Column:
    """JSON object text from already-encoded JSON values."""
    items = []
    for i, (k, v) in enumerate(fields.items()):
        items += [F.lit(("{" if i == 0 else ",") + f'"{k}":'), v]
    return F.concat(*items, F.lit("}"))


def _arr(*values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))


def _part(mime: str, data: Column | None = None, parts: list[Column] | None = None,
          filename: Column | None = None, att: Column | None = None, headers: Column | None = None) -> Column:
    f = {"mimeType": _js(F.lit(mime)), "filename": _js(filename if filename is not None else F.lit(""))}
    if headers is not None:
        f["headers"] = headers
    body = {"data": _js(data) if data is not None else F.lit("null")}
    if att is not None:
        body["attachmentId"] = _js(att)
    f["body"] = _obj(**body)
    if parts is not None:
        f["parts"] = _arr(*parts)
    return _obj(**f)


def _sent(doc_id: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + doc_id * 60), "EEE, dd MMM yyyy HH:mm:ss Z")


#: Rows that are cut off, nested some levels, and nested a thousand levels deep.
CUT = "doc_id % 97 = 5"
LEVELS = "CASE WHEN doc_id % 199 = 7 THEN 1000 WHEN doc_id % 10 = 3 THEN doc_id % 7 ELSE 0 END"


def documents_as_messages(docs: DataFrame) -> DataFrame:
    """Each document as one message JSON string (column ``value``); some are nested deeply, some are cut off.

    en (and others): single text/plain body; fr: multipart/alternative with the
    plain text and an HTML copy; de: single HTML body, duplicate From headers and
    no Subject; es: multipart/mixed holding an alternative part, an attachment and
    a trailing signature part.
    """
    def h(name: str, value: Column) -> Column:
        return _obj(name=_js(F.lit(name)), value=_js(value))

    text, src, lang, did = F.col("text"), F.col("source"), F.col("lang"), F.col("doc_id").cast("string")
    subject = tx.compact(F.left(text, F.lit(40)))
    std = _arr(h("From", src), h("To", F.lit("inbox@example.com")), h("Subject", subject), h("Date", _sent(F.col("doc_id"))))
    de_h = _arr(h("From", F.lit("unknown")), h("FROM", src), h("Date", _sent(F.col("doc_id"))))
    plain = _part("text/plain", _b64(text), headers=std)
    fr = _part("multipart/alternative", headers=std, parts=[
        _part("text/plain", _b64(text)),
        _part("text/html", _b64(F.concat(F.lit("<p>"), _escape_html(text), F.lit("</p>")))),
    ])
    de = _part("text/html", _b64(F.concat(F.lit("<div>"), _escape_html(text), F.lit("</div>"))), headers=de_h)
    es = _part("multipart/mixed", headers=std, parts=[
        _part("multipart/alternative", parts=[_part("text/plain", _b64(text))]),
        _part("application/pdf", filename=F.concat(F.lit("doc"), did, F.lit(".pdf")), att=F.concat(F.lit("att"), did)),
        _part("text/plain", _b64(F.concat(F.lit("-- "), src))),
    ])
    payload = F.when(lang == "fr", fr).when(lang == "de", de).when(lang == "es", es).otherwise(plain)
    # Around it, as many multipart levels as LEVELS says; the headers stay on the outermost part.
    levels = F.expr(LEVELS).cast("int")
    inner = F.concat(F.expr("repeat('" + '{"mimeType":"multipart/mixed","filename":"","body":{"data":null},"parts":[' + "', " + f"cast({LEVELS} as int) - 1)"),
                     payload, F.expr(f"repeat(']}}', cast({LEVELS} as int) - 1)"))
    outer = _part("multipart/mixed", headers=F.when(lang == "de", de_h).otherwise(std), parts=[inner])
    payload = F.when(levels > 0, outer).otherwise(payload)
    value = _obj(id=_js(did), threadId=_js(F.concat(F.lit("t"), src)),
                 labelIds=_arr(_js(F.lit("INBOX")), _js(F.upper(lang))),
                 snippet=_js(tx.compact(F.left(text, F.lit(60)))), payload=payload)
    return docs.select(F.when(F.expr(CUT), F.left(value, F.length(value) - 1)).otherwise(value).alias("value"))


def _mail_rows(spark, sf) -> DataFrame:
    return mail.normalise(mail.parse_messages(documents_as_messages(table(spark, sf, "documents"))))


@register("mail_normalise")
def mail_normalise_q(spark, sf):
    m = _mail_rows(spark, sf)
    return m.select("id", "thread_id", "sender", "recipient", "subject", "date",
                    F.size("labels").cast("bigint").alias("n_labels"), "snippet", "text",
                    F.size("attachments").cast("bigint").alias("n_attachments"))


@register("mail_parts")
def mail_parts_q(spark, sf):
    m = _mail_rows(spark, sf)
    return m.select("id", F.explode_outer("attachments").alias("a")).where(F.col("a").isNotNull()).select(
        "id", F.col("a.filename").alias("filename"), F.col("a.attachment_id").alias("attachment_id"))


@register("mail_quarantine")
def mail_quarantine_q(spark, sf):
    bad = mail.bad_messages(documents_as_messages(table(spark, sf, "documents")))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


@register("mail_selection")
def mail_selection_q(spark, sf):
    """The newest 50 messages of one sender and label after the first hour."""
    found = mail.select_messages(_mail_rows(spark, sf), 50, sender="SRC1", label="EN", newer_than=F.to_timestamp(F.lit("2024-01-01 01:00:00")))
    return found.select("id", "sender", "date", F.size("labels").cast("bigint").alias("n_labels"))


@register("mail_ingest_documents")
def mail_ingest_documents_q(spark, sf):
    return mail.mail_documents(_mail_rows(spark, sf)).select("filename", "content")


# --------------------------------------------------------------------------- oracles
def _clean_sql(x: str) -> str:
    return ("regexp_replace(regexp_replace(regexp_replace(replace(" + x + ", chr(13), ''), '\\n{3,}', "
            "chr(10) || chr(10), 'g'), '[^\\S\\n]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')")


_DATE = "strftime(make_timestamp((1704067200 + doc_id * 60) * 1000000), '%a, %d %b %Y %H:%M:%S +0000')"
_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_MAIL_TEXT = f"""CASE lang WHEN 'fr' THEN {_clean_sql("text || chr(10) || " + _STRIP)}
                 WHEN 'de' THEN {_clean_sql(_STRIP)}
                 WHEN 'es' THEN {_clean_sql("text || chr(10) || '-- ' || source")}
                 ELSE {_clean_sql('text')} END"""
_SUBJECT = f"CASE WHEN lang = 'de' THEN '(no subject)' ELSE coalesce(nullif({sql_compact('left(text, 40)')}, ''), '(no subject)') END"

ORACLE["mail_normalise"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 't' || source AS thread_id, source AS sender,
       CASE WHEN lang = 'de' THEN NULL ELSE 'inbox@example.com' END AS recipient,
       {_SUBJECT} AS subject, {_DATE} AS date, 2::BIGINT AS n_labels, {sql_compact('left(text, 60)')} AS snippet,
       {_MAIL_TEXT} AS text, CASE WHEN lang = 'es' THEN 1 ELSE 0 END::BIGINT AS n_attachments
FROM documents WHERE NOT ({CUT})"""

ORACLE["mail_parts"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 'doc' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename,
       'att' || CAST(doc_id AS VARCHAR) AS attachment_id
FROM documents WHERE lang = 'es' AND NOT ({CUT})"""

ORACLE["mail_ingest_documents"] = f"""
SELECT 'mail:' || CAST(doc_id AS VARCHAR) AS filename,
       'Subject: ' || {_SUBJECT} || chr(10) || 'From: ' || source || chr(10) || 'Date: ' || {_DATE} || chr(10) || chr(10)
       || {_MAIL_TEXT} AS content
FROM documents WHERE NOT ({CUT})"""

ORACLE["mail_quarantine"] = f"""
SELECT 'not_a_json_object' AS reason, count(*) AS messages FROM documents WHERE {CUT} HAVING count(*) > 0"""

ORACLE["mail_selection"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, source AS sender, {_DATE} AS date, 2::BIGINT AS n_labels
FROM documents WHERE NOT ({CUT}) AND contains(source, 'src1') AND lang = 'en' AND doc_id > 60
ORDER BY doc_id DESC LIMIT 50"""
