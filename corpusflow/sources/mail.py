"""Mail messages as a source: JSON message → normalised mail row → document.

Messages have the shape of a mail API's ``full`` format: ``id``, ``threadId``,
``labelIds``, ``snippet`` and a ``payload`` with ``mimeType``, ``filename``,
``headers`` [{name, value}], ``body`` {data (url-safe base64), attachmentId} and
recursive ``parts``. One Arrow UDF walks the parts of a message without recursion and gives those that
count as a flat list, in order, so neither the schema nor the plan depends on how deep a message is nested;
everything behind it (decoding, HTML, cleaning) is Column expressions, but for entities. Rows that are no JSON object
(or nested too deeply to be read as JSON) go to ``bad_messages``.

Rules (first match wins for every part, depth first, in order):
  filename and attachmentId → attachment; text/plain with data → text;
  text/html with data → visible text; multipart/* with parts → its parts.
Non-empty texts are joined by newlines, then cleaned. Header names are
case-insensitive and the last duplicate wins.
"""

from __future__ import annotations

import html
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from corpusflow.functions import text as tx
from corpusflow.session import bounded_batches

# Defaults of a normalised message.
NO_SUBJECT = "(no subject)"
DOCUMENT_PREFIX = "mail:"

#: A message without its tree: ``found`` holds the parts that count, in order.
_ARROW = pa.struct([
    ("id", pa.string()), ("threadId", pa.string()), ("labelIds", pa.list_(pa.string())), ("snippet", pa.string()),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ("found", pa.list_(pa.struct([("kind", pa.string()), ("filename", pa.string()), ("attachment_id", pa.string()), ("data", pa.string())]))),
    ("bad", pa.string())])
MESSAGE = from_arrow_type(_ARROW)


def _said(value) -> str | None:
    """A JSON value as text."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _field(value, name: str):
    return value.get(name) if isinstance(value, dict) else None


def _found_parts(payload) -> list[dict]:
    """The parts of a payload that count, depth first."""
    mime = _said(_field(payload, "mimeType")) or ""
    parts = _field(payload, "parts")
    if not (mime.startswith("multipart/") and isinstance(parts, list) and parts):
        data = _said(_field(_field(payload, "body"), "data"))
        return [{"kind": "html" if mime == "text/html" else "plain", "data": data}] if data else []
    found, waiting = [], parts[::-1]
    while waiting:
        part = waiting.pop()
        mime, filename = (_said(_field(part, n)) or "" for n in ("mimeType", "filename"))
        data, attachment = (_said(_field(_field(part, "body"), n)) for n in ("data", "attachmentId"))
        if filename and attachment:
            found.append({"kind": "attachment", "filename": filename, "attachment_id": attachment, "data": data})
        elif mime in ("text/plain", "text/html") and data:
            found.append({"kind": mime[5:], "data": data})
        elif mime.startswith("multipart/") and isinstance(_field(part, "parts"), list):
            waiting += part["parts"][::-1]
    return found


def _message(value: str | None) -> dict:
    try:
        m = json.loads(value)
    except RecursionError:
        return {"bad": "nested_too_deeply"}
    except (TypeError, ValueError):
        m = None
    if not isinstance(m, dict):
        return {"bad": "not_a_json_object"}
    payload, labels = m.get("payload"), m.get("labelIds")
    headers = _field(payload, "headers")
    return {"id": _said(m.get("id")), "threadId": _said(m.get("threadId")), "snippet": _said(m.get("snippet")),
            "labelIds": [_said(x) for x in labels] if isinstance(labels, list) else None,
            "headers": [{"name": _said(_field(h, "name")), "value": _said(_field(h, "value"))} for h in headers] if isinstance(headers, list) else None,
            "found": _found_parts(payload)}


@F.arrow_udf(MESSAGE)
def read_message(values: pa.Array) -> pa.Array:
    """Each JSON message with its parts as a flat list; ``bad`` says why a row is none."""
    return pa.array([_message(v.as_py()) for v in values], _ARROW)


#: To Spark it is not repeatable, so a filter on its result is not given a second reading of every message.
read_message = read_message.asNondeterministic()


def b64url_text(data: Column) -> Column:
    """url-safe base64 (padding optional) → UTF-8 text, invalid bytes dropped."""
    raw = F.unbase64(F.translate(data, "-_", "+/")).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.translate(F.make_valid_utf8(raw), "\ufffd", ""))


def b64url_bytes(data: Column) -> Column:
    return F.unbase64(F.translate(data, "-_", "+/"))


@F.arrow_udf(T.StringType())
def found_text(found: pa.Array) -> pa.Array:
    """Texts and decoded HTML of a message, the non-empty ones joined by line feeds."""
    def said(part) -> str:
        nodes = [n for n in part["nodes"] or [] if n is not None]
        if not part["html"]:
            return "".join(nodes)
        return "\n".join(filter(None, (html.unescape(n).strip() for n in nodes)))

    return pa.array(["\n".join(filter(None, map(said, parts or []))) for parts in found.to_pylist()], pa.string())


def message_text(found: Column) -> Column:
    texts = F.transform(F.filter(found, lambda p: p["kind"] != "attachment"), lambda p: F.struct(
        (p["kind"] == "html").alias("html"),
        F.when(p["kind"] == "html", tx.html_nodes(b64url_text(p["data"]))).otherwise(F.array(b64url_text(p["data"]))).alias("nodes")))
    return tx.clean_text(found_text(texts))


def message_attachments(found: Column) -> Column:
    return F.transform(F.filter(found, lambda p: p["kind"] == "attachment"), lambda p: F.struct(
        p["filename"].alias("filename"), p["attachment_id"].alias("attachment_id"), b64url_bytes(p["data"]).alias("data")))


def header(headers: Column, name: str) -> Column:
    """Case-insensitive header lookup; the last duplicate wins; NULL when absent."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == F.lit(name.lower()))
    return F.try_element_at(hits, F.lit(-1))["value"]


def normalise(messages: DataFrame, message_col: str = "message") -> DataFrame:
    """Parsed messages → (id, thread_id, sender, recipient, subject, date, labels,
    snippet, text, attachments)."""
    m = F.col(message_col)
    headers = F.coalesce(m["headers"], F.array().cast("array<struct<name: string, value: string>>"))
    return messages.select(
        m["id"].alias("id"),
        m["threadId"].alias("thread_id"),
        header(headers, "from").alias("sender"),
        header(headers, "to").alias("recipient"),
        tx.first_non_empty(header(headers, "subject"), NO_SUBJECT).alias("subject"),
        header(headers, "date").alias("date"),
        F.coalesce(m["labelIds"], F.array().cast("array<string>")).alias("labels"),
        F.coalesce(m["snippet"], F.lit("")).alias("snippet"),
        message_text(m["found"]).alias("text"),
        message_attachments(m["found"]).alias("attachments"),
    )


def parse_messages(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON text (one message per row, e.g. ``spark.read.text``) → parsed ``message``, of the rows that are JSON objects."""
    bounded_batches(raw.sparkSession)
    return raw.select(read_message(F.col(json_col)).alias("message")).where(F.col("message.bad").isNull())


def bad_messages(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """The rows that are no message, for quarantine."""
    bounded_batches(raw.sparkSession)
    read = raw.select(F.col(json_col).alias("detail"), read_message(F.col(json_col))["bad"].alias("reason"))
    return read.where(F.col("reason").isNotNull()).select(F.lit("mail").alias("source"), "detail", "reason")


def read_messages(spark, path: str) -> DataFrame:
    """JSON-lines files of messages → normalised mail rows."""
    return normalise(parse_messages(spark.read.text(path)))


def sent_at(date: Column) -> Column:
    """Time of a date header (day, month, year, time, zone; a weekday before it is ignored); null if it is none."""
    plain = F.regexp_replace(F.trim(date), "^[A-Za-z]{3}, *", "")
    return F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))


def select_messages(mail: DataFrame, limit: int, sender: str | None = None, label: str | None = None,
                    newer_than: Column | None = None) -> DataFrame:
    """The newest ``limit`` messages that pass all given filters: sender (contained, whatever its case), label, and time
    after ``newer_than``. Messages without a readable date come last; equal dates by id."""
    kept = mail.withColumn("sent_at", sent_at(F.col("date")))
    if sender is not None:
        kept = kept.where(F.contains(F.lower("sender"), F.lit(sender.lower())))
    if label is not None:
        kept = kept.where(F.array_contains("labels", label))
    if newer_than is not None:
        kept = kept.where(F.col("sent_at") > newer_than)
    return kept.orderBy(F.col("sent_at").desc_nulls_last(), "id").limit(limit)


def mail_documents(mail: DataFrame, prefix: str = DOCUMENT_PREFIX) -> DataFrame:
    """Normalised mail → (filename, content, metadata) documents for ingest.

    Recipient, labels and thread are kept in ``metadata`` (nothing is lost)."""
    subject = tx.first_non_empty(F.col("subject"), NO_SUBJECT)
    content = F.concat(F.lit("Subject: "), subject, F.lit("\nFrom: "), F.coalesce("sender", F.lit("")),
                       F.lit("\nDate: "), F.coalesce("date", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    meta = F.create_map(
        F.lit("recipient"), F.coalesce("recipient", F.lit("")),
        F.lit("labels"), F.array_join("labels", ","),
        F.lit("thread_id"), F.coalesce("thread_id", F.lit("")),
    )
    return mail.select(F.concat(F.lit(prefix), F.col("id")).alias("filename"), content.alias("content"),
                       meta.alias("metadata"))
