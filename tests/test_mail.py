import base64
import json

from corpusflow.sources import mail


def b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _rows(spark, messages):
    raw = spark.createDataFrame([(json.dumps(m),) for m in messages], "value string")
    return {r["id"]: r for r in mail.normalise(mail.parse_messages(raw)).collect()}


def test_mail_walk_and_headers(spark):
    messages = [
        {"id": "m1", "threadId": "t1", "labelIds": ["INBOX"], "snippet": "hi",
         "payload": {"mimeType": "multipart/mixed",
                     "headers": [{"name": "From", "value": "a@x"}, {"name": "FROM", "value": "b@x"},
                                 {"name": "Subject", "value": "Hello"}, {"name": "Date", "value": "Mon"}],
                     "parts": [
                         {"mimeType": "multipart/alternative", "parts": [
                             {"mimeType": "text/plain", "body": {"data": b64("plain body ~~?".encode())}},
                             {"mimeType": "text/html", "body": {"data": b64(b"<p>html &amp; body</p>")}}]},
                         {"mimeType": "application/pdf", "filename": "f.pdf", "body": {"attachmentId": "A1"}},
                         {"mimeType": "text/plain", "filename": "", "body": {"data": b64(b"trailer  \r\n\r\n\r\n\r\nend")}},
                         {"mimeType": "text/plain", "body": {}},
                         {"mimeType": "multipart/related", "parts": []}]}},
        {"id": "m2", "payload": {"mimeType": "text/html", "headers": [{"name": "subject", "value": ""}],
                                 "body": {"data": b64(b"<div>only <b>html</b></div>")}}},
        {"id": "m3", "payload": {"mimeType": "text/plain", "headers": [],
                                 "body": {"data": b64(b"bad \xff\xfe bytes")}}},
        {"id": "m4", "payload": {"mimeType": "multipart/mixed", "parts": [],
                                 "body": {"data": b64(b"fallback body")}}},
    ]
    rows = _rows(spark, messages)
    m1 = rows["m1"]
    assert m1["sender"] == "b@x" and m1["subject"] == "Hello" and m1["date"] == "Mon"
    assert m1["text"] == "plain body ~~?\nhtml & body\ntrailer\n\nend"
    assert [(a["filename"], a["attachment_id"]) for a in m1["attachments"]] == [("f.pdf", "A1")]
    assert rows["m2"]["subject"] == "(no subject)" and rows["m2"]["text"] == "only\nhtml"
    assert rows["m2"]["labels"] == [] and rows["m2"]["snippet"] == ""
    assert rows["m3"]["text"] == "bad  bytes"
    assert rows["m4"]["text"] == "fallback body"


def test_mail_documents_layout(spark):
    raw = spark.createDataFrame([(json.dumps({"id": "9", "payload": {
        "mimeType": "text/plain", "headers": [{"name": "From", "value": "me"}, {"name": "Date", "value": "today"}],
        "body": {"data": b64(b"body text")}}}),)], "value string")
    doc = mail.mail_documents(mail.normalise(mail.parse_messages(raw))).first()
    assert doc["filename"] == "mail:9"
    assert doc["content"] == "Subject: (no subject)\nFrom: me\nDate: today\n\nbody text"


def test_parts_of_any_depth_and_all_entities(spark):
    part = {"mimeType": "text/html", "body": {"data": b64("<p>caf&eacute; &#8217;x&rsquo; &euro;5 &#x41; &amp;lt;</p>".encode())}}
    for _ in range(9):
        part = {"mimeType": "multipart/mixed", "parts": [part, {"mimeType": "x/y", "filename": "f", "body": {"attachmentId": "a"}}]}
    rows = _rows(spark, [{"id": "deep", "payload": part},
                         {"id": "flat", "payload": {"mimeType": "text/plain", "body": {"data": b64(b"1 &amp; 2")}}}])
    assert rows["deep"]["text"] == "café ’x’ €5 A &lt;"
    assert len(rows["deep"]["attachments"]) == 9
    assert rows["flat"]["text"] == "1 &amp; 2" and rows["flat"]["attachments"] == []


def test_bad_json_is_quarantined(spark):
    raw = spark.createDataFrame([("not json",), ("[1]",), (None,), (json.dumps({"id": "ok"}),)], "value string")
    assert [r["id"] for r in mail.normalise(mail.parse_messages(raw)).collect()] == ["ok"]
    assert sorted(str(r["detail"]) for r in mail.bad_messages(raw).collect()) == ["None", "[1]", "not json"]


def test_depth_of_a_message_does_not_reach_the_plan(spark):
    """A message of a thousand levels beside a flat one: the same plan, both read; deeper than JSON can be is quarantined."""
    def nested(levels):
        part = {"mimeType": "text/plain", "body": {"data": b64(b"deep down")}}
        opened = '{"mimeType": "multipart/mixed", "parts": ['
        return '{"id": "d%d", "payload": ' % levels + opened * levels + json.dumps(part) + "]}" * levels + "}"

    raw = spark.createDataFrame([(nested(1000),), (nested(1),), (nested(200_000),), (json.dumps({"id": "flat", "payload": {
        "mimeType": "text/plain", "body": {"data": b64(b"on top")}}}),)], "value string")
    found = mail.normalise(mail.parse_messages(raw))
    assert {r["id"]: r["text"] for r in found.collect()} == {"d1000": "deep down", "d1": "deep down", "flat": "on top"}
    assert [r["reason"] for r in mail.bad_messages(raw).collect()] == ["nested_too_deeply"]
    flat = mail.normalise(mail.parse_messages(raw.where("length(value) < 300")))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(found) - size(flat)) < 200


def test_selection(spark):
    def message(i, sender, label, date):
        return {"id": i, "labelIds": [label], "payload": {"mimeType": "text/plain", "headers": [
            {"name": "From", "value": sender}, {"name": "Date", "value": date}], "body": {"data": b64(b"x")}}}

    raw = spark.createDataFrame([(json.dumps(m),) for m in [
        message("a", "Ann <ann@x>", "INBOX", "Mon, 1 Jan 2024 10:00:00 +0000"), message("b", "ann@x", "INBOX", "Mon, 01 Jan 2024 12:00:00 +0200"),
        message("c", "bob@x", "INBOX", "2 Jan 2024 00:00:00 +0000"), message("d", "ann@x", "SPAM", "3 Jan 2024 00:00:00 +0000"),
        message("e", "ANN@x", "INBOX", "no date")]], "value string")
    rows = mail.normalise(mail.parse_messages(raw))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(mail.select_messages(rows, 10)) == ["d", "c", "a", "b", "e"]
    assert ids(mail.select_messages(rows, 2, sender="ann@", label="INBOX")) == ["a", "b"]
    from pyspark.sql import functions as F

    assert ids(mail.select_messages(rows, 10, newer_than=F.to_timestamp(F.lit("2024-01-01 10:00:00")))) == ["d", "c"]


def test_messages_are_read_once_in_bounded_batches(spark):
    """A filter on what was read is no second reading, and a task gets 8 MB of messages at a time."""
    from corpusflow.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        raw = spark.createDataFrame([('{"id": "a", "payload": {"mimeType": "text/plain", "body": {"data": "aGk"}}}',), ("[1]",)], "value string")
        read = mail.normalise(mail.parse_messages(raw))
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [read_message(") == 1
        assert int(spark.conf.get(key).rstrip("b")) == BATCH_BYTES
        assert [(r["id"], r["text"]) for r in read.collect()] == [("a", "hi")]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
