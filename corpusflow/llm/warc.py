"""WARC archives: write pages as records, read them back, reassemble segments.

Writing. Each page is a ``response`` record whose HTTP block carries the payload in
chunked framing. Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, that
with the largest id keeps its payload; the others become ``revisit`` records that name it. A
block longer than a segment is split into a first record and ``continuation`` records
(origin identifier, segment number; the last one has the total length). The files
are plain WARC 1.1: Spark's text writer puts the record separator behind each record,
through its commit protocol and to any file system.

Reading. Each task walks the records of its files by their content lengths. Whole
records are decoded on the spot; segments are grouped by origin identifier, ordered by segment
number, checked against the total length, joined and then decoded. Only segments are shuffled.

Defined results: a null payload is an empty one; a null id stays null and cannot be the
record that others revisit; a null url is written as ``about:blank``, and line ends and tabs in it as %XX;
repeated rows get a record each (those with the largest id are all responses); an empty
table gives an archive without records. A record whose segments are incomplete, whose framing is
broken or whose digest differs has the reason in ``error`` and a null payload where none could be decoded. Digests may be
in base 32 or hexadecimal; one in neither is an error of its record. Where a file holds no record at its place (it is cut off, or
a header is broken) there is a row with the reason, and reading goes on at the next record. Files may be packed with gzip,
a member a record or several; a member that cannot be unpacked gives a row with the reason, and reading goes on at the next one. A
file is read as one value, so one of over 2 GB as stored, which this writer never makes, cannot be read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import text_of, written

REVISIT_BYTES = 1000
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
#: A reading task holds one file at a time: at most this many records of a segment's length each.
RECORDS_PER_FILE = 10_000
#: A gzip member is unpacked from pieces of this many bytes.
UNPACK_BYTES = 64 << 10
#: Broadcast the groups of equal payloads up to this many (a digest, an id and a url each).
MAX_BROADCAST_GROUPS = 200_000

# Fixed values of the format.
_SEPARATOR = "\r\n\r\n"
_GZIP = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

_FIELDS = ("record_id string, record_type string, page string, url string, digest string, payload_bytes long, "
           "refers_to string, segment int, total_bytes long, body binary, error string")
_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page", pa.string()), ("url", pa.string()),
                     ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
                     ("segment", pa.int32()), ("total_bytes", pa.int64()), ("body", pa.binary()), ("error", pa.string())])


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if its framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        at = end + 2 + size
        if body[at:at + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        parts.append(body[end + 2:at])
        at += 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def page_records(page: str, url: str, payload: bytes, digest: str, refers_to: str | None, origin_url: str | None,
                 date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the separators behind them."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    base = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", page),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("WARC-Payload-Length", str(len(payload)))]
    http = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *base, ("WARC-Profile", _PROFILE), ("WARC-Refers-To-Target-URI", origin_url),
                       ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Page-ID", refers_to), http], b"")
        return
    block = _HTTP + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *base, http], block)
        return
    starts = range(0, len(block), segment_bytes)
    for k, i in enumerate(starts, 1):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(starts) else []
        number = [("WARC-Segment-Number", str(k))]
        if k == 1:
            fields = [("WARC-Type", "response"), *base, http, *number]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                      ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", own), *number]
        yield _record([*fields, *last], block[i:i + segment_bytes])


def _url(column: str):
    """A url that fits a header line: line ends and tabs are written as %XX."""
    url = F.coalesce(F.col(column).cast("string"), F.lit("about:blank"))
    for control in "\t\n\r":
        url = F.replace(url, F.lit(control), F.lit(f"%{ord(control):02X}"))
    return url


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write ``pages`` as WARC files into the folder ``path``."""
    payload = text_of(payload_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("_cf_page"), _url(url_col).alias("_cf_url"), payload.alias("_cf_payload"),
                        F.sha1(payload).alias("_cf_digest"))
    groups = (rows.filter(F.octet_length("_cf_payload") >= REVISIT_BYTES).groupBy("_cf_digest")
              .agg(F.count(F.lit(1)).alias("_cf_copies"), F.max(F.struct("_cf_page", "_cf_url")).alias("_cf_origin"))
              .filter((F.col("_cf_copies") > 1) & F.col("_cf_origin._cf_page").isNotNull())
              .select(F.col("_cf_digest").alias("_cf_gdigest"), F.col("_cf_origin._cf_page").alias("_cf_opage"),
                      F.col("_cf_origin._cf_url").alias("_cf_ourl")))
    groups = written(groups, "warc-groups")
    if groups.count() <= MAX_BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    revisit = F.col("_cf_opage").isNotNull() & (F.col("_cf_page").isNull() | (F.col("_cf_page") < F.col("_cf_opage")))
    rows = rows.join(groups, F.col("_cf_digest") == F.col("_cf_gdigest"), "left").select(
        F.coalesce(F.col("_cf_page").cast("string"), F.lit("")).alias("page"), "_cf_url", "_cf_payload", "_cf_digest",
        F.when(revisit, F.col("_cf_opage").cast("string")).alias("refers_to"), F.when(revisit, F.col("_cf_ourl")).alias("origin"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for record in page_records(*row, date, segment_bytes, chunk_bytes):
                    out.append(record)
                    held += len(record)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # Bytes pass through the string type unchanged; the writer adds the separator behind each record.
    (rows.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", _SEPARATOR).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names) and block of the record at a place, and the place behind it; ValueError if there is none."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(b"WARC/", at):
        raise ValueError(f"no WARC record at byte {at}")
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError(f"record without its length at byte {at}")
    after = end + 4 + int(size)
    if after > len(data):
        raise ValueError(f"record cut off at byte {at}")
    block, here = data[end + 4:after], after
    while data[here:here + 2] == b"\r\n":
        here += 2
    return fields, block, here


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Fields, block and error of each record of a WARC file; behind a place without one, from the next record on."""
    at = 0
    while at < len(data):
        try:
            fields, block, at = _at(data, at)
            yield fields, block, None
        except ValueError as e:
            yield {}, b"", str(e)
            at = data.find(b"\r\n\r\nWARC/", at + 1)
            if at < 0:
                return
            at += 4


def file_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """``records`` of a plain or gzip file. Of a gzip file one member is unpacked at a time; behind a broken one, from the next on."""
    if not data.startswith(_GZIP):
        yield from records(data)
        return
    at = 0
    while at >= 0 and at < len(data):
        start, parts, member = at, [], zlib.decompressobj(wbits=31)
        try:
            while not member.eof and at < len(data):
                piece = data[at:at + UNPACK_BYTES]
                at += len(piece)
                parts.append(member.decompress(piece))
            at -= len(member.unused_data)
        except zlib.error:
            pass
        yield from records(b"".join(parts))
        if not member.eof:
            yield {}, b"", f"broken gzip member at byte {start}"
            at = data.find(_GZIP, start + 1)


def walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record; ValueError where there is none."""
    for fields, block, error in records(data):
        if error:
            raise ValueError(error)
        yield fields, block


def _sha1(value: str) -> tuple[str | None, str | None]:
    """Lower-case hexadecimal of a payload digest, and what is wrong with it. Other algorithms are not looked at."""
    name, _, digits = value.partition(":")
    if name.lower() != "sha1":
        return None, None
    if re.fullmatch("[0-9a-fA-F]{40}", digits):
        return digits.lower(), None
    try:
        found = base64.b32decode(digits.upper()).hex()
    except ValueError:
        found = ""
    return (found, None) if len(found) == 40 else (None, "unreadable digest")


def _decoded(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
    """Payload of an HTTP block, and what is wrong with it."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "no HTTP header"
    if re.search(rb"\r\ntransfer-encoding:[ \t]*chunked", head, re.I):
        try:
            body = dechunked(body)
        except ValueError as e:
            return None, f"chunked framing: {e}"
    return body, None if digest in (None, hashlib.sha1(body).hexdigest()) else "digest differs"


def _rows(data: bytes, segments: bool) -> Iterator[tuple]:
    for f, block, broken in file_records(data):
        if broken:
            if not segments:
                yield (None,) * 10 + (broken,)
            continue
        kind = f.get("warc-type")
        number, total, length = (f.get(n) for n in ("warc-segment-number", "warc-segment-total-length", "warc-payload-length"))
        is_segment = number is not None
        if is_segment != segments or kind not in ("response", "revisit", "continuation"):
            continue
        digest, odd = _sha1(f.get("warc-payload-digest", ""))
        body, error = (block, None) if segments else (None, None) if kind == "revisit" else _decoded(block, digest)
        size = _whole(length) if kind == "revisit" else None if body is None else len(body)
        yield (f.get("warc-segment-origin-id") or f.get("warc-record-id"), kind, f.get("warc-page-id"), f.get("warc-target-uri"),
               digest, size, f.get("warc-refers-to-page-id"), _whole(number), _whole(total), body, error or odd)


def _whole(digits: str | None) -> int | None:
    return int(digits) if digits and digits.isascii() and digits.isdigit() and len(digits) < 10 else None


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[9] or b"")
        if size >= 8 << 20 or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)


def _parsed(files: DataFrame, segments: bool) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for data in batch.column(0):
                    yield from _rows(data.as_py(), segments)

        return _batches(rows())

    return files.select("content").mapInArrow(parse, _FIELDS)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records of segment rows: grouped by origin, in order, verified, decoded. A group is one record's pieces."""
    first = F.max(F.when(F.col("segment") == 1, F.struct("record_type", "page", "url", "digest")))
    # A segment that was archived twice counts once.
    pieces = F.sort_array(F.collect_set(F.struct("segment", "body")))
    joined = segments.groupBy("record_id").agg(first.alias("first"), pieces.alias("pieces"), F.max("total_bytes").alias("total_bytes"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    head, pieces = r["first"] or {}, r["pieces"]
                    block = b"".join(p["body"] for p in pieces)
                    if not head or [p["segment"] for p in pieces] != list(range(1, len(pieces) + 1)) or len(block) != r["total_bytes"]:
                        body, error = None, "segments are missing or differ from the total length"
                    else:
                        body, error = _decoded(block, head["digest"])
                    yield (r["record_id"], head.get("record_type"), head.get("page"), head.get("url"), head.get("digest"),
                           None if body is None else len(body), None, None, r["total_bytes"], body, error)

        return _batches(rows())

    return joined.mapInArrow(decode, _FIELDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of the WARC files in ``path``: ``record_id, record_type, page, url,
    digest, payload_bytes, refers_to, payload, error`` (a revisit has no payload of its own)."""
    files = spark.read.format("binaryFile").load(path)
    whole = _parsed(files, segments=False).unionByName(reassemble(_parsed(files, segments=True)))
    return whole.select("record_id", "record_type", "page", "url", "digest", "payload_bytes", "refers_to",
                        F.col("body").alias("payload"), "error")
