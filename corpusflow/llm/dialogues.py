"""Conversation structure repair: the cheapest edits that make roles alternate, by a shortest-path DP over big integers.

Faults of a row, in the order of its conversation, the first that fits: ``blank`` (no character but blanks),
``duplicate`` (role and text seen earlier in the conversation), ``truncated`` (the last character that is no blank is not
one of ``.!?``). Edits, with their audit letters and costs: (K)eep 0, (R)erole to user or assistant 1, (D)elete 2,
which blank and duplicate rows need, (I)nsert an empty user or assistant turn 5; a truncated row that stays adds 5.
The first letters of the roles must then spell ``(s?(ua)+)?``. Of equally cheap audits the ASCII-least is taken.

A path is one whole number: its high digits are the cost, its low digits (base 8, of fixed width) the audit letters in
ASCII order from the top, with zeros after the end, so that the least number is the cheapest path with the least audit.
The DP runs from the last row to the first and only takes minima of such numbers.

Long conversations: rows are range-partitioned by conversation and place, so one conversation spreads over
tasks; each run of SEGMENT_ROWS rows gives the best path between any two of the four states, and those of a
conversation are then joined from its end. Applying an audit streams the rows in order with one batch in memory; a
conversation's digest is a single SHA-256 and therefore one task's work, without keeping the rows.

Order: by turn, nulls first; rows of the same turn by the SHA-256 of role and text, equal ones adjacent.

Defined results: nulls in role and text are one space (``damaged`` also reads them so in its key); a null conversation
id is a conversation of its own; a role without characters has no initial and cannot stay as it is; repeated rows are
rows; a conversation without rows has zeros and an empty audit; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import bounded_batches, written

SEGMENT_ROWS = 512
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Audit letters in ASCII order; their digits are 1 to 4.
LETTERS = "DIKR"
_DIGITS = str.maketrans(LETTERS, "1234")
_SPELLED = str.maketrans("1234", LETTERS)
#: States: nothing yet, after the system turn, after a user, after an assistant turn; the first and the last may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"


def said_next(state: int) -> str:
    """The role that a reroled or inserted turn gets in a state."""
    return "assistant" if state == 2 else "user"


def _transitions(classes: str) -> list[tuple[int, str] | None]:
    """Cost and audit of the best path through the rows from state s to state t at 4 * s + t; None without one.

    ``classes`` has a letter per row: s, u, a or o (another role), upper case if truncated; b and d must be deleted.
    """
    n = len(classes)
    width = n + 2 * n // 5 + 8  # no best path has more inserts than its cost allows
    bits = 3 * width
    low, top = (1 << bits) - 1, bits - 3

    def led(digit: int, cost: int, rest: int | None) -> int | None:
        return None if rest is None else (rest & ~low) + (cost << bits) | digit << top | (rest & low) >> 3

    def least(*paths: int | None) -> int | None:
        return min((p for p in paths if p is not None), default=None)

    def inserted(best: list) -> list:
        more = best
        for _ in range(2):  # a third insert in a row would come back to a state
            more = [least(best[s], led(2, INSERT, more[NEXT[s][said_next(s)[0]]])) for s in range(4)]
        return more

    out: list = [None] * 16
    for end in range(4):
        best = inserted([0 if s == end else None for s in range(4)])
        for c in reversed(classes):
            step = []
            for s in range(4):
                paths = [led(1, DELETE, best[s])]
                if c not in "bd":
                    extra = TRUNCATED if c.isupper() else 0
                    kept = NEXT[s].get(c.lower())
                    if kept is not None:
                        paths.append(led(3, extra, best[kept]))
                    paths.append(led(4, REROLE + extra, best[NEXT[s][said_next(s)[0]]]))
                step.append(least(*paths))
            best = inserted(step)
        for s in range(4):
            if best[s] is not None:
                digits = f"{best[s] & low:0{width}o}"
                out[4 * s + end] = best[s] >> bits, digits.rstrip("0").translate(_SPELLED)
    return out


_short_transitions = lru_cache(maxsize=20_000)(_transitions)


def transitions(classes: str) -> list[tuple[int, str] | None]:
    return _short_transitions(classes) if len(classes) <= 16 else _transitions(classes)


def cheapest(segments: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation from its segments' transitions."""
    rest: list = [(0, "") if s in ENDS else None for s in range(4)]
    for segment in reversed(segments):
        joined = []
        for s in range(4):
            paths = [(segment[4 * s + t][0] + rest[t][0], segment[4 * s + t][1] + rest[t][1])
                     for t in range(4) if segment[4 * s + t] is not None and rest[t] is not None]
            width = max((len(a) for _, a in paths), default=0)
            joined.append(min(paths, default=None, key=lambda p: (p[0] << 3 * width) + int("0" + p[1].translate(_DIGITS).ljust(width, "0"), 8)))
        rest = joined
    return rest[0]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conversations`` with faults put in by CRC-32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it, 4 makes it the user's. Only the four columns are returned."""
    kind = F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv), F.col(turn), _text(role).alias(role), _text(text).alias(text), kind.alias("_cf_kind"))
    rows = rows.filter("_cf_kind <> 0").select(
        conv, turn, F.when(F.col("_cf_kind") == 4, F.lit("user")).otherwise(F.col(role)).alias(role),
        F.when(F.col("_cf_kind") == 1, F.lit("")).when(F.col("_cf_kind") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(F.col(text)).alias(text),
        F.explode(F.when(F.col("_cf_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_cf_copy"))
    return rows.drop("_cf_copy")


def _distinct_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """id, turn, key, role, text and the number ``n`` of equal rows, frozen in the shared folder."""
    rows = conversations.select(F.col(conv).alias("id"), F.col(turn).cast("long").alias("turn"), _text(role).alias("role"), _text(text).alias("text"))
    rows = rows.groupBy("id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    return written(rows.withColumn("key", key), "dialogue-rows")


def _classes(rows: DataFrame) -> DataFrame:
    """id, turn, key, n, role's ``initial``, and the ``cls`` of the first of the equal rows (see ``_transitions``)."""
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.right(ended, F.lit(1)).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    seen = (rows.groupBy(F.col("id").alias("_cf_id"), F.col("key").alias("_cf_key"))
            .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("_cf_first")))
    same = F.col("id").eqNullSafe(F.col("_cf_id")) & (F.col("key") == F.col("_cf_key"))
    narrow = rows.select("id", "turn", "key", "n", initial.alias("initial"), F.when(ended == "", "b").otherwise(letter).alias("cls"))
    first = F.col("turn").eqNullSafe(F.col("_cf_first.turn"))
    return narrow.join(seen, same).select("id", "turn", "key", "n", "initial", F.when((F.col("cls") == "b") | first, F.col("cls")).otherwise("d").alias("cls"))


_SEGMENT = ("id {}, part int, seq long, first string, last string, illegal long, blank long, duplicate long, truncated long, "
            "first_turn long, last_turn long, turns long, costs array<long>, audits array<string>")


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cells = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)


def _arrow_schema(df: DataFrame, conv_type, text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(text.format(conv_type.simpleString())))


class _Run:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv, part: int):
        self.conv, self.part, self.seq = conv, part, 0
        self.clear()

    def clear(self) -> None:
        self.classes, self.size = [], 0
        self.first = self.last = self.first_turn = self.last_turn = None
        self.illegal = self.turns = 0

    def add(self, turn, initial: str, cls: str, n: int) -> Iterator[tuple]:
        while n:
            here = min(n, SEGMENT_ROWS - self.size)
            if self.last is not None and self.last + initial not in LEGAL:
                self.illegal += 1
            self.illegal += (here - 1) * (initial + initial not in LEGAL)
            self.first = initial if self.first is None else self.first
            self.last = initial
            if turn is not None and turn != self.last_turn:
                self.first_turn = turn if self.first_turn is None else self.first_turn
                self.last_turn, self.turns = turn, self.turns + 1
            self.classes.append(cls + (cls if cls in "bd" else "d") * (here - 1))
            if cls not in "bd":
                cls = "d"
            self.size, n = self.size + here, n - here
            if self.size == SEGMENT_ROWS:
                yield self.close()

    def close(self) -> tuple:
        classes = "".join(self.classes)
        found = transitions(classes)
        row = (self.conv, self.part, self.seq, self.first, self.last, self.illegal, classes.count("b"), classes.count("d"),
               sum(map(str.isupper, classes)), self.first_turn, self.last_turn, self.turns,
               [f and f[0] for f in found], [f and f[1] for f in found])
        self.seq += 1
        self.clear()
        return row


def _segments(classes: DataFrame) -> DataFrame:
    """Transitions and counts of runs of up to SEGMENT_ROWS rows, numbered in order by ``part`` and ``seq``."""
    kind = classes.schema["id"].dataType
    schema = _arrow_schema(classes, kind, _SEGMENT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, part = None, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for conv, turn, n, initial, cls in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "n", "initial", "cls"))):
                if run is None or run.conv != conv:
                    if run is not None and run.size:
                        out.append(run.close())
                    run = _Run(conv, part)
                out += run.add(turn, initial, cls, n)
            yield _columns(out, schema)
        if run is not None and run.size:
            yield _columns([run.close()], schema)

    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    return written(classes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _SEGMENT.format(kind.simpleString())), "segments")


_REPORT = "id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _reported(conv, rows: list[dict]) -> tuple:
    blank, duplicate, truncated, illegal, turns = (sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "turns"))
    for a, b in zip(rows, rows[1:]):
        illegal += a["last"] + b["first"] not in LEGAL
    known = [r for r in rows if r["first_turn"] is not None]
    turns -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
    cost, audit = cheapest([[None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])] for r in rows])
    return conv, gaps, blank, duplicate, truncated, illegal, cost, audit


def _reports(ids: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per id: counts, cost and audit. Segments stream in order; a conversation holds its segments' paths only."""
    kind = segments.schema["id"].dataType
    schema = _arrow_schema(segments, kind, _REPORT)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rows, any_ = None, [], False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] is None:  # an id, which comes before its segments
                    if any_:
                        out.append(_reported(conv, rows))
                    conv, rows, any_ = row["id"], [], True
                else:
                    rows.append(row)
            yield _columns(out, schema)
        if any_:
            yield _columns([_reported(conv, rows)], schema)

    both = ids.unionByName(segments, allowMissingColumns=True)
    both = both.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("part").asc_nulls_first(), "seq")
    return both.select("id", "part", "first", "last", "illegal", "blank", "duplicate", "truncated", "first_turn", "last_turn",
                       "turns", "costs", "audits").mapInArrow(report, _REPORT.format(kind.simpleString()))


_REPAIRED = "id {}, position long, role string, text string, edit string"


class _Repair:
    """Applies one audit to the rows of its conversation in order."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.state, self.position = conv, audit, 0, 0, 0

    def _said(self, role: str, text: str, edit: str) -> tuple:
        self.state, self.position = NEXT[self.state][role[0]], self.position + 1
        return self.conv, self.position - 1, role, text, edit

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._said(said_next(self.state), "", "insert")

    def row(self, role: str, text: str, n: int) -> Iterator[tuple]:
        for _ in range(n):
            yield from self.inserts()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                yield self._said(role, text, "keep")
            elif letter == "R":
                yield self._said(said_next(self.state), text, "rerole")


def _repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType
    schema = _arrow_schema(rows, kind, _REPAIRED)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = None
        for batch in batches:
            out = []
            for conv, audit, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("id", "audit", "role", "text", "n"))):
                if audit is not None:  # the report, which comes before its rows
                    out += repair.inserts() if repair else ()
                    repair = _Repair(conv, audit)
                else:
                    out += repair.row(role, text, n)
            yield _columns(out, schema)
        if repair:
            yield _columns(list(repair.inserts()), schema)

    both = reports.select("id", "audit").unionByName(rows, allowMissingColumns=True)
    both = both.repartition("id").sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "key")
    return both.select("id", "audit", "role", "text", "n").mapInArrow(apply, _REPAIRED.format(kind.simpleString()))


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, from the turns as ``repair`` gives them (in order, no shuffle)."""
    kind = turns.schema["id"].dataType
    ddl = "id {}, repaired_sha256 string"
    schema = _arrow_schema(turns, kind, ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running = None, None
        for batch in batches:
            out = []
            for name, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "position", "role", "text"))):
                if position == 0:
                    if running is not None:
                        out.append((conv, running.hexdigest()))
                    conv, running = name, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _columns(out, schema)
        if running is not None:
            yield _columns([(conv, running.hexdigest())], schema)

    return turns.select("id", "position", "role", "text").mapInArrow(digest, ddl.format(kind.simpleString()))


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, turns). Reports: a row per conversation of ``conversations`` and of ``ids`` with ``gaps, blank, duplicate,
    truncated, illegal, cost, audit``. Turns: the repaired conversations (``id, position, role, text, edit``)."""
    bounded_batches(conversations.sparkSession)
    rows = _distinct_rows(conversations, conv, turn, role, text)
    named = rows.select("id") if ids is None else ids.select(F.col(conv).alias("id")).unionByName(rows.select("id"))
    reports = written(_reports(named.distinct(), _segments(_classes(rows))), "reports")
    return reports, _repaired(rows, reports)


def repair_report(conversations: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", **columns: str) -> DataFrame:
    """The reports with the digest of each repaired conversation."""
    reports, turns = repair(conversations, conv=conv, ids=ids, **columns)
    done = digests(turns).withColumnRenamed("id", "_cf_id")
    joined = reports.join(done, F.col("id").eqNullSafe(F.col("_cf_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("id").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                         F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
