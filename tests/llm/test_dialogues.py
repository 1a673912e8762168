import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from corpusflow.llm import dialogues
from corpusflow.llm.dialogues import damaged, repair, repair_report, transitions

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_audit(rows):
    """rows: (initial, must go, truncated). Cheapest and least audit by plain tuples over all edits."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, ""))
        else:
            initial, gone, cut = rows[i]
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit))
            if not gone:
                for c in "sua":
                    if (state, c) in moves and (c == initial or c != "s"):
                        cost, audit = best(i + 1, moves[state, c], 0)
                        found.append((cost + 5 * cut + (c != initial), ("K" if c == initial else "R") + audit))
        if inserts < 3:
            for c in "ua":
                if (state, c) in moves:
                    cost, audit = best(i, moves[state, c], inserts + 1)
                    found.append((cost + 5, "I" + audit))
        return min(found, default=(10 ** 9, ""))

    return best(0, 0, 0)


def brute_report(rows, ids):
    out = {}
    for conv in ids:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        seen, faults, classes = set(), {"b": 0, "d": 0, "t": 0}, []
        for _, _, role, text in mine:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            classes.append((role[:1], fault in ("b", "d") and bool(fault), fault == "t"))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = brute_audit(tuple(classes))
        state, lines, at = 0, [], 0
        for letter in audit:
            row = None if letter == "I" else mine[at]
            at += row is not None
            if letter == "D":
                continue
            role = row[2] if letter == "K" else "assistant" if state == 2 else "user"
            lines.append(f"{role}:{row[3] if row else ''}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        out[conv] = (gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(seed, convs=60, most=14):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "umpire", "", None]
    texts = ["Yes.", "No", "", " \t\n", "Why?", "Because", "Fine!", "été 漢字", None, "a" * 5000 + ".", "x. "]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(0, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def found(report):
    return {r["conv_id"]: tuple(r)[1:] for r in report.collect()}


def test_damage_and_report_against_brute_force(spark, frame, monkeypatch):
    rows = rows_of(1)
    df = frame(rows, SCHEMA)
    assert sorted(map(str, brute_damage(rows))) == sorted(str(tuple(r)) for r in damaged(df).collect())
    expected = brute_report(brute_damage(rows), {r[0] for r in rows})
    assert found(repair_report(damaged(df), ids=df)) == expected


def test_segments_join_to_the_whole(spark, frame):
    rng = random.Random(3)
    for _ in range(400):
        classes = "".join(rng.choice("suaoSUAObd") for _ in range(rng.randint(0, 24)))
        whole = transitions(classes)
        brute = brute_audit(tuple((c.lower(), c in "bd", c.isupper()) for c in classes))
        assert min(p for p in (whole[0], whole[3]) if p) == brute
        cuts = sorted(rng.randint(0, len(classes)) for _ in range(3))
        parts = [classes[a:b] for a, b in zip([0, *cuts], [*cuts, len(classes)])]
        assert dialogues.cheapest([transitions(p) for p in parts]) == brute


def test_long_conversation_over_many_partitions(spark, frame):
    """One conversation holds most rows: its segments come from several partitions and give one audit."""
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Hm.", f"Word {i}.", f"cut {i}"])) for i in range(5000)]
    rows += [(8, 0, "user", "Hm."), (8, 1, "assistant", "Yes.")] + [(9, 1, "user", "same.")] * 1500
    df = frame(rows, SCHEMA).repartition(7)
    mine = brute_report([r for r in rows if r[0] == 8], {8})
    reports, turns = repair(df)
    got = {r["id"]: r for r in reports.collect()}
    assert tuple(got[8])[1:] == mine[8][:-1]
    assert tuple(got[9])[1:] == (0, 0, 1499, 0, 1499, 3000, "D" * 1500)
    ordered = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    seen, classes = set(), ""
    for _, _, role, text in ordered:
        classes += "d" if (role, text) in seen else role[0] if text[-1] == "." else role[0].upper()
        seen.add((role, text))
    cost, audit = min(p for p in (transitions(classes)[0], transitions(classes)[3]) if p)
    assert (got[7]["cost"], got[7]["audit"]) == (cost, audit)
    assert got[7]["duplicate"] == classes.count("d") and got[7]["gaps"] == 0
    kept = [r for r in turns.collect() if r["id"] == 7]
    kept.sort(key=lambda r: r["position"])
    assert [r["position"] for r in kept] == list(range(len(kept)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept))


@pytest.mark.parametrize("schema", [SCHEMA, "conv_id string, turn int, role string, text string"])
def test_empty(spark, frame, schema):
    df = frame([], schema)
    assert repair_report(damaged(df), ids=df).collect() == []


def test_all_rows_dropped(spark, frame):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = frame([(conv, 0, "user", "Hi.")], SCHEMA)
    assert found(repair_report(damaged(df), ids=df)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
