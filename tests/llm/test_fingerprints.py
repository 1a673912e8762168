import hashlib

import numpy as np
import pytest
from conftest import EDGES, prose

from corpusflow.llm import fingerprints as fp


def test_parse():
    assert fp.parse("aababcabcd", set()) == (["a", "ab", "abc", "abcd"], "")
    assert fp.parse("aa", set()) == (["a"], "a")
    seen = set()
    head, rest = fp.parse("abcab", seen)
    tail, _ = fp.parse("cabcab", seen, rest)
    assert head + tail == fp.parse("abcabcabcab", set())[0]


def test_likeness_is_the_jaccard_similarity_of_small_sets():
    a, b = prose(1, 30), prose(1, 20) + prose(2, 10)
    x, y = set(fp.parse(a, set())[0]), set(fp.parse(b, set())[0])
    sigs = [fp.signature(fp.hashed(sorted(s))) for s in (x, y)]
    assert max(len(x), len(y)) <= fp.SIZE
    exact = len(x & y) / len(x | y)
    assert fp.likeness(*sigs) == pytest.approx(exact, abs=0.12)
    assert fp.likeness(sigs[0], sigs[0]) == 1.0
    none = np.empty(0, np.uint64)
    assert (fp.likeness(none, none), fp.likeness(none, sigs[0])) == (1.0, 0.0)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t, _) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + following[:q]
        sig = [fp.signature(fp.hashed(fp.parse(x, set())[0])) for x in (t, edited, following)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(sig[0]), fp.as_text(sig[1]),
                    fp.likeness(sig[0], sig[1]), fp.likeness(sig[0], sig[2])))
    return out


def rows_of(found):
    return sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
                   for r in found.collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [16 << 20, 3000, 200])
def test_neighbours_equal_brute_force(frame, range_bytes):
    rows = [(i * 3 - 90, prose(i % 37, 5 + i % 60) + "é漢𝒳" * (i % 3), "s") for i in range(120)] + [(1000, None, "s"), (1001, "", "s"), (1002, "abc", "s")]
    assert rows_of(fp.neighbour_likeness(frame(rows), range_bytes=range_bytes)) == sorted(brute(rows), key=repr)


def test_edges(spark, frame, edges, empty):
    found = fp.neighbour_likeness(edges, range_bytes=1000).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in found) == sorted((i or -1, len(t or "")) for i, t, _ in EDGES)
    assert fp.neighbour_likeness(empty).count() == 0
    one = fp.neighbour_likeness(frame([(4, "only one text here", "s")])).collect()[0]
    assert one["near_next"] == 1.0
    prints = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(edges).collect()}
    assert prints[6] == prints[7] == fp.fingerprint(prose(6, 80)) and prints[3] == ""
