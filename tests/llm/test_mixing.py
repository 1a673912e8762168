import random
from collections import defaultdict

import pytest
from conftest import EDGES, prose

from corpusflow.llm.mixing import mix, mixed, pfair_period, whole_weights


@pytest.mark.parametrize("units", [[1], [1, 1], [5, 3, 2], [500] + [10] * 50, [333, 333, 334], [1] * 40 + [960]])
def test_every_prefix_deviates_by_less_than_a_block(units):
    total, given = sum(units), [0] * len(units)
    for t, (s, j, slot) in enumerate(pfair_period(units), 1):
        assert (slot, j) == (t - 1, given[s])
        given[s] += 1
        assert all(abs(n * total - t * c) < total for n, c in zip(given, units))
    assert given == units


def test_whole_weights():
    assert sum(whole_weights({"a": 1, "b": 1, "c": 1}, 1000).values()) == 1000
    assert whole_weights({"a": 1, "b": 0}, 10)["b"] == 1
    with pytest.raises(ValueError):
        whole_weights({"a": -1.0}, 10)


def check(rows, found, block_bytes):
    assert sorted(r["position"] for r in found) == list(range(len(rows)))
    sizes = defaultdict(list)
    for i, t, s in rows:
        sizes[s].append(len((t or "").encode()) + 1)
    starts = defaultdict(list)
    for r in sorted(found, key=lambda r: r["position"]):
        assert r["block"] == r["start_byte"] // block_bytes
        starts[r["source"]].append((r["start_byte"], r["size"]))
    for s, placed in starts.items():
        assert [a for a, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))]
        assert sorted(n for _, n in placed) == sorted(sizes[s])
    slots = [r["slot"] for r in sorted(found, key=lambda r: r["position"])]
    assert slots == sorted(slots)


def test_mixture(spark, frame):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(1, 60)), rng.choice("aaaaaabbc")) for i in range(400)]
    docs = frame(rows)
    found = mix(docs, {"a": 0.2, "b": 0.5, "c": 0.3}, block_bytes=500, period=100).collect()
    check(rows, found, 500)
    units = {"a": 20, "b": 50, "c": 30}
    by_slot = {}
    for r in found:
        assert by_slot.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    for slot, (s, j) in by_slot.items():  # each block lies in its Pfair window
        assert j * 100 // units[s] <= slot < -(-(j + 1) * 100 // units[s])
    out = mixed(docs, shares={"a": 0.2, "b": 0.5, "c": 0.3}, block_bytes=500, period=100)
    assert out.columns == docs.columns
    position = {r["doc_id"]: r["position"] for r in found}
    assert [r["doc_id"] for r in out.collect()] == sorted(position, key=position.get)


def brute_positions(rows, shares, block_bytes):
    """Sources' rows in the order of their copies' keys are not known from outside: positions by source and block alone."""
    from fractions import Fraction

    exact = {s: Fraction(str(w)) for s, w in shares.items()}
    exact = {s: w / sum(exact.values()) for s, w in exact.items()}
    sizes = {s: sum(len((t or "").encode()) + 1 for _, t, z in rows if z == s) for s in shares}
    left = {s: -(-sizes[s] // block_bytes) for s in shares}
    done, slot, order = dict.fromkeys(shares, 0), 0, {}
    names = sorted(shares)
    while any(done[s] < left[s] for s in names):  # earliest deadline first among released blocks, slot by slot
        ready = [(-(-(done[s] + 1) // exact[s]), names.index(s), s) for s in names if done[s] < left[s] and done[s] // exact[s] <= slot]
        if ready:
            s = min(ready)[2]
            order[slot] = (s, done[s])
            done[s] += 1
        slot += 1
    return order


def test_positions_against_brute_force(frame):
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randint(1, 40)), rng.choice("aaabbc")) for i in range(250)] + [(7, prose(7, 9), "b")] * 30
    shares = {"a": 0.3, "b": 0.6, "c": 0.1}
    found = sorted(mix(frame(rows), shares, block_bytes=300).collect(), key=lambda r: r["position"])
    order = brute_positions(rows, shares, 300)
    assert [r["position"] for r in found] == list(range(len(rows)))
    for r in found:
        assert order[r["slot"]] == (r["source"], r["block"])
    for a, b in zip(found, found[1:]):
        assert (a["slot"], a["start_byte"]) < (b["slot"], b["start_byte"])


def test_repeated_rows_keep_their_places(frame, monkeypatch):
    """40 rows of one source and 40 copies of a row of another alternate, also where copies are spread over tasks."""
    from corpusflow.llm import mixing

    rows = [(i, f"text number {i:04d}", "a") for i in range(40)] + [(900, "text number 9000", "b")] * 40
    for copies in (1024, 7):
        monkeypatch.setattr(mixing, "COPIES", copies)
        out = [r["source"] for r in mixed(frame(rows), shares={"a": 1, "b": 1}, block_bytes=17).collect()]
        assert out == ["a", "b"] * 40
    # The same id and text under another source, or beside another column, is another row.
    rows = [(1, "x" * 16, "a"), (1, "x" * 16, "b"), (1, "x" * 16, None), (1, None, "a"), (1, "x" * 16, "a")]
    out = mixed(frame(rows), block_bytes=17).collect()
    assert sorted((r["doc_id"], str(r["text"]), str(r["source"])) for r in out) == sorted((i, str(t), str(s)) for i, t, s in rows)


def test_edges(edges, empty):
    check(EDGES, mix(edges).collect(), 64 << 10)
    assert mixed(edges).count() == len(EDGES)
    assert mixed(empty).count() == 0


def test_equal_shares_stay_within_a_block_on_long_inputs(frame):
    docs = frame([(i, "123456789", "abc"[i % 3]) for i in range(3000)])  # a document fills a block
    found = sorted(mix(docs, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, block_bytes=10).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in found] == list(range(3000))
    given = dict.fromkeys("abc", 0)
    for t, r in enumerate(found, 1):
        given[r["source"]] += 1
        assert all(abs(3 * n - t) < 3 for n in given.values()), (t, given)


def test_many_small_sources_leave_a_large_one_its_weight(frame):
    docs = frame([(i, "x" * 99, f"s{i}") for i in range(2000)] + [(2000 + i, "x" * 999, "hot") for i in range(100)])
    found = mix(docs, block_bytes=1000).collect()
    assert len(found) == 2100
    share = 100_000 ** 0.5 / (100_000 ** 0.5 + 2000 * 100 ** 0.5)
    hot = [r for r in found if r["source"] == "hot"]
    assert all(r["weight"] == pytest.approx(share, rel=1e-9) for r in hot)
    for r in hot:
        assert int(r["block"] / share) <= r["slot"] < (r["block"] + 1) / share + 1


def test_weights_that_are_missing_or_zero():
    from corpusflow.llm.mixing import exact_weights

    assert exact_weights({"a": 0.2, "b": 0.5, "c": 0.3}) == {"a": 2, "b": 5, "c": 3}
    assert exact_weights({"a": 1, "b": 0, "z": 0}, ["a", "b", None]) == {"a": 1000, "b": 1, None: 1}
    for bad in ({"a": -1.0, "b": 2}, {"a": 0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            exact_weights(bad)


def test_schedule_is_written_in_parts(spark):
    from corpusflow.llm.mixing import pfair_slots, schedule

    found = schedule(spark, [1, 1, 3], [4, 30, 60], 5, rows=7)
    assert sorted(map(tuple, found.collect())) == sorted(pfair_slots([1, 1, 3], [4, 30, 60], 5))
    assert found.count() == 94
