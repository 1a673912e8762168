import random
import zlib

import pytest
from conftest import EDGES, prose

from corpusflow.llm.sharding import balanced_shards


def check(rows, found, shards):
    sizes = [len((t or "").encode()) + 1 for _, t, _ in rows]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found) == sorted(
        (i is not None, i or 0, n, zlib.crc32((t or "").encode())) for (i, t, _), n in zip(rows, sizes))
    held = [0] * shards
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    for s in range(shards):
        own = [r for r in order if r["shard"] == s]
        assert [r["slot"] for r in own] == list(range(len(own)))
        held[s] = sum(r["size"] for r in own)
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert ids == sorted(ids)  # contiguous
    if rows:
        assert max(abs(h - sum(sizes) / shards) for h in held) <= max(sizes)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_contiguous_and_balanced(frame, shards):
    rng = random.Random(4)
    rows = [(rng.randint(0, 300), prose(i, rng.randint(0, 40)), "s") for i in range(500)]
    check(rows, balanced_shards(frame(rows), shards).collect(), shards)


def test_edges(edges, empty):
    check(EDGES, balanced_shards(edges).collect(), 16)
    assert balanced_shards(empty).count() == 0
    with pytest.raises(ValueError):
        balanced_shards(edges, 0)
