import hashlib

import pytest

import spec
from corpusflow.config import ChunkConfig
from corpusflow.operators.chunking import chunk_documents


def _docs(spark, texts):
    return spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)],
                                 "doc_id long, filename string, content string")


@pytest.mark.parametrize("size,overlap", [(5, 1), (4, 0), (3, 2)])
def test_chunk_boundaries_match_loop(spark, size, overlap):
    counts = [0, 1, 4, 5, 6, 9, 10, 11, 13, 14, 50, 51]
    texts = [" ".join(f"w{j}" for j in range(n)) for n in counts] + ["  lead  and\ttrail \n", "　a b "]
    out = chunk_documents(_docs(spark, texts), ChunkConfig(size, overlap), keep=["doc_id"]).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append((r["chunk_index"], r["content"], r["chunk_id"], r["filename"]))
    for i, t in enumerate(texts):
        want = spec.chunk(t, size, overlap)
        got = sorted(by_doc.get(i, []))
        assert [c for _, c, _, _ in got] == want, (i, t)
        for idx, content, cid, fname in got:
            assert cid == f"{fname}_{idx}_{hashlib.md5(content.encode()).hexdigest()[:8]}"


def test_overlap_must_be_smaller_than_size():
    with pytest.raises(ValueError):
        ChunkConfig(5, 5)
    with pytest.raises(ValueError):
        ChunkConfig(5, 6)


def test_legacy_ids_collide_across_files(spark):
    docs = _docs(spark, ["same words here", "same words here"])
    new = chunk_documents(docs, ChunkConfig(5, 1)).select("chunk_id").distinct().count()
    legacy = chunk_documents(docs, ChunkConfig(5, 1), legacy_ids=True).select("chunk_id").distinct().count()
    assert new == 2 and legacy == 1


def test_chunking_plan_is_narrow(spark):
    plan = chunk_documents(_docs(spark, ["a b c"]), ChunkConfig(5, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
