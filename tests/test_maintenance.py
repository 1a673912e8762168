import os
import tempfile

from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig
from corpusflow.operators import maintenance as mt
from corpusflow.operators.chunking import chunk_documents
from corpusflow.operators.maintenance import replace_in_index


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, filename string, content string")


def test_delete_and_replace(spark):
    docs = _docs(spark, [(1, "a.txt", "one two three"), (2, "b.txt", "four five"), (3, "c.txt", "six")])
    chunks = chunk_documents(docs, ChunkConfig(2, 1), keep=["doc_id"])
    rest = mt.delete_documents(chunks, spark.createDataFrame([("b.txt",)], "filename string"))
    assert sorted({r["filename"] for r in rest.collect()}) == ["a.txt", "c.txt"]
    v2 = chunk_documents(_docs(spark, [(2, "b.txt", "FOUR")]), ChunkConfig(2, 1), keep=["doc_id"])
    both = chunks.withColumn("version", F.lit(1)).unionByName(v2.withColumn("version", F.lit(2)))
    latest = mt.latest_versions(both).where("filename = 'b.txt'").collect()
    assert [r["content"] for r in latest] == ["FOUR"]


def test_duplicates_and_stats(spark):
    docs = _docs(spark, [(1, "a.txt", "x y"), (2, "b.txt", "x y"), (3, "c.txt", "z")])
    chunks = chunk_documents(docs, ChunkConfig(5, 1))
    dup = mt.duplicate_chunks(chunks).collect()
    assert len(dup) == 1 and dup[0]["copies"] == 2 and dup[0]["files"] == 2
    st = mt.index_stats(chunks).first()
    assert (st["document_count"], st["files"], st["content_bytes"]) == (3, 3, 7)
    status = {r["filename"]: r["status"] for r in mt.ingest_status(docs).collect()}
    assert status["a.txt"] == "Indexed 1 chunks from a.txt"


def test_replace_in_index_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="cf-index-")
    path = os.path.join(root, "index")
    v1 = chunk_documents(_docs(spark, [(1, "a.txt", "a b c"), (2, "b.txt", "d e")]), ChunkConfig(2, 1))
    replace_in_index(v1, path)
    v2 = chunk_documents(_docs(spark, [(1, "a.txt", "NEW")]), ChunkConfig(2, 1))
    replace_in_index(v2, path)
    replace_in_index(v2, path)  # replayed micro-batch
    rows = sorted((r["filename"], r["content"]) for r in spark.read.parquet(path).collect())
    assert rows == [("a.txt", "NEW"), ("b.txt", "d e")]


def test_index_rows_vectors(spark):
    docs = _docs(spark, [(1, "a.txt", "alpha beta alpha")])
    row = mt.index_rows(docs, keep=["doc_id"]).first()
    assert len(row["content_embedding"]) == 256 and row["dimension"] == 256
    assert abs(sum(x * x for x in row["content_embedding"]) - 1.0) < 1e-6  # float32 at rest
    assert sum(1 for x in row["filename_embedding"] if x) == 1


def test_write_index_observes_counts(spark):
    docs = _docs(spark, [(1, "a.txt", "one two three"), (2, "b.txt", "four")])
    idx = mt.index_rows(docs, ChunkConfig(2, 1), keep=["doc_id"])
    path = os.path.join(tempfile.mkdtemp(prefix="cf-write-"), "index")
    metrics = mt.write_index(idx, path)
    assert metrics == {"stored": 3, "missing_vectors": 0}
    assert spark.read.parquet(path).count() == 3


def test_stream_ingest_progress(spark):
    from corpusflow.streaming.ingest import run_stream_ingest

    root = tempfile.mkdtemp(prefix="cf-stream-")
    docs = _docs(spark, [(i, f"f{i}.txt", "w " * (i + 1)) for i in range(6)])
    docs.repartition(3).write.parquet(os.path.join(root, "in"))
    totals = run_stream_ingest(spark, os.path.join(root, "in"), docs.schema, os.path.join(root, "idx"),
                               os.path.join(root, "ck"), ChunkConfig(4, 1))
    assert totals["found"] == totals["stored"] == 6 and totals["batches"] == 3 and totals["failed"] == 0
    assert spark.read.parquet(os.path.join(root, "idx")).select("filename").distinct().count() == 6


def test_two_versions_in_one_micro_batch(spark, tmp_path):
    from corpusflow.streaming.ingest import run_stream_ingest

    schema = "doc_id long, filename string, content string"
    spark.createDataFrame([(1, "a.txt", "old words"), (3, "a.txt", "new words"), (2, "b.txt", "other"), (2, "a.txt", "between")],
                          schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    index, ckpt = str(tmp_path / "index"), str(tmp_path / "ckpt")
    run_stream_ingest(spark, str(tmp_path / "in"), schema, index, ckpt)
    assert {(r["filename"], r["content"]) for r in spark.read.parquet(index).collect()} == {("a.txt", "new words"), ("b.txt", "other")}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_ingest_stream_to_the_end(spark, tmp_path):
    """Clean, embed, quarantine per document, totals that a replayed batch leaves as they are."""
    from corpusflow.operators.embedding import CallableProvider
    from corpusflow.streaming import ingest

    def embed(text):
        if "poison" in text:
            raise ValueError("poison")
        return [float(len(text)), 1.0]

    embedder = lambda: CallableProvider(embed, 2, name="length", model="m")
    schema = "doc_id long, filename string, content string"
    first = [(1, "a.txt", "one\r\n\n\n\ntwo  \nthree"), (2, "b.txt", "poison here"), (3, "c.txt", None), (4, "d.txt", " \n ")]
    second = [(5, "a.txt", "newer text"), (6, "e.txt", "more words"), (7, "c.txt", "now there")]
    third = [(8, "e.txt", "poison now")]
    index, log = str(tmp_path / "index"), str(tmp_path / "log")
    for n, rows in enumerate((first, second, third)):
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2 if n == 1 else 1):
            ingest.ingest_batch(batch, n, index, log, ChunkConfig(2, 1), embedder=embedder)
    rows = spark.read.parquet(index).collect()
    assert {(r["filename"], r["content"]) for r in rows} == {("a.txt", "newer text"), ("e.txt", "more words"), ("c.txt", "now there")}
    assert {(r["provider"], r["device"], r["dimension"]) for r in rows} == {("length", "cpu", 2)}
    totals = ingest.ingest_totals(spark, log).first().asDict()
    assert totals == {"batches": 3, "found": 8, "stored": 4, "failed": 4, "chunks": 5} and totals["found"] == totals["stored"] + totals["failed"]
    assert sorted((r["key"], r["reason"]) for r in ingest.quarantined(spark, log).collect()) == [
        ("b.txt", "null_vector"), ("c.txt", "missing"), ("d.txt", "empty"), ("e.txt", "null_vector")]
    assert spark.read.parquet(log).where("filename = 'a.txt' AND batch = 0").first()["chunks"] == 2  # "one two" and "two three"


def test_delete_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    mt.create_index(spark, path, buckets=16)
    docs = _docs(spark, [(i, f"f{i}.txt", f"text {i}") for i in range(60)])
    replace_in_index(chunk_documents(docs, ChunkConfig(5, 1)), path)
    files = lambda: {os.path.join(b, f): os.stat(os.path.join(b, f)).st_mtime_ns for b, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    bucket = spark.range(1).select(mt.bucket_of(F.lit("f7.txt"), 16)).first()[0]
    alone = [r["filename"] for r in spark.read.parquet(path).where(F.col("bucket") == bucket).collect()]
    assert mt.delete_from_index(spark, path, spark.createDataFrame([("f7.txt",), ("absent",)], "filename string")) == 1
    assert all(after == before.get(name) for name, after in files().items() if f"bucket={bucket}/" not in name)
    assert mt.delete_from_index(spark, path, spark.createDataFrame([("f7.txt",)], "filename string")) == 0
    # The rest of the bucket goes: an emptied bucket is no stale bucket.
    assert mt.delete_from_index(spark, path, spark.createDataFrame([(f,) for f in alone], "filename string")) == len(alone) - 1
    left = {r["filename"] for r in spark.read.parquet(path).collect()}
    assert left == {f"f{i}.txt" for i in range(60)} - set(alone) - {"f7.txt"}
    assert mt.index_info(spark, path).buckets == 16
    assert mt.delete_from_index(spark, str(tmp_path / "none"), spark.createDataFrame([("x",)], "filename string")) == 0


def test_a_replacement_that_was_cut_off_is_finished(spark, tmp_path):
    """The old folder is aside and the new one not yet in place; or the new one was never written whole."""
    for whole in (True, False):
        path = str(tmp_path / f"index{whole}")
        mt.create_index(spark, path, buckets=1)
        replace_in_index(chunk_documents(_docs(spark, [(1, "a.txt", "old"), (2, "b.txt", "kept")]), ChunkConfig(5, 1)), path)
        run = f"{path}.staging/run"
        rows = spark.read.parquet(path).withColumn("content", F.when(F.col("filename") == "a.txt", "new").otherwise(F.col("content")))
        mt.write_buckets(rows, run, "overwrite")
        if not whole:
            os.remove(f"{run}/_SUCCESS")
        os.makedirs(f"{run}/_old")
        os.rename(f"{path}/bucket=0", f"{run}/_old/bucket=0")
        replace_in_index(chunk_documents(_docs(spark, [(3, "c.txt", "added")]), ChunkConfig(5, 1)), path)
        got = {(r["filename"], r["content"]) for r in spark.read.parquet(path).collect()}
        assert got == {("a.txt", "new" if whole else "old"), ("b.txt", "kept"), ("c.txt", "added")}
        assert not os.path.exists(run)


def test_an_index_keeps_its_dimension_and_buckets(spark, tmp_path):
    import pytest

    path = str(tmp_path / "index")
    assert mt.create_index(spark, path, 768, expected_bytes=3 * mt.BUCKET_BYTES) == mt.IndexInfo(3, 768)
    assert mt.create_index(spark, path, 768, buckets=99) == mt.IndexInfo(3, 768)
    with pytest.raises(ValueError, match="768.*384"):
        mt.create_index(spark, path, 384)


def test_bad_vectors_are_not_written(spark, tmp_path):
    rows = mt.index_rows(_docs(spark, [(1, "a.txt", "x"), (2, "b.txt", "y"), (3, "c.txt", "z")]))
    odd = rows.withColumn("content_embedding", F.when(F.col("filename") == "a.txt", F.lit(None)).when(
        F.col("filename") == "b.txt", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("content_embedding")))
    path = str(tmp_path / "index")
    assert mt.write_index(odd, path) == {"stored": 1, "missing_vectors": 2}
    assert [r["filename"] for r in spark.read.parquet(path).collect()] == ["c.txt"]
    stats = mt.index_table_stats(spark, path).first()
    assert stats["document_count"] == 1 and stats["size_bytes"] > 1000


def test_store_contract(spark, tmp_path):
    import pytest

    from corpusflow.operators.store import IndexStore, create_store, register_store

    store = create_store("Parquet", spark, str(tmp_path / "store"), buckets=4)
    assert store.store(_docs(spark, [(1, "a.txt", "alpha beta"), (2, "b.txt", "gamma delta")])).count() == 0
    store.store(_docs(spark, [(3, "a.txt", "alpha again")]))
    assert [r["content"] for r in store.fetch("a.txt").collect()] == ["alpha again"]
    hits = store.search(spark.createDataFrame([(1, "alpha")], "query_id long, text string"), strategy="content_only", k=1).collect()
    assert [(r["filename"], r["metadata"]) for r in hits] == [("a.txt", {})]
    assert store.delete(spark.createDataFrame([("a.txt",)], "filename string")) is True
    assert store.delete(spark.createDataFrame([("a.txt",)], "filename string")) is False
    assert {r["filename"]: r["status"] for r in store.status().collect()} == {"b.txt": "Indexed 1 chunks from b.txt"}
    assert store.stats().first()["files"] == 1
    register_store("mine", lambda spark, path: ("mine", path))
    assert create_store("mine", spark, "p") == ("mine", "p") and isinstance(store, IndexStore)
    with pytest.raises(ValueError, match="mine, parquet"):
        create_store("elsewhere")


def _arrive(spark, root, n, rows, schema):
    """One file, named so that it comes n-th."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(root, f"in/part={n}"))


def test_dedup_state_ends_with_its_horizon(spark, tmp_path):
    from corpusflow.streaming import ingest

    root, seen, state = str(tmp_path), [], []
    schema = "k string, at timestamp"
    days = [[("a", "2024-01-01"), ("b", "2024-01-01"), ("a", "2024-01-02")], [("a", "2024-01-03"), ("c", "2024-03-01")],
            [("d", "2024-03-02")], [("a", "2024-03-03"), ("c", "2024-03-03")], [("e", "2024-03-04")]]
    for n, rows in enumerate(days):
        import datetime

        _arrive(spark, root, n, [(k, datetime.datetime.fromisoformat(d)) for k, d in rows], schema)
        stream = ingest.deduplicated(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(root + "/in"), F.col("k"), "at", "10 days")
        with ingest.state_store(spark, 2):
            q = (stream.writeStream.foreachBatch(lambda df, i: seen.extend((r["k"], str(r["at"])[:10]) for r in df.collect()))
                 .option("checkpointLocation", root + "/ck").trigger(availableNow=True).start())
            q.awaitTermination()
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    assert sorted(seen) == [("a", "2024-01-01"), ("a", "2024-03-03"), ("b", "2024-01-01"), ("c", "2024-03-01"), ("d", "2024-03-02"), ("e", "2024-03-04")]
    assert max(state) <= 4 and state[-1] == 4 and state[0] == 2  # a, b of January are gone: c, d, a, e


def test_count_windows_leave_the_state(spark, tmp_path):
    import datetime

    from corpusflow.streaming import ingest

    root, state = str(tmp_path), []
    schema = "ts timestamp, kind string"
    for n, days in enumerate([[1, 1, 2], [2, 20], [21, 1], [22]]):
        _arrive(spark, root, n, [(datetime.datetime(2024, 1, d, 5), "x") for d in days], schema)
        counts = ingest.count_windows(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(root + "/in"), "ts", "kind", lateness="3 days")
        with ingest.state_store(spark, 2):
            q = ingest.write_counts(counts, root + "/out", root + "/ck")
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    got = {r["start"].day: r["events"] for r in ingest.read_counts(spark, root + "/out").collect()}
    assert got == {1: 2, 2: 2, 20: 1, 21: 1, 22: 1}  # the row of the 1st that came after the 20th is too late
    assert state[0] == 2 and state[-1] <= 3


def test_ingested_batches_are_staged_not_cached(spark, tmp_path, monkeypatch):
    """A batch is compared and embedded once and lies in files from then on: none of it is kept in the executors, nothing staged stays,
    and a text is in an Arrow batch of 8 MB at most."""
    from pyspark.sql import DataFrame

    from corpusflow.session import BATCH_BYTES
    from corpusflow.streaming import ingest

    def persist(self, *a):
        raise AssertionError("a batch was cached")

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    index, log = str(tmp_path / "index"), str(tmp_path / "log")
    staged, scratch = [], ingest.scratch_path
    monkeypatch.setattr(ingest, "scratch_path", lambda *a: staged.append(scratch(*a)) or staged[-1])
    monkeypatch.setattr(DataFrame, "persist", persist)
    try:
        rows = [(1, "a", "one two"), (2, "a", "three"), (3, "b", None), (4, "c", " \n "), (5, "d", "four")]
        ingest.ingest_batch(spark.createDataFrame(rows, "doc_id long, filename string, content string"), 0, index, log)
        ingest.ingest_batch(spark.createDataFrame([(6, "d", "five"), (7, "a", "")], "doc_id long, filename string, content string"), 1, index, log)
        assert int(spark.conf.get(key).rstrip("b")) == BATCH_BYTES
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    held = {(r["filename"], r["doc_id"], r["content"]) for r in spark.read.parquet(index).collect()}
    assert held == {("a", 2, "three"), ("d", 6, "five")}
    said = {(r["batch"], r["filename"], r["status"], r["reason"], r["chunks"]) for r in spark.read.parquet(log).collect()}
    assert said == {(0, "a", "stored", None, 1), (0, "b", "failed", "missing", 0), (0, "c", "failed", "empty", 0), (0, "d", "stored", None, 1),
                    (1, "a", "failed", "empty", 0), (1, "d", "stored", None, 1)}
    assert len(staged) == 4 and not any(os.path.exists(s.replace("file:", "")) for s in staged)
