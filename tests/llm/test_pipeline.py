"""The pipeline against plain Python on a small corpus, and its registered queries."""

import random

import corpus_pipeline
from conftest import prose
from test_decontaminate import brute as contaminated_by
from test_near_dup import brute as classes_of

import __spark_entry__ as entry
from corpusflow.llm import toxicity as tx
from corpusflow.llm.common import table


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    items = [(k, prose(900 + k, 30)) for k in range(5)]
    rows, labels = [], []
    for i in range(300):
        text = prose(i, rng.randint(30, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            text[3:3] = ["idiot", "trash", "stupid", "scum"]
        if i % 17 == 0:
            text += items[i % 5][1].split()
        rows.append([i, " ".join(text), "en", f"src{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(300, 340):  # near copies
        text = rows[(i - 300) // 3 * 7 % 300][1].split()
        text[len(text) // 2] = f"changed{i}"
        rows.append([i, " ".join(text), "en", "src0", 0])
    rows.append([340, None, "en", "src1", 0])
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = table(spark, str(tmp_path), "documents")
    chain = tx.train(docs, table(spark, str(tmp_path), "labels"))
    rejected = {r["doc_id"] for r in tx.predict(docs, chain).collect() if r["rejected"]}
    assert {i for i, _, y in labels if y} <= rejected
    left = [(r[0], r[1], r[3]) for r in rows if r[0] not in rejected]
    first = {(i, named) for i, named, _ in classes_of(left)}
    left = [r for r in left if (r[0], r[0]) in first or not r[1]]
    left = [r for r in left if not contaminated_by(r[1], items)[3]]
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in left)
    assert {r["shard"] for r in found} <= set(range(16))


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
    names = list(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_stages_with_repeated_rows_and_clashing_columns(spark, frame, edges, empty, tmp_path):
    """Each stage keeps the columns of its input, whatever they are called, and every row that it has no reason to drop."""
    rows = [(i, prose(i, 40), f"s{i % 3}") for i in range(30)] + [(3, prose(3, 40), "s0")] * 5 + [(90, prose(8, 40), "s1")]
    items = [(1, prose(700, 20))]
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, n in ((frame(rows), len(rows)), (edges, edges.count()), (empty, 0)):
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path)) if name != "shard" else None
            if out is not None:
                assert out.columns == docs.columns, name
                kept[name] = out.count()
        assert kept["decontaminate"] == kept["mix"] == n
        assert kept["near_dedup"] == {36: 30, 0: 0}.get(n, kept["near_dedup"])
        path = str(tmp_path / f"docs{n}")
        docs.write.parquet(path)
        shards = corpus_pipeline.shard(spark, spark.read.parquet(path), str(tmp_path)).collect()
        assert len(shards) == n and all(0 <= r["shard"] < 16 for r in shards)
