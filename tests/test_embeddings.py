import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import spec
from corpusflow.functions.udfs import blake2b_embed
from corpusflow.functions.vectors import cosine, l2_normalise
from corpusflow.operators import embedding as emb
from corpusflow.operators.maintenance import dimension_guard


def test_callable_provider_casts_to_float():
    p = emb.CallableProvider(lambda t: [1, 2, 3], dimension=3)
    assert p.embed("x") == [1.0, 2.0, 3.0] and all(isinstance(v, float) for v in p.embed("x"))


def test_batch_provider_used_for_many():
    calls = []

    def batch(texts):
        calls.append(list(texts))
        return [[len(t), 1, 0] for t in texts]

    p = emb.CallableProvider(lambda t: [0, 0, 0], dimension=3, batch_fn=batch)
    assert p.embed_many(["a", "abcd"]) == [[1.0, 1.0, 0.0], [4.0, 1.0, 0.0]]
    assert calls == [["a", "abcd"]]


def test_default_provider_and_unknown():
    p = emb.create_provider()
    d = p.describe()
    assert d["provider"] == "ollama" and d["model"] == "nomic-embed-text" and d["dimension"] == 768
    assert emb.create_provider("sentence_transformer").describe()["provider"] == "sentence-transformers"
    with pytest.raises(ValueError):
        emb.create_provider("nope")


def test_embed_column_null_on_failure(spark):
    df = spark.createDataFrame([("a",), ("abcd",)], "t string")
    good = df.select(emb.embed_column(F.col("t"), lambda: emb.CallableProvider(lambda t: [len(t), 1, 0], 3), 3)
                     .alias("v")).collect()
    assert [list(r["v"]) for r in good] == [[1.0, 1.0, 0.0], [4.0, 1.0, 0.0]]
    bad = df.select(emb.embed_column(F.col("t"), lambda: emb.CallableProvider(lambda t: [1.0], 3), 3)
                    .alias("v")).collect()
    assert all(r["v"] is None for r in bad)


def test_blake2b_embed_matches_spec(spark):
    texts = ["The train to Montreal", "", "a a a b", "ÉTÉ été"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["v"] for r in df.select(blake2b_embed(256)("t").alias("v")).collect()]
    for t, v in zip(texts, got):
        assert np.allclose(v, spec.blake2b_vector(t), atol=1e-12)


def test_l2_and_cosine_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(l2_normalise("a").alias("n"), cosine("a", "b").alias("c")).collect()
    assert rows[0]["n"] == [0.6, 0.8] and math.isclose(rows[0]["c"], 0.96)
    assert rows[1]["n"] == [0.0, 0.0] and rows[1]["c"] == 0.0


def test_vector_contract_split(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [float("nan"), 1.0])],
                               "id int, v array<double>")
    good, bad = emb.split_by_contract(df, "v", 2)
    assert [r["id"] for r in good.collect()] == [1]
    reasons = {r["id"]: r["reason"] for r in bad.collect()}
    assert reasons == {2: "null_vector", 3: "empty_vector", 4: "wrong_dimension", 5: "non_finite_value"}


def test_dimension_guard_names_both_dimensions(spark):
    df = spark.createDataFrame([([0.0] * 768, [0.0] * 768, [0.0] * 768)],
                               "content_embedding array<float>, filename_embedding array<float>, combined_embedding array<float>")
    rows = dimension_guard(df, 384).collect()
    assert len(rows) == 3 and not any(r["ok"] for r in rows)
    assert all("768" in r["message"] and "384" in r["message"] and "new index" in r["message"] for r in rows)
    assert all(r["ok"] for r in dimension_guard(df, 768).collect())


def test_in_task_md5_buckets_equal_jvm_rule(spark):
    """The Arrow-side token hashing equals the JVM/SQL expression on whole documents."""
    import os

    from corpusflow.functions.hashing import token_buckets
    from corpusflow.functions.udfs import md5_text_buckets

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("driver test data not present")
    rows = spark.read.parquet(path).select("text", token_buckets("text", 256).alias("b")).collect()
    texts = [r["text"] for r in rows] + ["  Éte ÉTÉ\tx y  ", ""]
    jvm = [list(r["b"]) for r in rows] + [
        list(r[0]) for r in spark.createDataFrame([(t,) for t in texts[-2:]], "t string")
        .select(token_buckets("t", 256)).collect()]
    py = [list(b) for b in md5_text_buckets(texts, 256)]
    assert py == jvm


def test_one_bad_text_loses_its_own_vector_only(spark):
    from pyspark.sql import functions as F

    from corpusflow.operators.embedding import CallableProvider, embed_column

    def fn(text):
        if text == "t7":
            raise ValueError("poison")
        return [float(len(text)), 1.0]

    df = spark.range(100).select(F.concat(F.lit("t"), F.col("id")).alias("t")).coalesce(1)
    got = df.select("t", embed_column(F.col("t"), lambda: CallableProvider(fn, 2), 2).alias("v")).collect()
    assert [r["t"] for r in got if r["v"] is None] == ["t7"]
