"""Evaluation corpus source and the report sink.

Corpus file: ``{"documents": [{id, filename, content}], "queries": [{text,
expected, history: [...]}]}`` read with ``multiLine`` JSON and
exploded into two DataFrames. A history item is a list ``[user, assistant]`` or an object with ``user`` (or
``message``) and ``assistant`` (or ``response``); other items, and lists of fewer than two, are no history. The report is one row of nested structs written
as JSON (one small file: the report is a single row by construction).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType([
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("filename", T.StringType()),
        T.StructField("content", T.StringType())]))),
    T.StructField("queries", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("expected", T.StringType()),
        T.StructField("history", T.ArrayType(T.StringType()))]))),  # each item as its JSON text
])


def history_pairs(items) -> Column:
    """JSON texts of history items → array of [user, assistant]."""
    def pair(item: Column) -> Column:
        listed, named = F.from_json(item, "array<string>"), F.from_json(item, "user string, message string, assistant string, response string")
        user, answer = (F.coalesce(F.nullif(named[a], F.lit("")), named[b], F.lit("")) for a, b in (("user", "message"), ("assistant", "response")))
        return (F.when(item.startswith("[") & (F.size(listed) >= 2), F.array(F.coalesce(listed[0], F.lit("")), F.coalesce(listed[1], F.lit(""))))
                .when(item.startswith("{"), F.array(user, answer)))

    return F.filter(F.transform(items, pair), lambda p: p.isNotNull())


def read_eval_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents(pos, id, filename, content), queries(query_id, text, expected, history))."""
    raw = spark.read.schema(CORPUS_SCHEMA).option("multiLine", "true").json(path)
    docs = raw.select(F.posexplode("documents").alias("pos", "d")).select(
        F.col("pos").cast("bigint").alias("pos"), "d.id", "d.filename", "d.content")
    queries = raw.select(F.posexplode("queries").alias("query_id", "q")).select(
        F.col("query_id").cast("bigint").alias("query_id"), "q.text", "q.expected",
        F.coalesce(history_pairs(F.col("q.history")), F.array().cast("array<array<string>>")).alias("history"))
    return docs, queries


def history_as_turns(queries: DataFrame) -> DataFrame:
    """Inline ``[[user, assistant], ...]`` histories → conversation rows
    (conv_id, turn, role, text), the current question as the last user turn."""
    pairs = queries.select("query_id", "text", F.posexplode("history").alias("i", "pair"))
    user = pairs.select(F.col("query_id").alias("conv_id"), (F.col("i") * 2).cast("bigint").alias("turn"),
                        F.lit("user").alias("role"), F.element_at("pair", 1).alias("text"))
    asst = pairs.select(F.col("query_id").alias("conv_id"), (F.col("i") * 2 + 1).cast("bigint").alias("turn"),
                        F.lit("assistant").alias("role"), F.try_element_at("pair", F.lit(2)).alias("text"))
    current = queries.select(F.col("query_id").alias("conv_id"), (F.size("history") * 2).cast("bigint").alias("turn"),
                             F.lit("user").alias("role"), "text")
    return user.unionByName(asst).unionByName(current)


def write_report(report: DataFrame, path: str, sections: dict | None = None) -> None:
    """Write the one-row report as one JSON value with sorted keys, indented by two. ``sections`` are added beside the
    report's columns (provider, measured times and the like; plain Python values). ``coalesce(1)`` is safe: one row."""
    row = report.first()
    value = json.dumps({**(row.asDict(recursive=True) if row else {}), **(sections or {})}, indent=2, sort_keys=True, ensure_ascii=False)
    report.sparkSession.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)
