"""License scan: an exact set-similarity join of text blocks with license templates.

A text is cut into blocks of 2 * STRIDE words, one starting every STRIDE words, so any
passage of up to STRIDE words lies whole in a block. A block meets a template if the
share of the template's distinct words that it holds reaches the template's threshold.
Longer templates (whole license texts) meet longer blocks: the stride of a template is the smallest of STRIDE,
2 * STRIDE, 4 * STRIDE, ... that holds its words.

The join is exact. Words are ordered by how many documents hold them, rarest first, over
the whole corpus. A template that needs o of its t words must share one of its t - o + 1
rarest with such a block (prefix filter); a block needs at least o template words, and the
shared word must be among its own size - o + 1 rarest (length and prefix filter); and what
stands behind the shared word in both must still allow o matches (positional filter). Only
those words of a block are exploded, and only surviving pairs are verified.

Templates that are phrases need all words (threshold 1), and then the places where the
phrase's words stand consecutively are located in the block that the place starts in.

Defined results: null and empty texts have no words, labels or places, and score 0;
a long text is just more blocks; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import text_of, words_of

STRIDE = 64


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False
    threshold: float = 0.8

    @property
    def words(self) -> list[str]:
        return re.findall(r"[0-9a-z]+", self.text.lower())

    @property
    def needed(self) -> int:
        size = len(set(self.words))
        return size if self.phrase else max(1, math.ceil(self.threshold * size - 1e-9))


# The phrases of the scan's contract.
PHRASES = [
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
]

# Opening sentences of public licenses and their usual notices.
NOTICES = [
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "General Public License as published by the Free Software Foundation"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
                         "with the License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial International License"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def _word_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each template word, over the whole corpus: one row per template word."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_intersect(known, words_of(text_of(text_col)))).alias("_cf_word"))
    return {r["_cf_word"]: r["count"] for r in held.groupBy("_cf_word").count().collect()}


def stride_of(template: Template, stride: int = STRIDE) -> int:
    while stride < len(template.words):
        stride *= 2
    return stride


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", stride: int = STRIDE) -> DataFrame:
    """One row per document: ``n_words``; ``places`` (label and first word of each phrase place);
    ``labels`` met by any template; ``score``, the highest share among the templates met."""
    templates = PHRASES + NOTICES if templates is None else templates
    if any(not t.words for t in templates):
        raise ValueError("templates need words")
    strides = [stride_of(t, stride) for t in templates]
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = _word_frequencies(docs, text_col, vocabulary)
    ranked = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}

    # Prefix index: a row per rare word of each template. Its size is that of the template list.
    index = []
    for k, t in enumerate(templates):
        ordered = sorted(set(t.words), key=rank.__getitem__)
        for i, w in enumerate(ordered[:len(ordered) - t.needed + 1]):
            index.append((w, k, t.label, t.phrase, t.words, ordered, i, t.needed, strides[k]))
    index = docs.sparkSession.createDataFrame(
        index, "_cf_iw string, _cf_t int, _cf_label string, _cf_phrase boolean, _cf_twords array<string>, "
               "_cf_ordered array<string>, _cf_i int, _cf_needed int, _cf_istride int")
    # Blocks of each stride in use, and how many template words a block must hold to meet any template of its stride.
    least = {n: min(t.needed for t, own in zip(templates, strides) if own == n) for n in sorted(set(strides))}
    starts = ", ".join(f"transform(sequence(0, size(_cf_words) - 1, {n}), a -> named_struct('stride', {n}, 'at', a))" for n in least)
    fewest = "CASE " + " ".join(f"WHEN _cf_stride = {n} THEN {few}" for n, few in least.items()) + " END"

    blocks = (docs.select(F.col(id_col).alias("_cf_id"), words_of(text_of(text_col)).alias("_cf_words"))
              .withColumn("_cf_row", F.monotonically_increasing_id())
              # -1 marks the document itself, so that documents without a match stay.
              .withColumn("_cf_start", F.explode(F.expr(
                  f"CASE WHEN size(_cf_words) > 0 THEN concat(array(named_struct('stride', 0, 'at', -1)), {starts}) "
                  "ELSE array(named_struct('stride', 0, 'at', -1)) END")))
              .withColumns({"_cf_at": F.col("_cf_start.at"), "_cf_stride": F.col("_cf_start.stride")}))
    known = F.array(*[F.lit(w) for w in ranked])
    blocks = blocks.select("_cf_row", "_cf_id", F.size("_cf_words").cast("long").alias("_cf_n"), "_cf_at", "_cf_stride",
                           F.expr("CASE WHEN _cf_at >= 0 THEN slice(_cf_words, _cf_at + 1, 2 * _cf_stride) END").alias("_cf_block"))
    blocks = blocks.withColumn("_cf_held", F.when(F.col("_cf_at") >= 0, F.array_intersect(known, F.col("_cf_block"))))
    prefix = F.expr(f"CASE WHEN _cf_at < 0 THEN array('') WHEN size(_cf_held) >= {fewest} "
                    f"THEN slice(_cf_held, 1, size(_cf_held) - {fewest} + 1) ELSE array() END")
    probes = blocks.select("*", F.posexplode(prefix).alias("_cf_j", "_cf_word"))
    pairs = probes.join(F.broadcast(index), (F.col("_cf_word") == F.col("_cf_iw")) & (F.col("_cf_stride") == F.col("_cf_istride")), "left")
    fits = F.expr("size(_cf_held) >= _cf_needed AND _cf_j <= size(_cf_held) - _cf_needed AND "
                  "1 + least(size(_cf_ordered) - 1 - _cf_i, size(_cf_held) - 1 - _cf_j) >= _cf_needed")
    pairs = pairs.filter((F.col("_cf_at") < 0) | (F.col("_cf_iw").isNotNull() & fits))

    share = F.size(F.array_intersect("_cf_ordered", "_cf_held"))
    met = pairs.withColumn("_cf_share", F.when(F.col("_cf_at") >= 0, share)).withColumn(
        "_cf_starts", F.expr("""CASE WHEN _cf_phrase AND _cf_share >= _cf_needed THEN
            filter(transform(sequence(0, least(_cf_stride, size(_cf_block)) - 1),
                             i -> CASE WHEN slice(_cf_block, i + 1, size(_cf_twords)) = _cf_twords THEN _cf_at + i END),
                   s -> s IS NOT NULL) END"""))
    # A phrase is met where it stands; another template where enough of its words are in the block.
    is_met = F.when(F.col("_cf_phrase"), F.size("_cf_starts") > 0).otherwise(F.col("_cf_share") >= F.col("_cf_needed"))
    rows = met.groupBy("_cf_row").agg(
        F.first("_cf_id").alias("_cf_id"), F.first("_cf_n").alias("_cf_n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.expr(
            "transform(_cf_starts, s -> named_struct('word', s, 'label', _cf_label, 'template', _cf_t))"))))).alias("_cf_places"),
        F.array_sort(F.collect_set(F.when(is_met, F.col("_cf_label")))).alias("_cf_labels"),
        F.max(F.when(is_met, F.col("_cf_share") / F.size("_cf_ordered"))).alias("_cf_score"))
    return rows.select(F.col("_cf_id").alias(id_col), F.col("_cf_n").alias("n_words"), F.col("_cf_places").alias("places"),
                       F.col("_cf_labels").alias("labels"), F.coalesce("_cf_score", F.lit(0.0)).alias("score"))
