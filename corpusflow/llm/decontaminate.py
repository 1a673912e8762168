"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is
probed by every training token window; hits are verified word by word.

Words are those of ``common.words_of``. A window is ``ngram`` consecutive words of
an item; an item with fewer words, but not none, is one window. A document word
inside any occurrence of a window is hit.

Defined results: null and empty texts have no words and are never contaminated; an
item without words has no windows; repeated items count once per id; an item whose
id is null hits words but is not listed; repeated documents get a row each; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import text_key, text_of, words_of, written

#: Broadcast the window table up to this measured size; beyond it hashes are shuffled, and the words of hits fetched.
MAX_BROADCAST_BYTES = 64 << 20


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      ngram: int = 13) -> DataFrame:
    """Distinct windows by hash: ``_cf_hash``, ``_cf_cands`` (words and sorted item ids)."""
    words = (items.select(F.col(id_col).cast("string").alias("_cf_item"),
                          words_of(text_of(text_col)).alias("_cf_words"))
             .filter(F.size("_cf_words") > 0)
             .withColumn("_cf_len", F.least(F.lit(ngram), F.size("_cf_words"))))
    starts = words.withColumn("_cf_at", F.explode(F.expr("sequence(1, size(_cf_words) - _cf_len + 1)")))
    windows = (starts.select("_cf_item", F.expr("slice(_cf_words, _cf_at, _cf_len)").alias("_cf_window"))
               .groupBy("_cf_window").agg(F.array_sort(F.collect_set("_cf_item")).alias("_cf_items")))
    return (windows.groupBy(F.xxhash64("_cf_window").alias("_cf_hash"))
            .agg(F.collect_list(F.struct("_cf_window", "_cf_items")).alias("_cf_cands")))


def _scan_positions(lengths: list[int]) -> Column:
    """One code per window of a document, ``16 * start + length``, and -16 as the marker
    that keeps documents without any window in the result."""
    parts = [F.array(F.lit(-16).cast("long"))]
    for n in lengths:
        parts.append(F.expr(f"CASE WHEN size(_cf_words) >= {n} "
                            f"THEN sequence({n}L, (size(_cf_words) - {n}) * 16L + {n}L, 16L) "
                            "ELSE array() END").cast("array<bigint>"))
    return F.concat(*parts)


def _spots(texts: DataFrame, codes: Column, *kept: str) -> DataFrame:
    """A row per code: where its window starts, its length, and its words (null for the marker)."""
    return texts.withColumn("_cf_code", F.explode(codes)).select(
        "_cf_row", *kept, F.size("_cf_words").cast("long").alias("_cf_n"),
        F.shiftright("_cf_code", 4).cast("int").alias("_cf_at"),
        F.col("_cf_code").bitwiseAND(15).cast("int").alias("_cf_dlen"), "_cf_code",
        F.expr("CASE WHEN _cf_code >= 0 THEN "
               "slice(_cf_words, cast(shiftright(_cf_code, 4) + 1 as int), cast(_cf_code & 15 as int)) END").alias("_cf_have"))


def _verified(found: DataFrame) -> list[Column]:
    """Hits and items of a document's probes ``found``, whose words are compared with those of the windows of their hash."""
    verified = F.size("_cf_hit") > 0
    return [F.sort_array(F.collect_list(F.when(verified, F.struct(
                F.col("_cf_at").alias("start"), (F.col("_cf_at") + F.col("_cf_dlen")).alias("end"))))).alias("_cf_hits"),
            F.flatten(F.collect_set(F.when(verified, F.flatten(F.expr("transform(_cf_hit, c -> c._cf_items)")))))
            .alias("_cf_items")]


def _hits_broadcast(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits of every row: each window of a text looks its hash up in the broadcast set."""
    probe = _spots(texts, _scan_positions(lengths), "_cf_id", "_cf_key")
    probe = probe.withColumn("_cf_dhash", F.when(F.col("_cf_at") >= 0, F.xxhash64("_cf_have")).otherwise(F.col("_cf_row")))
    found = probe.join(F.broadcast(windows), F.col("_cf_dhash") == F.col("_cf_hash"), "left")
    # Only markers and windows whose hash is in the set go on; then their words are compared.
    found = (found.filter((F.col("_cf_at") < 0) | F.col("_cf_hash").isNotNull())
             .withColumn("_cf_hit", F.expr("CASE WHEN _cf_at >= 0 THEN filter(_cf_cands, c -> c._cf_window = _cf_have) END")))
    return found.groupBy("_cf_row").agg(
        F.first("_cf_id").alias("_cf_id"), F.first("_cf_key").alias("_cf_key"), F.first("_cf_n").alias("_cf_n"), *_verified(found))


def _hits_shuffled(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a window set of any size. A window of a text is shuffled as hash, row and place (24 bytes);
    words are fetched, by row, only for the places whose hash is in the set."""
    texts, windows = written(texts, "decontaminate-words"), written(windows, "decontaminate-windows")
    probe = _spots(texts, F.filter(_scan_positions(lengths), lambda code: code >= 0)).select(
        "_cf_row", "_cf_code", F.xxhash64("_cf_have").alias("_cf_dhash"))
    held = probe.join(windows.select("_cf_hash"), F.col("_cf_dhash") == F.col("_cf_hash"), "left_semi")
    places = held.groupBy(F.col("_cf_row").alias("_cf_hrow")).agg(F.collect_list("_cf_code").alias("_cf_codes"))
    spots = _spots(texts.join(places, F.col("_cf_row") == F.col("_cf_hrow")), F.col("_cf_codes")).withColumn("_cf_dhash", F.xxhash64("_cf_have"))
    found = (spots.join(windows, F.col("_cf_dhash") == F.col("_cf_hash"))
             .withColumn("_cf_hit", F.expr("filter(_cf_cands, c -> c._cf_window = _cf_have)")))
    hits = found.groupBy(F.col("_cf_row").alias("_cf_hrow")).agg(*_verified(found))
    none = {"_cf_hits": "array<struct<start:int,end:int>>", "_cf_items": "array<string>"}
    return texts.join(hits, F.col("_cf_row") == F.col("_cf_hrow"), "left").select(
        "_cf_row", "_cf_id", "_cf_key", F.size("_cf_words").cast("long").alias("_cf_n"),
        *[F.coalesce(F.col(c), F.array().cast(kind)).alias(c) for c, kind in none.items()])


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", ngram: int = 13,
                       min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """One row per document: counts, hit spans (``start``, ``end`` in words, end
    exclusive, merged), item ids, and whether hits reach ``min_share`` of the words."""
    if not 1 <= ngram <= 15:
        raise ValueError("ngram must be between 1 and 15")
    windows = benchmark_windows(items, item_id_col, item_text_col, ngram)
    size = windows.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.expr("transform(_cf_cands, c -> size(c._cf_window))"))))).alias("lengths"),
        F.sum(F.expr("aggregate(_cf_cands, 0L, (n, c) -> n + 64 + 40 * size(c._cf_window) + 40 * size(c._cf_items))"))
        .alias("bytes")).first()
    lengths, measured = size["lengths"] or [], size["bytes"] or 0
    texts = (docs.select(F.col(id_col).alias("_cf_id"), text_key(text_col).alias("_cf_key"),
                         words_of(text_of(text_col)).alias("_cf_words"))
             .withColumn("_cf_row", F.monotonically_increasing_id()))
    rows = (_hits_broadcast if measured <= MAX_BROADCAST_BYTES else _hits_shuffled)(texts, windows, lengths)
    # Sorted hits merge into disjoint spans: a hit opens a span only where it starts beyond all earlier ends.
    merged = F.expr("""
        aggregate(_cf_hits,
          named_struct('done', cast(array() as array<struct<start:int,end:int>>), 'start', -1, 'end', -1),
          (a, h) -> CASE
            WHEN h.start > a.end THEN named_struct(
              'done', CASE WHEN a.end >= 0 THEN concat(a.done, array(named_struct('start', a.start, 'end', a.end))) ELSE a.done END,
              'start', h.start, 'end', h.end)
            ELSE named_struct('done', a.done, 'start', a.start, 'end', greatest(a.end, h.end)) END,
          a -> CASE WHEN a.end >= 0 THEN concat(a.done, array(named_struct('start', a.start, 'end', a.end))) ELSE a.done END)""")
    out = (rows.withColumn("_cf_spans", merged)
           .withColumn("_cf_items", F.array_sort(F.array_distinct("_cf_items")))
           .withColumn("_cf_nhit", F.expr("aggregate(_cf_spans, 0L, (n, s) -> n + s.end - s.start)")))
    num, den = min_share
    return out.select(
        F.col("_cf_id").alias(id_col), F.col("_cf_key").alias("text_key"), F.col("_cf_n").alias("n_words"),
        F.col("_cf_nhit").alias("n_hit"), F.size("_cf_items").cast("long").alias("n_items"),
        F.col("_cf_items").alias("items"), F.col("_cf_spans").alias("spans"),
        ((F.col("_cf_nhit") > 0) & (F.col("_cf_nhit") * den >= F.col("_cf_n") * num)).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        mode: str = "document", **params) -> DataFrame:
    """``docs`` without its contaminated documents (``mode="document"``), or with the hit
    spans cut out of their texts (``mode="span"``). All other columns stay as they are."""
    found = find_contamination(docs, items, id_col, text_col, **params)
    same = (F.col(id_col).eqNullSafe(F.col("_cf_fid"))) & (text_key(text_col) == F.col("_cf_fkey"))
    if mode == "document":
        bad = found.filter("contaminated").select(F.col(id_col).alias("_cf_fid"), F.col("text_key").alias("_cf_fkey"))
        return docs.join(bad, same, "left_anti")
    if mode != "span":
        raise ValueError("mode must be 'document' or 'span'")
    cut = (found.filter(F.size("spans") > 0)
           .select(F.col(id_col).alias("_cf_fid"), F.col("text_key").alias("_cf_fkey"), F.col("spans").alias("_cf_cut"))
           .dropDuplicates(["_cf_fid", "_cf_fkey"]))
    # Each piece is one word with the separators before it; piece i belongs to word i.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
                                                         r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    kept = F.expr("array_join(filter(_cf_pieces, (p, i) -> NOT exists(_cf_cut, s -> i >= s.start AND i < s.end)), '')")
    joined = docs.join(cut, same, "left").withColumn("_cf_pieces", F.when(F.col("_cf_cut").isNotNull(), pieces))
    return joined.withColumn(text_col, F.when(F.col("_cf_cut").isNotNull(), kept).otherwise(F.col(text_col))).select(docs.columns)
