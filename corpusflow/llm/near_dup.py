"""Near-duplicate documents: BagMinHash signatures, banding, verified multiset overlap.

Two documents are linked if the weighted Jaccard similarity of their multisets of SHINGLE-word
runs is at least 4/5; a class is a connected component of links. Texts with the same words
are one vertex of the graph, so copies cost one row each and no pairs.

1. Every text gets BANDS keys of ROWS signature components each; vertices that share a key
   are candidates. A pair at the threshold is missed with probability
   (1 - 0.8**5)**32 < 3e-6, nearer pairs far less often.
2. Each key elects a random member as its pivot. A vertex is verified against
   the few pivots that it shares most keys with, which joins most of each group.
   Numbers of shingles rule out pairs of too unlike lengths before any text is fetched.
3. What then still lies in different components under one key is verified without exception: pairs of
   small keys one by one, large keys in blocks: vertices outside the key's largest
   component, some hundred at a time, against some hundred members at a time, by a
   matrix product over their common shingles. Blocks give back links, not pairs.

Verification counts common occurrences of shingles of the whole texts.

Defined results: null and empty texts, and texts without words, are in no class but their own; a text with fewer
words than a shingle is one shingle; repeated rows are copies; a class is named by its smallest id (null
if all its ids are null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import bagminhash as bag
from corpusflow.llm.common import bounded_batches, text_key, text_of, word_bytes, written
from corpusflow.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 5
#: Similarity threshold as a fraction, so that the comparison is exact.
NEAR = (4, 5)
PIVOTS = 3
#: Keys of up to this many members give pairs, larger ones blocks.
SMALL_KEY = 16
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Broadcast the ids of the texts to fetch up to this many.
MAX_BROADCAST_IDS = 1_000_000
#: Shingles that are hashed into signatures together in a task.
_BATCH_WORDS = 300_000
_COLUMNS = 4096
#: Multisets that a verifying task remembers.
HELD_BYTES = 16 << 20


def near(common: int, a: int, b: int) -> bool:
    """Whether ``common`` of the occurrences in two multisets of sizes a and b reaches the threshold."""
    return common * NEAR[1] >= (a + b - common) * NEAR[0]


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, text key, vertex and check (halves of a 128-bit hash of the words; null without words),
    number of shingles, band keys."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def sign_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys, texts = batch.columns
        start = 0
        while start < len(texts):
            found, vertices, checks, total, end = [], [], [], 0, start
            while end < len(texts) and (end == start or total < _BATCH_WORDS):
                words = word_bytes(texts[end].as_py())
                both = xxhash.xxh3_128_intdigest(b" ".join(words))
                vertices.append((both & (1 << 64) - 1) - (1 << 63) if words else None)
                checks.append((both >> 64) - (1 << 63) if words else None)
                found.append(bag.shingles(bag.hashes_of(words), SHINGLE))
                total += len(words)
                end += 1
            with_words = [f for f in found if len(f)]
            bands = iter(bag.band_keys(bag.signatures(with_words, BANDS * ROWS), BANDS).tolist() if with_words else [])
            yield pa.RecordBatch.from_arrays(
                [ids[start:end], keys[start:end], pa.array(vertices, pa.int64()), pa.array(checks, pa.int64()),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([next(bands) if len(f) else [] for f in found], pa.list_(pa.int64()))],
                names=["id", "key", "vertex", "check", "shingles", "bands"])
            start = end

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield from sign_batch(batch)
        finally:
            bag.forget()

    rows = docs.select(F.col(id_col).alias("_cf_id"), text_key(text_col).alias("_cf_key"),
                       text_of(text_col).cast("binary").alias("_cf_text"))
    return rows.mapInArrow(sign, f"id {kind}, key long, vertex long, check long, shingles long, bands array<long>")


def _told_apart(signed: DataFrame) -> DataFrame:
    """Different words under one 64-bit vertex get vertices of their own, by the other half of their hash."""
    met = signed.groupBy("vertex").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi")
    met = written(met.select(F.col("vertex").alias("_cf_met")), "collisions")
    if met.isEmpty():
        return signed
    own = F.when(F.col("_cf_met").isNotNull(), F.xxhash64("vertex", "check")).otherwise(F.col("vertex"))
    return written(signed.join(met, F.col("vertex") == F.col("_cf_met"), "left").withColumn("vertex", own).drop("_cf_met"), "signed")


def _alike_in_size(a: str, b: str):
    """Whether two numbers of shingles allow the threshold."""
    return F.least(a, b) * NEAR[1] >= F.greatest(a, b) * NEAR[0]


def _texts(docs: DataFrame, id_col: str, text_col: str, signed: DataFrame, vertices: DataFrame) -> DataFrame:
    """``vertex, text`` for the given vertices, each from one of its rows."""
    chosen = (signed.join(vertices, "vertex", "left_semi").groupBy("vertex")
              .agg(F.min(F.xxhash64("id", "key")).alias("_cf_row")))
    chosen = written(chosen, "chosen")
    if chosen.count() <= MAX_BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    rows = docs.select(F.xxhash64(F.col(id_col), text_key(text_col)).alias("_cf_row"), text_of(text_col).cast("binary").alias("text"))
    found = rows.join(chosen, "_cf_row").select("vertex", "text")
    # Repeated rows bring one text several times; any of them will do.
    return written(found.dropDuplicates(["vertex"]), "texts")


class _Multisets:
    """Shingle multisets of the last texts asked for, of HELD_BYTES together."""

    def __init__(self, most: int | None = None):
        self.most, self.size, self.held = HELD_BYTES if most is None else most, 0, {}

    def __call__(self, vertex: int, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray, int]:
        if vertex not in self.held:
            shingles = bag.shingles(bag.word_hashes(text.as_py()), SHINGLE)
            found = (*np.unique(shingles, return_counts=True), len(shingles))
            self.size += found[0].nbytes + found[1].nbytes
            while self.held and self.size > self.most:
                old = self.held.pop(next(iter(self.held)))
                self.size -= old[0].nbytes + old[1].nbytes
            self.held[vertex] = found
        return self.held[vertex]


def _verified_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are near. The texts of ``a`` come sorted, so each is read once."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiset = _Multisets()
        try:
            for batch in batches:
                kept = []
                for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                    x, y = multiset(a, text_a), multiset(b, text_b)
                    kept.append(near(bag.overlap(x, y), x[2], y[2]))
                mask = pa.array(kept, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])
        finally:
            bag.forget()

    left = texts.select(F.col("vertex").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("vertex").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(verify, "a long, b long")


def _elements(text: bytes) -> np.ndarray:
    """The multiset as a set: the n-th occurrence of a shingle is an element of its own."""
    values, counts = np.unique(bag.shingles(bag.word_hashes(text), SHINGLE), return_counts=True)
    level = np.arange(counts.sum(), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
    return bag.mix(np.repeat(values, counts) + level * np.uint64(0xD1342543DE82EF95))


def common_elements(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every left with every right set, by matrix products over the elements found on both sides."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.int64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        hit = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == flat) if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    (la, lo), (ra, ro) = places(left), places(right)
    for start in range(0, len(shared), _COLUMNS):
        x = np.zeros((len(left), min(_COLUMNS, len(shared) - start)), np.float32)
        y = np.zeros((len(right), x.shape[1]), np.float32)
        for table, at, owner in ((x, la, lo), (y, ra, ro)):
            lo_, hi_ = np.searchsorted(at, [start, start + x.shape[1]])
            table[owner[lo_:hi_], at[lo_:hi_] - start] = 1
        common += np.rint(x @ y.T).astype(np.int64)
    return common


def _verified_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components under large keys. ``members``: key, vertex, component, main (the key's largest component), n."""
    sized = members.join(texts.select("vertex", "text"), "vertex")
    bytes_of = members.join(texts.select("vertex", F.octet_length("text").alias("size")), "vertex")
    cuts = bytes_of.groupBy("key").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(BLOCK_ROWS)), F.sum("size") / F.lit(float(BLOCK_BYTES)))).alias("_cf_right"),
        F.ceil(F.greatest(F.sum(F.when(F.col("component") != F.col("main"), 1).otherwise(0)) / F.lit(float(BLOCK_ROWS)),
                          F.sum(F.when(F.col("component") != F.col("main"), F.col("size")).otherwise(0)) / F.lit(float(BLOCK_BYTES))))
        .alias("_cf_left"))
    sized = sized.join(cuts, "key").withColumn("_cf_place", F.xxhash64("vertex", F.lit(7)))
    own_right = F.pmod(F.col("_cf_place"), F.col("_cf_right"))
    own_left = F.pmod(F.col("_cf_place"), F.col("_cf_left"))
    # A member meets every block of the other side once: on the right all of them, on the left those outside the main component.
    right = sized.select("key", "vertex", "component", "text", own_right.alias("j"), F.lit(1).alias("side"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cf_left") - 1)).alias("i"))
    left = sized.filter("component <> main").select(
        "key", "vertex", "component", "text", own_left.alias("i"), F.lit(0).alias("side"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cf_right") - 1)).alias("j"))
    blocks = left.select("key", "i", "j", "side", "vertex", "component", "text").unionByName(
        right.select("key", "i", "j", "side", "vertex", "component", "text"))

    def verify(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
        out = []
        if all(sides):
            sets = [[_elements(r["text"]) for r in side] for side in sides]
            common = common_elements(*sets)
            size = [np.array([len(s) for s in side], np.int64) for side in sets]
            reached = common * NEAR[1] >= (size[0][:, None] + size[1][None] - common) * NEAR[0]
            for a, b in zip(*np.nonzero(reached)):
                out.append((sides[0][a]["vertex"], sides[1][b]["vertex"], sides[0][a]["component"], sides[1][b]["component"]))
        # One link between two components is enough.
        links = {(min(c, d), max(c, d)): (a, b) for a, b, c, d in out if c != d}
        return pa.table({"a": pa.array([a for a, _ in links.values()], pa.int64()),
                         "b": pa.array([b for _, b in links.values()], pa.int64())})

    return blocks.groupBy("key", "i", "j").applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``class_id``, the smallest id of its class, and ``class_size``, its documents.
    ``text_key``, ``vertex`` and ``class_key`` (null without words) come along."""
    bounded_batches(docs.sparkSession)
    signed = _told_apart(written(_signed(docs, id_col, text_col), "signed"))
    keys = signed.filter(F.col("vertex").isNotNull()).select("vertex", "shingles", F.explode("bands").alias("key")).distinct()
    # The member with the smallest hash under a key is its pivot: another one under each key.
    pivots = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", "vertex"), "vertex", "shingles")).alias("p"))
              .filter("n > 1").select("key", "n", F.col("p.vertex").alias("pivot"), F.col("p.shingles").alias("pivot_shingles")))
    members = written(keys.join(pivots, "key"), "members")
    texts = _texts(docs, id_col, text_col, signed, members.select("vertex").distinct())

    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")  # at most BANDS rows each
    first = (members.filter("vertex <> pivot").filter(_alike_in_size("shingles", "pivot_shingles")).groupBy(F.col("vertex").alias("a"), F.col("pivot").alias("b"))
             .agg(F.count(F.lit(1)).alias("shared")).withColumn("_cf_rank", F.row_number().over(best))
             .filter(F.col("_cf_rank") <= PIVOTS).select("a", "b"))
    tried = written(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "tried")
    links = written(_verified_pairs(tried, texts), "near")
    names = components(links)

    named = (members.join(names.withColumnRenamed("node", "vertex"), "vertex", "left")
             .select("key", "n", "vertex", "shingles", F.coalesce("component", "vertex").alias("component")))
    spread = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "component")).alias("top"))
    open_keys = spread.filter("parts > 1").select("key", F.col("top.component").alias("main"))
    rest = written(named.join(open_keys, "key"), "open")
    small, large = rest.filter(F.col("n") <= SMALL_KEY), rest.filter(F.col("n") > SMALL_KEY)
    x, y = small.alias("x"), small.alias("y")
    pairs = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.vertex") > F.col("y.vertex"))
                    & (F.col("x.component") != F.col("y.component")) & _alike_in_size("x.shingles", "y.shingles"))
             .select(F.col("x.vertex").alias("a"), F.col("y.vertex").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    more = written(_verified_pairs(pairs, texts).unionByName(_verified_blocks(large, texts)), "near")

    stars = names.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionByName(more)).withColumnRenamed("node", "vertex")
    placed = (signed.select("id", "key", "vertex").join(final, "vertex", "left")
              .withColumn("_cf_class", F.coalesce("component", "vertex")))
    classes = (placed.filter(F.col("_cf_class").isNotNull()).groupBy("_cf_class")
               .agg(F.min("id").alias("_cf_name"), F.count(F.lit(1)).alias("_cf_size"))
               .withColumnRenamed("_cf_class", "_cf_of"))
    out = placed.join(classes, F.col("_cf_class") == F.col("_cf_of"), "left")
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), "vertex", F.col("_cf_class").alias("class_key"),
                      F.when(F.col("vertex").isNull(), F.col("id")).otherwise(F.col("_cf_name")).alias("class_id"),
                      F.coalesce("_cf_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id. Documents without words stay.
    Rows that repeat id and text are one document."""
    found = near_duplicates(docs, id_col, text_col)
    row = F.xxhash64(F.col(id_col), F.col("text_key"))
    named = found.filter(F.col("vertex").isNotNull()).groupBy(F.col("class_key")).agg(
        F.min(F.struct(F.col(id_col), F.col("text_key"))).alias("first"))
    kept = named.select(F.xxhash64(f"first.{id_col}", "first.text_key").alias("_cf_kept"))
    kept = kept.unionByName(found.filter(F.col("vertex").isNull()).select(row.alias("_cf_kept")).distinct())
    keyed = docs.withColumn("_cf_row", F.xxhash64(F.col(id_col), text_key(text_col)))
    return (keyed.join(kept, F.col("_cf_row") == F.col("_cf_kept"), "left_semi").dropDuplicates(["_cf_row"])
            .select(docs.columns))
