"""Token counts by a map-side two-tier lookup.

A pre-token here is a run of characters without space, tab, line feed or carriage
return, less the full stops, commas and the like that end it after a letter: the
tokenizer drops white space, splits between a letter and such a mark itself, and no rule of it
(Unicode normal form, lower case, split pattern, merges, special strings) reaches
across either border, so the tokens of a text are those of its pre-tokens. Tier one is a
broadcast table of the token counts of frequent pre-tokens; misses are encoded by the
library and kept in a bounded cache of the Python worker. Pre-tokens are never shuffled.

Tier one is a cache: it is filled from a bounded sample and changes the speed, never a count.

Defined results: null and empty texts have 0 bytes and 0 tokens; any length of text is
counted whole; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import text_of

#: Rows (in expectation) that the tier-one table is fitted on, its size, and the characters of its longest entry.
SAMPLE_ROWS = 2000
FREQUENT = 50_000
MAX_CHARS = 32
#: Entries of each of the two generations of a worker's cache of misses.
CACHE = 800_000

#: A run that ends in a letter (a-z and Latin-1) and marks. The apostrophe is no such mark: the tokenizer splits at "'s".
_ENDED = re.compile("(.*[a-zß-öø-ÿ])([.,;:!?]+)", re.DOTALL)

#: Lower-case letters that every version of Unicode reads alike.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")

#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_LEVEL = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}

_ENCODERS: dict[str, _Counts] = {}


class _Counts(dict):
    """Tier two: pre-token to token count, filled on a miss from tier one or the library."""

    def __init__(self, tokenizer_json: str, frequent: dict[str, int]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.frequent, self.older = Tokenizer.from_str(tokenizer_json), frequent, {}
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, run: str) -> int:
        n = self.frequent.get(run)
        if n is None:
            n = self.older.get(run)
        if n is None:
            n = self._count(run)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        if len(run) <= 8 * MAX_CHARS:  # longer ones are counted each time, so the cache stays small
            self[run] = n
        return n

    def _count(self, run: str) -> int:
        if "<|" not in run:  # a special string is one only as it is written
            lower = run.encode("utf-8").lower().decode("utf-8")
            ended = _ENDED.fullmatch(lower)
            if ended:
                return self[ended[1]] + self[ended[2]]
            if lower != run:
                return self[lower]
            if _LETTERS.fullmatch(run):  # one word for the split pattern: straight to the merges
                return len(self.model.tokenize("".join(map(BYTE_LEVEL.__getitem__, run.encode("utf-8")))))
        return len(self.tokenizer.encode(run, add_special_tokens=False).ids)


def runs(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _counter(tokenizer_json: str, frequent: dict[str, int]) -> _Counts:
    """The worker's cache; it outlives a task. Counts depend on the tokenizer alone."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _Counts(tokenizer_json, frequent)
    return _ENCODERS[key]


def _frequent_runs(docs: DataFrame, text_col: str, tokenizer_json: str) -> dict[str, int]:
    """Counts of the most frequent pre-tokens among SAMPLE_ROWS rows. Each task passes on
    its FREQUENT commonest at most; the rest of the work stays in the tasks."""
    from tokenizers import Tokenizer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(p for p in runs(text) if 0 < len(p) <= MAX_CHARS)
        top = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_pydict({"p": pa.array([p for p, _ in top], pa.string()),
                                          "n": pa.array([n for _, n in top], pa.int64())})

    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select(text_of(text_col).alias("_cf_text")).sample(share, seed=1)
    top = (sample.mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "p").limit(FREQUENT).collect())
    tokenizer = Tokenizer.from_str(tokenizer_json)
    found = sorted({r["p"] for r in top})
    return {p: len(e.ids) for p, e in zip(found, tokenizer.encode_batch(found, add_special_tokens=False))}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per document: bytes, tokens, and whether the tokens exceed ``limit``.

    ``tokenizer_path`` is a ``tokenizers`` JSON file that drops white space; it is read on the driver (a fixed
    file of about 2 MB) and sent to the workers, so executors need no copy.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    frequent = _frequent_runs(docs, text_col, tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, frequent))
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(*shared.value)
        get = counts.__getitem__
        for batch in batches:
            ids, texts, sizes = batch.columns
            n = [sum(map(get, runs(t))) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("_cf_id"), text_of(text_col).alias("_cf_text"),
                       F.octet_length(text_of(text_col)).cast("long").alias("_cf_n"))
    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
