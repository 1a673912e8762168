import random
import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


#: Nulls in any column, empty and wordless texts, a long one, non-ASCII, ties and repeated rows.
EDGES = [
    (1, "Plain words, nothing else.", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (4, " .,;\n!? ", None),
    (None, "A text without an id ÀÉ été 123", "b"),
    (None, None, None),
    (5, prose(5, 30_000), "a"),
    (6, prose(6, 80), "c"),
    (6, prose(6, 80), "c"),
    (7, prose(6, 80), "c"),
    (8, "ÀÉ 漢字 𝒳𝒴 naïve ﬁ", "c"),
    (9, "one", "c"),
]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table with extra columns whose names clash with those that operators use."""
    def make(rows, schema="doc_id long, text string, source string"):
        df = spark.createDataFrame(rows, schema)
        for extra in ("id", "key", "vertex", "words", "shard", "slot", "size", "_cf_id", "_cf_row", "_cf_words", "_cf_text", "label"):
            if extra not in df.columns:
                df = df.selectExpr("*", f"'x' AS `{extra}`")
        return df

    return make


@pytest.fixture(scope="session")
def edges(frame):
    return frame(EDGES)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
