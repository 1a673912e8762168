import random

import pytest
from pyspark.sql import functions as F

import spec
from corpusflow.functions import text as tx

# Every code point Python's str.split()/strip() treat as whitespace.
PY_WS = [chr(c) for c in range(0x110000) if chr(c).isspace()]
EXTRA = ["​", "é", "𝔘", "a", "b", "x", " ", "\n", "\r\n"]


def _random_strings(n, seed=7, max_len=30):
    rnd = random.Random(seed)
    alphabet = PY_WS + EXTRA * 3
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len))) for _ in range(n)]


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", fn(F.col("s")).alias("o")).collect()
    return {r["i"]: r["o"] for r in rows}


def test_whitespace_set_is_python_set():
    assert len(PY_WS) == 29


def test_compact_matches_python(spark):
    values = _random_strings(400) + [None, "", "   ", "a　b\x1cc"]
    got = _eval(spark, values, tx.compact)
    for i, v in enumerate(values):
        assert got[i] == spec.compact(v), repr(v)


def test_words_matches_str_split(spark):
    values = _random_strings(400, seed=3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r["i"]: r["w"] for r in df.select("i", tx.words("s").alias("w")).collect()}
    for i, v in enumerate(values):
        assert got[i] == v.split(), repr(v)


@pytest.mark.parametrize("keep_tail", [False, True])
def test_truncate_limits(spark, keep_tail):
    values = _random_strings(120, seed=11, max_len=20) + ["hello world  again", "abc", "a b c d e f g h"]
    for limit in (-1, 0, 1, 3, 4, 5, 8, 12):
        got = _eval(spark, values, lambda c: tx.truncate(c, limit, keep_tail))
        for i, v in enumerate(values):
            assert got[i] == spec.truncate(v, limit, keep_tail), (repr(v), limit)


def test_truncate_column_limit(spark):
    df = spark.createDataFrame([("one two three four five", 9), ("short", 10), ("abcdef", 2)], "s string, l int")
    out = [r[0] for r in df.select(tx.truncate(F.col("s"), F.col("l"))).collect()]
    assert out == [spec.truncate("one two three four five", 9), "short", "ab"]


def test_clean_text_adversarial(spark):
    rnd = random.Random(5)
    alphabet = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "　"]
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(600)]
    values += ["a  \n  \n\n\nb", "line \nnext\t\n\n\n\n", "  \n\n  \n\n x"]
    got = _eval(spark, values, tx.clean_text)
    for i, v in enumerate(values):
        assert got[i] == spec.clean(v), repr(v)


def test_html_to_text(spark):
    html = ('<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x:1}</style>'
            '<script>var t="</p>";</script></head><body><!-- gone --><p> one\n two </p>'
            '<template><b>hidden</b></template><p>&copy; 2024 &middot; &quot;q&quot;</p><div>  </div></body></html>')
    got = _eval(spark, [html], tx.html_to_text)[0]
    assert got == 'T & U\none\n two\n© 2024 · "q"'


def test_html_to_text_full_entities(spark):
    html = "<p>caf&eacute; &#233; &#x41;</p>"
    got = _eval(spark, [html], lambda c: tx.html_to_text(c, full_entities=True))[0]
    assert got == "café é A"


def test_first_non_empty(spark):
    got = _eval(spark, ["", None, "x"], lambda c: tx.first_non_empty(c, "(none)"))
    assert got == {0: "(none)", 1: "(none)", 2: "x"}
