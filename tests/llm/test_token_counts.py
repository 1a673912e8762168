import random

import public_tokenizers
from conftest import EDGES, prose
from tokenizers import Tokenizer

from corpusflow.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_runs_add_up_to_the_library_count():
    with open(PATH, encoding="utf-8") as f:
        counts = tc._Counts(f.read(), {})
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = ["a", "B", "ß", "é", "É", "é", "'s", "'ll", "'", "’", "1", "²", ".", ",", "!!", " ", "\n", "\t", "\r", " ", " ", "\x1c",
             "\x85", "́", "<|startoftext|>", "<|STARTOFTEXT|>", "<|endoftext|>", "Σ", "ΑΣ", "İ", "漢", "😀", "‍", "한", "﻿", "-", "_",
             "\x00", "Ⅷ", "ª", "×", "ÿ", "th", "ing", "don't", "it's.", "ﬁ"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sum(map(counts.__getitem__, tc.runs(text))) == len(whole.encode(text, add_special_tokens=False).ids), repr(text)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 5)
    with open(PATH, encoding="utf-8") as f:
        counts = tc._Counts(f.read(), {"hello": 1})
    whole = Tokenizer.from_file(PATH)
    text = prose(1, 200) + " Hello, hello " + prose(1, 200)
    assert sum(map(counts.__getitem__, tc.runs(text))) == len(whole.encode(text, add_special_tokens=False).ids)
    assert len(counts) <= 6


def test_documents(edges, empty):
    whole = Tokenizer.from_file(PATH)
    found = sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.count_tokens(edges, PATH).collect()))
    want = []
    for i, t, _ in EDGES:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((i or -1, len((t or "").encode()), n, n > 2048))
    assert found == sorted(want)
    assert tc.count_tokens(empty, PATH).count() == 0
