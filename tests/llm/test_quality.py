import math
import random
import re

import numpy as np
import pytest

from corpusflow.llm import quality
from corpusflow.llm.quality import COUNTS, chi2_cdf, chi2_quantile, consistency, counts_of, judge, mcd

SCHEMA = "doc_id long, text string, lang string, source string"


def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    held = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(held), len(lines))


def test_counts_against_brute_force():
    rng = random.Random(1)
    pieces = ["a", "b", "ü", "漢", "𝒳", "#", "$%", "<b>", " ", " ", "\n", "\n", "\t", "\x0b", " ", "word", "\x1c", "\r\n"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        assert counts_of(text.encode()) == brute_counts(text), repr(text)
        words = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 70)))
        assert counts_of(words.encode()) == brute_counts(words)
    assert counts_of(("x " * 9).encode()) == brute_counts("x " * 9)


def prose(rng, n, junk=0.0):
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) + ("$$$" if rng.random() < junk else "") for _ in range(n)]
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(words))


def corpus():
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(30, 300)), "en", "a" if i % 3 else "b") for i in range(360)]
    rows += [(1000 + i, prose(rng, 150, junk=0.5), "en", "a") for i in range(20)]
    rows += [(2000 + i, rows[1][1], "en", "a") for i in range(600)]                       # exact copies hold most of the group
    rows += [(3000 + i, rows[4][1] + f" end{i}", "en", None) for i in range(60)]           # near copies are all there is
    rows += [(4000 + i, prose(rng, 60), None, "c") for i in range(20)]                     # too few for an estimate
    rows += [(5000, "too short", "en", "a"), (5001, "the same words again and again here " * 20, "en", "b"), (5002, None, "en", "a"),
             (5003, "", None, None), (None, prose(rng, 90), "en", "b"), (7, rows[7][1], "en", "a"), (5004, prose(rng, 30_000), "en", "a")]
    return rows


def brute_judgement(rows):
    """The same estimate with numpy on one machine, group by group."""
    counts = [brute_like(r[1]) for r in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
    angle = lambda a, b: math.asin(math.sqrt(min(a / max(b, 1), 1.0)))
    halves = [None if not c[0] else tuple(round_half_up(2 * f / s) for f, s in zip(
        (math.log(c[0]), math.log(c[1] / c[0]), math.log1p(100.0 * c[2] / c[1]), angle(c[3], c[5]), angle(c[4], c[0])),
        (1.0, 0.1, 0.25, 0.12, 0.1))) for c in counts]
    estimates = {}
    for group in {r[2:] for r in rows}:
        held = [h for r, h, bad in zip(rows, halves, failed) if r[2:] == group and not bad]
        if len(held) < 50:
            continue
        cells = sorted(set(held))
        x, w = np.array(cells) / 2, np.sqrt([held.count(c) for c in cells])
        estimates[group] = brute_mcd(x, w)
    out = []
    for r, c, h, bad in zip(rows, counts, halves, failed):
        far = None
        if h and r[2:] in estimates:
            mean, inverse = estimates[r[2:]]
            far = float((np.array(h) / 2 - mean) @ inverse @ (np.array(h) / 2 - mean))
        out.append((r[0], *c[:5], bad, not bad and (far is None or far <= chi2_quantile(1 - quality.TAIL, 5)), far))
    return out


def brute_like(text):
    return brute_counts(text) if len(text or "") < 3000 else counts_of(text.encode())


def round_half_up(v):
    return int(math.floor(v + 0.5))


def brute_mcd(x, w):
    def estimate(x, w, scale):
        mean = (w[:, None] * x).sum(0) / w.sum()
        cov = scale * ((w[:, None] * x).T @ x / w.sum() - np.outer(mean, mean)) + np.eye(5)
        return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def distances(e):
        return np.einsum("ij,jk,ik->i", x - e[0], e[1], x - e[0])

    def nearest(e):
        bins = np.floor(np.log(np.maximum(distances(e), 0) + 1e-9) * 32)
        last = min(b for b in set(bins) if w[bins <= b].sum() >= 0.75 * w.sum())
        return bins <= last

    def quartile(v, q):
        return min(c for c in set(v) if w[v <= c].sum() / w.sum() >= q)

    middle = np.array([quartile(v, 0.5) for v in x.T])
    sd = np.array([(quartile(v, 0.75) - quartile(v, 0.25)) / 1.349 for v in x.T])
    robust = middle, np.diag(1 / (sd ** 2 + 1)), float(np.log(sd ** 2 + 1).sum())
    ends = []
    starts = [estimate(x, w, 1.0), robust]
    for _ in range(quality.STEPS):
        after = [estimate(x[m], w[m], 1.0) for m in map(nearest, starts)]
        still = max(abs(a[2] - b[2]) for a, b in zip(after, starts)) < 1e-9
        starts = after
        if still:
            break
    ends = min(enumerate(starts), key=lambda e: (e[1][2], e[0]))[1]
    m = nearest(ends)
    scaled = estimate(x[m], w[m], consistency(0.75))
    m = distances(scaled) <= chi2_quantile(0.975, 5)
    return estimate(x[m], w[m], consistency(0.975))[:2]


def test_judgement_against_brute_force(spark, frame):
    """Steps end for all groups together in Spark: converged groups do not change by further steps."""
    rows = corpus()
    got = {}
    for r in judge(frame(rows, SCHEMA)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r))
    expected = {}
    for r in brute_judgement(rows):
        expected.setdefault(r[0], []).append(r)
    assert got.keys() == expected.keys()
    for key, many in expected.items():
        for a, b in zip(sorted(got[key], key=str), sorted(many, key=str), strict=True):
            assert a[:8] == b[:8], (a, b)
            assert a[8] == (None if b[8] is None else pytest.approx(b[8], rel=1e-6, abs=1e-6))
    kept = {r[0]: r[7] for many in got.values() for r in many}
    assert not any(kept[1000 + i] for i in range(20))       # symbols in half the words
    assert sum(kept[i] for i in range(360)) >= 358          # clean documents stay beside 600 copies of one of them
    assert all(kept[2000 + i] for i in range(600)) and all(kept[3000 + i] for i in range(60)) and all(kept[4000 + i] for i in range(20))
    assert kept[5004] and not kept[5000] and not kept[5001] and not kept[5002]


def test_empty_and_edges(spark, frame, empty, edges):
    docs = frame([], SCHEMA)
    assert judge(docs).collect() == []
    rows = judge(edges.withColumnRenamed("label", "lang")).collect()
    assert len(rows) == edges.count() and all(r["distance"] is None for r in rows)


def test_chi_squared():
    assert chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-4)
    assert chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2))
    assert chi2_cdf(3.0, 2) == pytest.approx(1 - math.exp(-1.5))


def test_mcd_of_contaminated_normal_vectors(spark):
    """A fifth of the vectors lies elsewhere: the estimate is that of the rest."""
    rng = np.random.default_rng(3)
    clean = rng.normal(size=(4000, 5)) * [20, 12, 8, 15, 10] + 50
    odd = rng.normal(size=(800, 5)) * 3 + [200, 50, 120, 50, 50]
    rows = [("g", *[int(c) for c in np.rint(2 * v)], 1.0) for v in np.vstack([clean, odd])]
    cells = spark.createDataFrame(rows, "g string, q0 int, q1 int, q2 int, q3 int, q4 int, w double")
    found = mcd(cells).first()
    assert found["mean"] == pytest.approx([50] * 5, abs=1.5)
    spread = np.sqrt(np.diag(np.linalg.inv(np.array(found["inverse"]).reshape(5, 5))))
    assert spread == pytest.approx([20, 12, 8, 15, 10], rel=0.12)
    assert set(COUNTS) == {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
