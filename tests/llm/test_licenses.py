from collections import Counter

from conftest import EDGES, prose, words

from corpusflow.llm.licenses import NOTICES, PHRASES, STRIDE, Template, scan_licenses


def brute(text, phrases=PHRASES, notices=NOTICES):
    w = words(text)
    places = sorted((i, t.label, k) for k, t in enumerate(phrases) for i in range(len(w)) if w[i:i + len(t.words)] == t.words)
    labels, score = {p[1] for p in places}, 1.0 if places else 0.0
    for t in notices:
        stride = STRIDE
        while stride < len(t.words):
            stride *= 2
        for at in range(0, len(w), stride):
            block = set(w[at:at + 2 * stride])
            n = len(set(t.words) & block)
            if n >= t.needed:
                labels.add(t.label)
                score = max(score, n / len(set(t.words)))
    return len(w), places, sorted(labels), score


def test_scan_equals_brute_force(frame):
    filler = prose(1, 700).split()
    texts = [t for _, t, _ in EDGES]
    for k, t in enumerate(PHRASES + NOTICES):
        for at in (0, 1, STRIDE - 2, STRIDE - 1, STRIDE, 2 * STRIDE - 3, 500, len(filler)):
            texts.append(" ".join(filler[:at] + [t.text.upper()] + filler[at:]))
    texts.append("under the MIT license " * 40 + "cc by cc by nc nc")
    texts.append("the license mit under")  # all words, not in order
    texts.append(" ".join(NOTICES[0].words[:-2]))  # nearly all words
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")]
    found = Counter((r["doc_id"], r["n_words"], tuple((p["word"], p["label"], p["template"]) for p in r["places"]),
                     tuple(r["labels"]), r["score"]) for r in scan_licenses(frame(rows)).collect())
    want = Counter()
    for i, t, _ in rows:
        n, places, labels, score = brute(t)
        want[(i, n, tuple(places), tuple(labels), score)] += 1
    assert found == want


def test_edges(edges, empty):
    assert scan_licenses(edges).count() == len(EDGES)
    assert scan_licenses(empty).count() == 0


def test_templates_of_any_length(frame):
    """Whole license texts beside short notices: long phrases and long notices meet blocks of their own stride."""
    long_phrase = Template("long-phrase", prose(50, 150), phrase=True)
    long_notice = Template("long-notice", prose(51, 700), threshold=0.7)
    phrases, notices = [*PHRASES, long_phrase], [*NOTICES, long_notice]
    filler, body = prose(1, 900).split(), long_notice.text.split()
    texts = [" ".join(filler[:at] + t.split() + filler[at:]) for at in (0, 63, 127, 128, 511, 900) for t in (long_phrase.text, long_notice.text)]
    texts += [" ".join(filler[:300] + body[:keep] + filler[300:]) for keep in (400, 480, 495, 560)]
    texts += [" ".join(long_phrase.text.split()[:-1]), NOTICES[2].text, long_phrase.text + " " + long_phrase.text]
    found = {r["doc_id"]: (r["n_words"], [(p["word"], p["label"], p["template"]) for p in r["places"]], r["labels"], r["score"])
             for r in scan_licenses(frame([(i, t, "s") for i, t in enumerate(texts)]), phrases + notices).collect()}
    assert found == {i: brute(t, phrases, notices) for i, t in enumerate(texts)}
    assert sum("long-notice" in f[2] for f in found.values()) >= 7
