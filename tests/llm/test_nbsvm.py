from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from corpuslens.llm import nbsvm as nb

DOCS = "doc_id long, text string, label int, score string"
LABELS = "doc_id long, quality int, text string"
BITS = 12


def brute(text, bits):
    """Buckets by windows of a byte string and of its runs."""
    raw = (text or "").encode()

    def bucket(code, kind):
        x = (code + kind * 0x85EBCA6B) * 0x9E3779B1 % 2**32
        x ^= x >> 15
        return x * 0x9E3779B1 % 2**32 >> (32 - bits)

    def grams(codes, n, base, kind):
        for at in range(len(codes) - n + 1):
            code = 0
            for c in codes[at : at + n]:
                code = (code * base + c) % 2**32
            yield bucket(code, kind)

    def kind(byte):
        char = chr(byte)
        if byte > 127 or char.islower():
            return ord("a")
        return ord("A") if char.isupper() else ord("0") if char.isdigit() else 32 if char in " \t\r\v\f" else 46 if char in ".,;:?'\"-()" else byte

    found = {b for n in (1, 2, 3, 4) for b in grams(raw, n, 257, n)}
    runs = [k for at, k in enumerate(map(kind, raw)) if k != (kind(raw[at - 1]) if at else 0)]
    found |= {b for n in (3, 5) for b in grams(runs, n, 131, 10 + n)}
    words = re.findall(rb"[^ \t\r\v\f\n]+", raw)
    same = "".join("=" if a == b else "." for a, b in zip(words, words[1:]))
    found |= {bucket(n, 20) for n in (1, 2, 3) if "=" * n in same}
    return sorted(found)


TEXTS = [None, "", " ", "a", "The cat, sat.\n", "AB!! CD!! AB!!", "x x x x", " go go  go", "é😀 ***### a1", "w " * 400, "q" * 600 + " " + "q" * 600, "\n\nlast", "a\x00b"]


def test_features_equal_brute_force(rng):
    seen = np.zeros(1 << BITS, bool)
    more = ["".join(rng.choice("aB1 \n.!é") for _ in range(rng.randrange(60))) for _ in range(60)]
    for text in TEXTS + more:
        got = nb.features(np.frombuffer((text or "").encode(), np.uint8), seen, BITS)
        assert got.tolist() == brute(text, BITS) and not seen.any()


def test_descent_reaches_the_optimum(rng):
    """Duality gap: the primal value of the weights equals the dual bound."""
    rows = [np.array(sorted(rng.sample(range(40), 6))) for _ in range(80)]
    signs = np.array([1.0 if 3 in r or rng.random() < 0.3 else -1.0 for r in rows])
    scale = np.array([rng.gauss(0, 1) for _ in range(40)])
    weights, bias = nb.descend(rows, scale, signs, cost=0.7, epochs=3000, tolerance=1e-9)
    x = np.zeros((80, 41))
    for k, r in enumerate(rows):
        x[k, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 40] = 1.0
    full = np.append(weights, bias)
    primal = full @ full / 2 + 0.7 * np.maximum(0, 1 - signs * (x @ full)).sum()
    # The dual by projected gradient ascent, a method of its own.
    a = np.zeros(80)
    q = (x * signs[:, None]) @ (x * signs[:, None]).T
    for _ in range(60000):
        a = np.clip(a + (1 - q @ a) / np.linalg.norm(q, 2), 0, 0.7)
    assert abs(primal - (a.sum() - a @ q @ a / 2)) < 1e-4


def test_log_ratios(rng):
    rows = [np.array([0, 1]), np.array([1]), np.array([1, 3])]
    got = nb.log_ratios(rows, np.array([1.0, 1.0, -1.0]), 2)
    up, down = np.array([2, 3, 1, 1]) / 7, np.array([1, 2, 1, 2]) / 6
    assert np.allclose(got, np.log(up / down))


def test_calibration_matches_a_known_curve():
    x = np.random.default_rng(3).normal(0, 2, 40000)
    y = (np.random.default_rng(4).random(40000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(float)
    slope, offset = nb.calibrate(x, y, np.ones(len(x)))
    assert abs(slope - 1.5) < 0.05 and abs(offset + 0.5) < 0.05


@pytest.fixture(scope="module")
def corpus():
    import random

    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubcdlnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs = []
    for k in range(900):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))
        bad = k % 6 == 0
        if bad:
            text = {0: text.upper().replace(" ", "!! "), 1: text.replace(" ", "*** "), 2: " ".join([words[k % 300]] * 30)}[k // 6 % 3]
        docs.append((k, text, int(not bad), "x"))
    return docs


def test_learns_and_ranks(spark, corpus):
    docs = spark.createDataFrame(corpus + [(None, "a b", None, None), (5000, None, None, None), (5001, "", None, None), (7, corpus[7][1], 1, "x")], DOCS)
    labels = spark.createDataFrame([(k, label, None) for k, _, label, _ in corpus] + [(1, 1, None), (6, 0, None), (None, 1, None), (9999, 0, None), (3, None, None)], LABELS)
    model = nb.train(docs, labels.filter(~nb.held_out(labels)))
    rows = nb.score(docs, model).collect()
    assert len(rows) == len(corpus) + 4 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.score for r in rows}
    held = [(got[k], label) for k, _, label, _ in corpus if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(s >= nb.THRESHOLD) == label for s, label in held]) > 0.97
    low, high = [s for s, label in held if not label], [s for s, label in held if label]
    assert np.mean([a < b for a in low for b in high]) > 0.99
    assert got[5000] == got[5001]


def test_held_out_labels_have_no_say(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    mark = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k, *_ in corpus}
    true = spark.createDataFrame([(k, label, None) for k, _, label, _ in corpus], LABELS)
    false = spark.createDataFrame([(k, 1 - label if mark[k] else label, None) for k, _, label, _ in corpus], LABELS)
    scores = [nb.score(docs, nb.train(docs, x.filter(~nb.held_out(x)))).orderBy("doc_id").collect() for x in (true, false)]
    assert scores[0] == scores[1]


def test_bounds_hold(spark, corpus):
    """At most the stated number of rows per class and part, by hash."""
    known = spark.createDataFrame([(k, label) for k, _, label, _ in corpus], "id long, label int")
    chosen, counts = nb._sample(known, 100, 40)
    rows = chosen.groupBy("label", "part").count().collect()
    assert sum(counts.values()) == len(corpus)
    for r in rows:
        assert r["count"] <= 1.5 * (40 if r["part"] else 100)


def test_without_both_labels(spark, corpus):
    docs = spark.createDataFrame(corpus[:20], DOCS)
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in nb.score(docs, nb.train(docs, empty)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, None), (2, 1, None)], LABELS)
    assert all(r.score > 0.999 for r in nb.score(docs, nb.train(docs, ones)).collect())
    both = spark.createDataFrame([(1, 1, None), (1, 0, None)], LABELS)
    assert {r.score for r in nb.score(docs, nb.train(docs, both)).collect()} == {0.5}
    assert nb.score(spark.createDataFrame([], DOCS), nb.train(docs, ones)).count() == 0
