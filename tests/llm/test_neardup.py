from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import neardup
from corpuslens.llm.components import components
from corpuslens.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, node string, comp string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, width):
    sets = [(d[0], shingles(d[1], width)) for d in docs]
    comp = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and comp[i] != comp[j] and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets}


def corpus(rng):
    vocab = [f"w{k}" for k in range(400)] + ["Ünd", "x" * 60, "THE", "the"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "a b", "b a", "A  b\n"]
    for size in (6, 30, 60, 200):
        for _ in range(6):
            base = prose(size)
            texts.append(" ".join(base))
            chain = list(base)
            for _ in range(rng.randrange(5)):  # copies of copies: neighbours are linked, ends are not
                for _ in range(max(1, size // 22)):
                    chain[rng.randrange(size)] = rng.choice(vocab)
                texts.append("\t".join(chain))
    texts += [" ".join(prose(100))] * 5 + [" ".join(prose(9000))]
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, rng, width):
    ids = rng.sample(range(1000), 1000)
    docs = [(ids[k], t, "x", "y") for k, t in enumerate(corpus(rng))]
    frame = spark.createDataFrame(docs, DOCS)
    got = neardup.near_duplicates(frame, shingle=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, width)
    kept = neardup.drop_near_duplicates(frame, shingle=width)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_sets_and_estimates(rng):
    texts = ["a b c", "a", None, "x" * 50 + " b", " ".join(str(k) for k in range(1000)), " ".join(str(k) for k in range(100, 1100))]
    sets = shingle_sets(pa.array(texts), 2)
    assert [len(s) for s in sets] == [2, 1, 0, 1, 999, 999]
    a = neardup.registers([sets[4]], 4096)
    b = neardup.registers([sets[5]], 4096)
    want = len(np.intersect1d(sets[4], sets[5])) / len(np.union1d(sets[4], sets[5]))
    n = np.array([999.0])
    assert abs(neardup.estimate(a, b, n, n)[0] - want) < 0.03
    assert neardup.estimate(a, a, n, n)[0] > 0.99
    both = neardup.registers([np.union1d(sets[4], sets[5])], 4096)
    assert (both == np.maximum(a, b)).all()  # mergeable


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_nulls_repeats_and_empty(spark):
    docs = [(None, "a b c", None, None), (5, "a b c", None, None), (5, "a b c", None, None), (9, "a b c", None, None), (7, None, None, None)]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(docs, DOCS), shingle=2).collect()), key=str)
    assert got == [(0, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (9, 2, 5, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
