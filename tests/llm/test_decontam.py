from __future__ import annotations

import re

import numpy as np
import pytest

from corpuslens.llm import decontam
from corpuslens.llm.fmindex import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, state string"
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    out = {}
    for doc, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item, phrase in items:
            w = words(phrase)
            size = min(window, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == w[k : k + size]:
                        hit.update(range(at, at + size))
                        found.add("null" if item is None else str(item))
        out[doc] = (len(own), len(hit), sorted(found))
    return out


def test_suffix_order_and_search(rng):
    for _ in range(20):
        text = np.array([0] + [rng.choice((0, 1, 2, 3)) for _ in range(rng.choice((1, 5, 80, 400)))] + [0])
        order = suffix_order(text, 3)
        cut = [text[p:].tolist() for p in range(len(text))]
        keys = [c[: c.index(0) + 1] for c in cut]
        assert [keys[p] for p in order] == sorted(keys)
        index = FMIndex(text, 3, rate=4)
        phrases = np.array([[1, 2, 3], [1, 1, 1], [3, 3, 3], [2, 2, 1]])
        lo, hi = index.search(phrases)
        for row, a, b in zip(phrases.tolist(), lo, hi):
            got = sorted(index.locate(np.arange(a, b)).tolist())
            assert got == [p for p in range(len(text)) if text[p : p + 3].tolist() == row]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_equals_brute_force(spark, rng, block):
    vocab = ["a", "B", "b", "ç", "x9", "Ünd", "o-o"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, prose(rng.choice((1, 3, 4, 8)))) for k in range(6)] + [(6, None), (7, "--"), (None, "b b b x9")]
    docs = [(k, prose(rng.choice((0, 2, 9, 60))), "s") for k in range(40)]
    docs += [(40, None, None), (41, "", "s"), (42, "b" * 5000, "s"), (43, "  ", None)]
    got = decontam.find_contamination(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=4, block_bytes=block
    ).collect()
    want = brute(docs, items, 4)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_spans_cut_and_drop(spark):
    docs = spark.createDataFrame(
        [(1, "é one TWO-three four tail", "k"), (2, "clean", "k"), (3, "one two three four", "k"), (3, "clean", None)], DOCS
    )
    items = spark.createDataFrame([(1, "one two three four")], ITEMS)
    kept = decontam.drop_contaminated(docs, items, window=4)
    assert kept.columns == docs.columns and kept.count() == 2
    cut = decontam.cut_spans(docs, items, window=4).collect()
    assert sorted(r.text for r in cut) == ["", "clean", "clean", "é  tail"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.find_contamination(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b", None)], DOCS)
    assert decontam.find_contamination(one, items).first().contaminated is False
