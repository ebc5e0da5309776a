from __future__ import annotations

import re

import pytest

from corpuslens.llm import licenses

DOCS = "doc_id long, text string, license_id string, words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute(text):
    """Templates of which four fifths of the shingles stand together somewhere."""
    own, out = shingles(text), []
    for name, template in licenses.TEMPLATES:
        want = set(shingles(template))
        span = len(want) + len(want) // 8
        if any(len(want & set(own[k : k + span])) >= 0.8 * len(want) for k in range(max(1, len(own)))):
            out.append((name, len(want)))
    return sorted(out)


def test_finds_all_and_nothing_else(spark, rng):
    noise = lambda n: " ".join(rng.choice(("the", "software", "under", "license", "zu", "é")) for _ in range(n))
    texts = [None, "", "released under the mit", "RELEASED under the MIT license!", noise(3000)]
    for _, t in licenses.TEMPLATES:
        texts.append(f"{noise(rng.randrange(200))} {t} {noise(rng.randrange(200))}")
        w = t.split()
        if len(w) > 40:
            w[20] = "changed"
            texts.append(f"{noise(7)} {' '.join(w)} {noise(30)}")
    docs = [(k, t, "x", "y") for k, t in enumerate(texts)] * 2
    got = {}
    rows = licenses.find_licenses(spark.createDataFrame(docs, DOCS)).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.license_id, r.template_shingles))
        own = shingles(texts[r.doc_id])
        assert 0.8 <= r.containment <= 1 and own[r.first_word] in {s for _, t in licenses.TEMPLATES for s in shingles(t)}
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == sorted(brute(t) * 2), t


def test_relatives_are_told_apart(spark):
    """Every notice is reported under its own id only, among them those of close relatives."""
    both = {}
    for name, text in licenses.TEMPLATES:
        both.setdefault(" ".join(WORD.findall(text.lower())), set()).add(name)
    docs = [(k, f"zu é {t} é zu", "x", "y") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    wanted = "CC-BY-4.0 CC-BY-SA-4.0 GPL-2.0 GPL-3.0 LGPL-2.1 AGPL-3.0-or-later EPL-2.0 CC0-1.0 Unlicense BSD-3-Clause MPL-2.0".split()
    assert set(wanted) <= {n for n, _ in licenses.TEMPLATES} and all(len(n) == 1 for n in both.values())
    got = {}
    for r in licenses.find_licenses(spark.createDataFrame(docs, DOCS), resolve=True).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    wrong = {t: got.get(k) for k, (n, t) in enumerate(licenses.TEMPLATES) if got.get(k) != {n}}
    assert not wrong, "\n".join(f"{t[:60]} ... {t[-60:]} {v}" for t, v in wrong.items())


def test_band_settings_promise_the_probability():
    for n in range(9):
        c = licenses.Class(n, 0.8, 1e-4)
        assert (1 - c.jaccard) ** c.bands <= 1e-4 and c.window >= c.most


def test_edges(spark):
    docs = spark.createDataFrame([], DOCS)
    assert licenses.find_licenses(docs).count() == 0
    none = spark.createDataFrame([], "license_id string, text string")
    assert licenses.find_licenses(docs, none).count() == 0
    with pytest.raises(Exception, match="five words"):
        short = spark.createDataFrame([("a", "all rights reserved")], "license_id string, text string")
        licenses.find_licenses(spark.createDataFrame([(1, "all rights", None, None)], DOCS), short).collect()
