from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import hardneg as hn

ROWS = "vec_id long, label int, embedding array<float>, id string, vector string"


def expected(rows, positives=5, negatives=5, low=80, high=100, modulus=10):
    """All pairs of anchors and rows."""
    usable = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, label, v, *_ in rows
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    anchors = {}
    for row in sorted(usable, reverse=True):
        if row[0] % modulus == 0:
            anchors[row[0]] = row
    out = []
    for at, label, vector in anchors.values():
        pairs = [(-sum(map(int.__mul__, vector, v)), i, y) for i, y, v in usable if i != at and len(v) == len(vector)]
        near = sorted((s, i) for s, i, y in pairs if y == label)[:positives]
        for score, i in near:
            far = sorted((s, j) for s, j, y in pairs if y != label and low * -score <= 100 * -s <= high * -score)
            out += [(at, i, rank, j, -score, -s) for rank, (s, j) in enumerate(far[:negatives], 1)]
    return sorted(out)


def got(spark, rows, **options):
    frame = hn.quantised(spark.createDataFrame(rows, ROWS).repartition(4))
    found = hn.mine(frame, frame.filter(F.col("id") % 10 == 0), **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


def vectors(rng, n=300, width=6):
    rows = []
    for k in range(n):
        length = rng.choice((0.1, 1.0, 1.0, 30.0))
        rows.append((k, rng.randrange(3), [rng.gauss(0.2, 1) * length for _ in range(width)], "x", None))
    return rows


def odd(rng):
    rows = [(1000 + k, k % 2, [0.5, 0.5, 0.0, 0.0, 0.0, 0.25], None, None) for k in range(60)]  # ties
    rows += [(1000, 0, [0.5, 0.5, 0.0, 0.0, 0.0, 0.25], None, None)] * 3 + [(1000, 1, [1.0] * 6, None, None)]
    rows += [(2000, 1, [0.0] * 6, None, None), (2010, 1, [], None, None), (2011, 0, [], None, None), (2013, 1, [], None, None)]
    rows += [(2020, 1, [1.0, 2.0], None, None), (2021, 1, [1.0, 2.0], None, None), (2022, 0, [1.0, 1.9], None, None)]
    rows += [(None, 1, [1.0] * 6, None, None), (2030, None, [1.0] * 6, None, None), (2040, 1, None, None, None)]
    rows += [(2050, 1, [1.0, None] * 3, None, None), (2060, 1, [float("nan")] * 6, None, None), (2070, 1, [float("inf")] * 6, None, None)]
    return rows + [(-10, 1, [-1.0] * 6, None, None)]


def test_equals_all_pairs(spark, rng):
    rows = vectors(rng) + odd(rng)
    assert got(spark, rows) == expected(rows)


def test_small_packs_and_other_bounds(spark, rng, monkeypatch):
    """Several packs and anchor groups, results handed on before the end."""
    monkeypatch.setattr(hn, "ANCHORS", 7)
    monkeypatch.setattr(hn, "HELD", 3)
    rows = vectors(rng, 200, 3) + odd(rng)
    want = expected(rows, positives=2, negatives=3, low=50, high=95)
    assert got(spark, rows, positives=2, negatives=3, low=50, high=95, pack=16) == want


def test_pruning_keeps_every_row_that_reaches_the_threshold(rng):
    """Narrow angles: candidate sets are far smaller than the bucket, and nothing is lost."""
    axis = np.eye(8)[rng.randrange(8)]
    made = np.array([[rng.gauss(0, 0.1) for _ in range(8)] for _ in range(2000)]) + np.array([np.eye(8)[k % 8] for k in range(2000)])
    whole = np.floor(made * 256).astype(np.int64)
    checked = 0
    for bucket in hn.buckets(np.arange(2000), np.zeros(2000, np.int64), whole):
        anchor = np.floor(axis * 256).astype(np.int64)
        scores = bucket.vectors @ anchor
        for least in (0, 256 * 128, 256 * 200, 256 * 270, -1000):
            rows = np.arange(len(bucket.ids))[bucket.candidates(anchor / 256.0, 256.0, least)]
            assert set(np.flatnonzero(scores >= least)) <= set(rows)
            checked += len(bucket.ids)
            if least == 256 * 200:
                assert len(rows) < 0.6 * len(bucket.ids) + 5
    assert checked == 5 * 2000


def test_empty(spark):
    assert got(spark, []) == []
