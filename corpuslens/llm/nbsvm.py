"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-grams, hashed to buckets.  Each indicator is scaled by the log ratio of its
smoothed shares in the two classes; a linear hinge-loss model is fitted to the scaled, length-normed
indicators by dual coordinate descent and drawn towards the Naive Bayes weights (``MIX``).  A logistic
curve, fitted to labelled rows that the model has not seen and weighted to the true class shares,
turns margins into scores.

n-grams are those of bytes (1 to 4), those of runs of character classes (3 and 5 runs: lower and other
letters, capitals, digits, spaces, line ends, sentence marks, each further symbol), and words equal to
the one, two or three words before.

The model is fitted to at most ``FIT_ROWS`` labelled documents per class and calibrated on at most
``CALIBRATION_ROWS`` others per class, both taken by hash of the id; the fit is one task of that bounded
sample.  Every document is scored, whole, in one pass without a shuffle.

Cases: a null text is empty and has no n-gram, its score is that of the bias; rows without an id are
scored but not learned from, and count as not held out; a document labelled both ways is not learned
from, one labelled twice alike counts once per row of documents; without labels of both kinds every score is
the share of label 1 (0.5 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.joins import join_small
from corpuslens.llm.common import flat, integer_id, steps, type_of
from corpuslens.session import durable

BITS = 18
FIT_ROWS = 5000
CALIBRATION_ROWS = 5000
#: Share of the labelled documents, by hash, that is kept for calibration, in per cent.
CALIBRATION_SHARE = 25
SMOOTHING = 1.0
COST = 4.0
MIX = 0.75
EPOCHS = 30
TOLERANCE = 1e-3
THRESHOLD = 0.3

_SPREAD = 0x9E3779B1


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)  # each further symbol is a class of its own
    for members, name in (
        ([*range(97, 123), *range(128, 256)], 97), (range(65, 91), 65), (range(48, 58), 48),
        (b" \t\r\x0b\x0c", 32), (b"\n", 10), (b".,;:?'\"-()", 46),
    ):
        table[list(members)] = name
    return table


CLASSES = _classes()
_POWERS = np.array([pow(31, k, 1 << 32) for k in range(256)], np.uint32)


def _bucket(codes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    mixed = (codes + np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(_SPREAD)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(_SPREAD)) >> np.uint32(32 - bits)


def _grams(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """One code per window of ``n`` codes, modulo 2^32."""
    windows = max(len(codes) - n + 1, 0)
    out = np.zeros(windows, np.uint32)
    for k in range(n):
        out = out * np.uint32(base) + codes[k : k + windows]
    return out


def _word_codes(text: np.ndarray) -> np.ndarray:
    """A hash per word (between spaces and line ends)."""
    inside = ~np.isin(CLASSES[text], (32, 10))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint32)
    at = np.arange(len(text))
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(text))))
    letters = (text.astype(np.uint32) + np.uint32(1)) * _POWERS[at & 255] * inside
    sums = np.add.reduceat(letters, starts, dtype=np.uint32)
    return sums * np.uint32(_SPREAD) + (ends - starts).astype(np.uint32)


def features(text: np.ndarray, seen: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sorted buckets of a text's n-grams.  ``seen`` is a cleared flag per bucket, and is left so."""
    codes = text.astype(np.uint32)
    for n in (1, 2, 3, 4):
        seen[_bucket(_grams(codes, n, 257), n, bits)] = True
    kinds = CLASSES[text]
    runs = kinds[np.flatnonzero(np.diff(kinds, prepend=np.uint32(0)))] if len(kinds) else kinds
    for n in (3, 5):
        seen[_bucket(_grams(runs, n, 131), 10 + n, bits)] = True
    words = _word_codes(text)
    alike = words[1:] == words[:-1]
    for n in (1, 2, 3):
        if len(alike) >= n and np.logical_and.reduce([alike[k : len(alike) - n + 1 + k] for k in range(n)]).any():
            seen[_bucket(np.array([n], np.uint32), 20, bits)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def descend(rows: list[np.ndarray], scale: np.ndarray, signs: np.ndarray, cost: float = COST, epochs: int = EPOCHS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights and bias of ``min |w|^2/2 + cost * sum hinge`` by dual coordinate descent.

    Row i has the values ``scale[rows[i]]``, scaled to unit length, and a one for the bias."""
    weights, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] / max(np.sqrt(np.square(scale[r]).sum()), 1e-12) for r in rows]
    square = np.array([np.square(v).sum() + 1.0 for v in values])
    duals = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, x, sign = rows[i], values[i], signs[i]
            slope = sign * (weights[at] @ x + bias) - 1.0
            if (duals[i] == 0.0 and slope > 0) or (duals[i] == cost and slope < 0):
                continue
            worst = max(worst, abs(slope))
            new = min(max(duals[i] - slope / square[i], 0.0), cost)
            step = (new - duals[i]) * sign
            weights[at] += step * x
            bias += step
            duals[i] = new
        if worst < tolerance:
            break
    return weights, bias


def log_ratios(rows: list[np.ndarray], signs: np.ndarray, bits: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of the smoothed shares of each indicator in the two classes."""
    shares = []
    for sign in (1, -1):
        mine = [r for r, s in zip(rows, signs, strict=True) if s == sign]
        counts = np.bincount(np.concatenate(mine), minlength=1 << bits) + smoothing
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1])


class Model(NamedTuple):
    """Bucket -> contribution to the margin and to the squared length; margin -> score."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        return float(self.weights[found].sum() / max(np.sqrt(self.squares[found].sum()), 1e-12)) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], signs: np.ndarray, bits: int = BITS) -> Model:
    scale = log_ratios(rows, signs, bits)
    weights, bias = descend(rows, scale, signs)
    drawn = MIX * weights + (1 - MIX) * np.abs(weights).mean()
    return Model((drawn * scale).astype(np.float32), np.square(scale).astype(np.float32), bias)


def calibrate(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted margins, by Newton's method, with one
    row of each label added at each end so that separated classes stay finite."""
    low, high = margins.min(), margins.max()
    x = np.concatenate([margins, [low, high, low, high]])
    y = np.concatenate([labels, [1.0, 1.0, 0.0, 0.0]])
    w = np.concatenate([weights, np.full(4, 0.25)])
    slope, offset = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 1e-4 * a * a)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        grad = np.array([(w * (p - y) * x).sum() + 2e-4 * slope, (w * (p - y)).sum()])
        h = w * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 2e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        now, size = loss(slope, offset), 1.0
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > now:
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
        if size * np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def held_out(docs: DataFrame, id_col: str = "doc_id", modulus: int = 5) -> Column:
    """Documents whose labels are never learned from."""
    text = integer_id(docs, id_col).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % modulus == 0, F.lit(False))


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label): documents with one label, 0 or 1."""
    label = F.col(f"`{label_col}`").cast("int")
    return (
        labels.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"))
        .filter("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .filter("label = _most")
        .drop("_most")
    )


def _sample(known: DataFrame, fit_rows: int, calibration_rows: int) -> tuple[DataFrame, dict]:
    """(id, label, part) by hash order up to the bounds, and the rows of each class."""
    mix = F.xxhash64("id", F.lit(12))
    dealt = known.withColumn("part", (F.pmod(mix, F.lit(100)) < CALIBRATION_SHARE).cast("int")).withColumn(
        "mix", F.pmod(F.shiftright(mix, 8), F.lit(1 << 40))
    )
    counts = {(r["label"], r["part"]): r["n"] for r in dealt.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for (label, part), n in counts.items():
        bound = calibration_rows if part else fit_rows
        here = (F.col("label") == label) & (F.col("part") == part)
        keep = keep | (here & (F.col("mix") <= int((1 << 40) * min(1.0, bound / n))))
    return dealt.filter(keep).drop("mix"), counts


def _extract(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in steps(batches):
            data, at = flat(batch.column(2))
            found = [features(data[a:b], seen, bits).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["label", "part", "found"])

    return run


def _fit(bits: int):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        fitted = fit([np.asarray(r) for r in sample["found"]], np.where(sample["label"] == 1, 1.0, -1.0), bits)
        return pd.DataFrame({"weights": [fitted.weights], "squares": [fitted.squares], "bias": [fitted.bias]})

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = BITS,
    fit_rows: int = FIT_ROWS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> Model:
    """The model of ``labels`` (id, label 0 or 1) of ``docs``; leave out what must not be learned."""
    known = durable(labelled(labels, id_col, label_col))
    chosen, counts = _sample(known, fit_rows, calibration_rows)
    none = Model(np.zeros(1 << bits, np.float32), np.ones(1 << bits, np.float32), 0.0)
    total = sum(counts.values())
    ones = sum(n for (label, _), n in counts.items() if label == 1)
    prior = none._replace(offset=float(np.log((ones + 1e-9) / (total - ones + 1e-9))) if total else 0.0)
    if not 0 < ones < total:
        return prior
    texts = docs.select(integer_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    read = join_small(texts, chosen, ["id"]).select("label", "part", "text")
    sample = durable(read.mapInArrow(_extract(bits), "label int, part int, found array<int>"))
    rows = {(r["label"], r["part"]): r["n"] for r in sample.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    part = 0 if all(rows.get((label, 0)) for label in (0, 1)) else 1
    if not all(rows.get((label, part)) for label in (0, 1)):
        return prior
    found = sample.filter(F.col("part") == part).groupBy("part").applyInPandas(_fit(bits), "weights array<float>, squares array<float>, bias double").first()
    model = Model(np.array(found["weights"], np.float32), np.array(found["squares"], np.float32), found["bias"])
    held = 1 if all(rows.get((label, 1)) for label in (0, 1)) else part
    margins = sample.filter(F.col("part") == held).mapInPandas(
        lambda frames: (pd.DataFrame({"label": f["label"], "margin": [model.margin(np.asarray(r)) for r in f["found"]]}) for f in frames),
        "label int, margin double",
    ).toPandas()
    share = {label: sum(n for (x, _), n in counts.items() if x == label) / total for label in (0, 1)}
    weight = margins["label"].map(lambda x: share[x] * len(margins) / rows[x, held]).to_numpy(float)
    slope, offset = calibrate(margins["margin"].to_numpy(float), margins["label"].to_numpy(float), weight)
    return model._replace(slope=slope, offset=offset)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Per row: the id and its score, the likelihood of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in steps(batches):
            data, at = flat(batch.column(1))
            scores = [model.score(features(data[a:b], seen, bits)) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    read = docs.select(integer_id(docs, id_col), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, score double")
