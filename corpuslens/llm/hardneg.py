"""Hard negatives by inner product, with LEMP-style coordinate pruning.

Rows are packed where they are read, without a shuffle.  A pack sorts its vectors by length and cuts
them into buckets of similar length; a bucket keeps, for each coordinate, the sorted list of its unit
vectors' values.  For an anchor and a threshold, a bucket too short to reach it is skipped; else the
threshold over both lengths is a least cosine, and a vector within that angle of the anchor can only
have certain values in a coordinate: the anchor's strongest coordinates (its focus) each give a range
of a sorted list, and only rows in all ranges are verified, in exact integers.  Thresholds are the
worst of the best rows found so far by the task, so a pack meets higher ones than the pack before.

Anchors are dealt to groups of about ``ANCHORS`` by hash; a group meets every pack in an equi join on
the group number, broadcast where the anchors are measured to be few.  What leaves a task is bounded
by the wanted rows per anchor, not by matches.

First pass: the best rows of an anchor's own label (positives).  Second pass: for each positive, the
best rows of other labels whose score lies in the asked share of the positive's score.

Cases: rows without id, label or vector, or with a null or non-finite component, take no part; vectors
of different length never meet; an empty or zero vector scores 0; equal scores are ordered by id; a
repeated row is a row of its own, but never a partner of its own id, and of several rows with an
anchor's id the one of least label and vector is the anchor; an empty table gives no rows; other
columns are ignored.  Scores beyond a long are not supported; they need components of about 2^28.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.joins import join_small
from corpuslens.functions.ordered import top_per_key
from corpuslens.session import durable

PACK = 2048
ANCHORS = 512
#: Coordinates of an anchor that are searched.
FOCUS = 5
#: The shortest vector of a bucket, as a share of its longest.
SPAN = 0.9
#: Anchors whose best rows a task holds before it hands them on.
HELD = 16384
_SLACK = 1e-9

_ANCHOR = "struct<id:long,label:long,vector:array<long>,goals:array<long>>"


class Bucket:
    """Rows of similar length: exact vectors, and per coordinate the sorted values of unit vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        unit = (vectors / np.maximum(lengths, 1e-300)[:, None]).T
        self.order = np.argsort(unit, axis=1, kind="stable")
        self.values = np.take_along_axis(unit, self.order, axis=1)

    def candidates(self, unit: np.ndarray, length: float, least: float, focus: int = FOCUS) -> np.ndarray | slice:
        """Rows that may score ``least`` or more with the anchor of that direction and length."""
        everything = slice(None)
        reach = length * (self.longest if least > 0 else self.shortest)
        if reach == 0:
            return everything if least <= 0 else np.zeros(0, np.int64)
        cosine = least / reach - _SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return everything
        angle = np.arccos(cosine)
        hits, used = None, 0
        for at in np.argsort(-np.abs(unit), kind="stable")[:focus]:
            mine = np.arccos(np.clip(unit[at], -1, 1))
            low, high = np.cos(min(np.pi, mine + angle)), np.cos(max(0.0, mine - angle))
            first = np.searchsorted(self.values[at], low - _SLACK, "left")
            last = np.searchsorted(self.values[at], high + _SLACK, "right")
            if last - first == len(self.ids):
                continue
            if hits is None:
                hits = np.zeros(len(self.ids), np.uint8)
            hits[self.order[at, first:last]] += 1
            used += 1
        return everything if hits is None else np.flatnonzero(hits == used)

    def scores(self, rows: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products; doubles where they are exact, else long integers."""
        mine = self.vectors[rows]
        if not mine.size:
            return np.zeros(len(mine), np.int64)
        bound = float(np.abs(anchor).max()) * self.longest * len(anchor)
        if bound < 2**52:
            return (mine @ anchor.astype(np.float64)).astype(np.int64)
        return mine.astype(np.int64) @ anchor


def buckets(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[Bucket]:
    """Buckets of falling length."""
    exact = vectors.astype(np.float64)
    lengths = np.sqrt(np.square(exact).sum(axis=1)) if vectors.shape[1] else np.zeros(len(ids))
    order = np.lexsort((ids, -lengths))
    ids, labels, exact, lengths = ids[order], labels[order], exact[order], lengths[order]
    found, first = [], 0
    while first < len(ids):
        last = int(np.searchsorted(-lengths, -SPAN * lengths[first], "right"))
        last = max(last, first + 1)
        found.append(Bucket(ids[first:last], labels[first:last], exact[first:last], lengths[first:last]))
        first = last
    return found


class Best:
    """The best rows so far, by (score falling, id rising)."""

    def __init__(self, size: int, floor: int | None = None, ceiling: int | None = None):
        self.size, self.floor, self.ceiling = size, floor, ceiling
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int | None:
        """Rows below this are of no use; none if any row is."""
        if len(self.scores) == self.size:
            return int(self.scores[-1])
        return self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.ones(len(scores), bool) if (least := self.least()) is None else scores >= least
        if self.ceiling is not None:
            keep &= scores <= self.ceiling
        scores, ids = scores[keep], ids[keep]
        if len(scores) > self.size:
            keep = scores >= np.partition(scores, -self.size)[-self.size]
            scores, ids = scores[keep], ids[keep]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[order], ids[order]


class _Anchor:
    def __init__(self, given: dict, size: int, low: int, high: int):
        self.id, self.label = given["id"], given["label"]
        self.vector = np.array(given["vector"], np.int64)
        self.length = float(np.sqrt(np.square(self.vector.astype(np.float64)).sum()))
        self.unit = self.vector / self.length if self.length else self.vector.astype(np.float64)
        goals = given["goals"]
        self.same = goals is None
        # low% of the goal, rounded up, and high% of it, rounded down, in whole numbers.
        self.best = [Best(size)] if goals is None else [Best(size, -(-low * g // 100), high * g // 100) for g in goals]

    def search(self, bucket: Bucket) -> None:
        bounds = [b.least() for b in self.best]
        if not bounds:
            return
        least = -np.inf if None in bounds else min(bounds)
        rows = bucket.candidates(self.unit, self.length, least)
        ids = bucket.ids[rows]
        fits = (bucket.labels[rows] == self.label) == self.same
        fits &= ids != self.id
        scores = bucket.scores(rows, self.vector)[fits]
        for best in self.best:
            best.add(scores, ids[fits])


def _pack(size: int):
    """Packs of rows of one width, cut as the rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(batch.column("vector").value_lengths(), np.int64)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                for at in range(0, len(rows), size):
                    part = batch.take(pa.array(rows[at : at + size]))
                    vectors = part.column("vector").flatten()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32())]
                        + [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (part.column("id"), part.column("label"), vectors)],
                        names=["width", "ids", "labels", "vectors"],
                    )

    return run


def _search(size: int, low: int, high: int, held: int):
    """(anchor, goal number, id, score): the best rows of the packs that a task sees."""

    def emit(groups: dict) -> pa.RecordBatch:
        found = [
            (anchor.id, goal, best.ids, best.scores)
            for group in groups.values() for anchor in group for goal, best in enumerate(anchor.best) if len(best.ids)
        ]
        counts = [len(f[2]) for f in found]
        columns = [
            pa.array(np.repeat([f[0] for f in found], counts).astype(np.int64)), pa.array(np.repeat([f[1] for f in found], counts).astype(np.int32)),
            pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.int64()), pa.array(np.concatenate([f[3] for f in found]) if found else [], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["anchor_id", "goal", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list[_Anchor]] = {}
        pack, index = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch.column("width")[row].as_py()
                ids = np.asarray(batch.column("ids")[row].values, np.int64)
                if pack is None or len(pack) != len(ids) or not np.array_equal(pack, ids):
                    labels = np.asarray(batch.column("labels")[row].values, np.int64)
                    vectors = np.asarray(batch.column("vectors")[row].values, np.int64).reshape(len(ids), width)
                    pack, index = ids, buckets(ids, labels, vectors)
                key = (batch.column("part")[row].as_py(), width)
                if key not in groups:
                    if sum(map(len, groups.values())) > held:
                        yield emit(groups)
                        groups = {}
                    given = batch.column("anchors")[row].as_py()
                    groups[key] = [_Anchor(a, size, low, high) for a in given if len(a["vector"]) == width]
                for anchor in groups[key]:
                    for bucket in index:
                        anchor.search(bucket)
        yield emit(groups)

    return run


def _meet(packs: DataFrame, anchors: DataFrame, size: int, low: int, high: int) -> DataFrame:
    """``anchors``: id, label, vector, goals.  Best rows of the whole table for each anchor and goal."""
    parts = max(1, -(-anchors.count() // ANCHORS))
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    groups = durable(dealt.groupBy("part").agg(F.collect_list(F.struct("id", "label", "vector", "goals")).alias("anchors")))
    asked = packs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = join_small(asked, groups, ["part"])
    hits = met.mapInArrow(_search(size, low, high, HELD), "anchor_id long, goal int, id long, score long")
    return top_per_key(hits, ["anchor_id", "goal"], [F.col("score").desc(), F.col("id")], size, "rank")


def quantised(rows: DataFrame, *, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, vector): components as whole numbers, ``floor(scale * x)``; rows that take no part left out."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col("label") if label is None else label
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & vector.isNotNull() & usable).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x * scale)).cast("array<long>").alias("vector"),
    )


def mine(
    rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pack: int = PACK
) -> DataFrame:
    """Per anchor, positive and rank (from 1): the negative and both scores.

    ``rows`` and ``anchors``: id, label, vector of long.  A negative's score is ``low`` to ``high`` per cent of
    the positive's."""
    packs = durable(rows.select("id", "label", "vector").mapInArrow(_pack(pack), "width int, ids array<long>, labels array<long>, vectors array<long>"))
    asked = durable(anchors.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector"))
    near = _meet(packs, asked.withColumn("goals", F.lit(None).cast("array<long>")), positives, low, high)
    goals = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    known = durable(goals.withColumnRenamed("anchor_id", "id").join(asked, "id"))
    far = _meet(packs, known.select("id", "label", "vector", F.col("found.score").alias("goals")), negatives, low, high)
    return far.join(known.select(F.col("id").alias("anchor_id"), "found"), "anchor_id").select(
        "anchor_id", F.get("found", F.col("goal"))["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.get("found", F.col("goal"))["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
