"""Near-duplicates by SetSketch: exponentially spaced, truncated minima.

A document is a set of word shingles.  Register i of its sketch holds
``floor(1 - log_b(min h_i))``, limited to 16 bits, where h_i maps shingles to exponential variables;
registers merge by maximum and are equal with about the Jaccard similarity.  Bands of registers give
buckets.  Equal sets are one class; only classes go on.

Links are found without all pairs of a bucket:

1. every class of a bucket is compared with the bucket's leader;
2. components of these links are labelled; classes outside the largest component of a bucket are
   compared with the classes of other components, unless a bound rules a link out: the distances to
   the leader (Jaccard distance obeys the triangle inequality), or the rarest shingles of both, of
   which all common ones are known.

A pair is first estimated jointly: the likelihood of the registers that are larger, smaller and
equal, with both set sizes known.  What may reach the threshold is confirmed on the full sets.

Cases: null texts and texts without words have an empty set, are linked with nothing and kept; fewer
words than the shingle width are one shingle; rows of one id are one document, with all its texts;
rows without an id are kept and in no component; texts of any length are read whole; an empty table
gives no rows; other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import integer_id, steps, type_of
from corpuslens.llm.components import components
from corpuslens.llm.shingles import mix, shingle_sets
from corpuslens.session import durable

SHINGLE = 5
PERCENT = 80
#: Sketch: bands of rows; base, rate and limit of the registers.  At a similarity of 0.8 all bands
#: miss with a probability of 1e-7.
BANDS, ROWS = 40, 5
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
#: How far under the threshold an estimate may be: in the first step eleven standard deviations, as
#: distances are taken from it, in the second five.
FAR, NEAR = 0.35, 0.14
#: The share of a set's shingles, rarest first, that bounds overlaps before the second step.
RARE_SHARE = 0.3
CHUNK = 1 << 15


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Sketch of every non-empty set (rows), as 16-bit registers."""
    rng = np.random.default_rng(20210611)
    seeds = rng.integers(0, 1 << 63, count, np.uint64)
    factors = rng.integers(0, 1 << 63, count, np.uint64) << np.uint64(1) | np.uint64(1)
    least = np.empty((len(sets), count), np.uint64)
    first = 0
    while first < len(sets):  # as many sets as stay in cache
        last, held = first + 1, len(sets[first])
        while last < len(sets) and held + len(sets[last]) <= CHUNK:
            held += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        at = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        for k in range(count):
            least[first:last, k] = np.minimum.reduceat((flat ^ seeds[k]) * factors[k], at)
        first = last
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of sketches whose set sizes are known."""
    more, less, same = (a > b).sum(axis=1), (a < b).sum(axis=1), (a == b).sum(axis=1)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        x, y = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    gold = (np.sqrt(5) - 1) / 2
    for _ in range(28):  # concave: golden sections
        x, y = hi - gold * (hi - lo), lo + gold * (hi - lo)
        up = likelihood(x) < likelihood(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def _sketch(width: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(batch.column(1), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            held = [sets[k] for k in full]
            keys = np.zeros((2, len(sets)), np.int64)
            sketch: list[bytes | None] = [None] * len(sets)
            if full:
                flat = np.concatenate(held)
                at = np.cumsum([0] + [len(s) for s in held[:-1]])
                for k, salt in enumerate((1, 2)):
                    keys[k, full] = np.add.reduceat(mix(flat + np.uint64(salt)), at).view(np.int64)
                for k, row in zip(full, registers(held, count)):
                    sketch[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[0]), pa.array(keys[1]), pa.array(sketch, pa.binary())],
                names=["id", "n", "k1", "k2", "registers"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) -> one row per shingle."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1)]
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.concatenate(sets))], names=["node", "shingle"]
            )


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (4, 5))
            n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
            found = estimate(a, b, n_a, n_b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["a", "b", "estimate"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, union = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            n = len(np.intersect1d(x, y, assume_unique=True))
            shared.append(n)
            union.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "total"]
        )


def _estimated(pairs: DataFrame, classes: DataFrame, kind: str, least: float) -> DataFrame:
    """Pairs (a, b) that may be linked, by their sketches."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    found = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    found = found.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_estimates, f"a {kind}, b {kind}, estimate double")
    return found.filter(F.col("estimate") >= least).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """(a, b, shared, total) of the pairs by their full sets; the best of several texts of an id."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"s_{x}"))
    found = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "s_a", "s_b")
    found = found.mapInArrow(_overlaps, f"a {kind}, b {kind}, shared long, total long")
    best = F.max(F.struct((F.col("shared") / F.col("total")).alias("j"), "shared", "total")).alias("x")
    return found.groupBy("a", "b").agg(best).select("a", "b", "x.shared", "x.total")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per row: the id, n_shingles, component_id (least id reachable) and kept."""
    kind = type_of(docs, id_col)
    read = docs.select(integer_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches = durable(read.mapInArrow(_sketch(shingle, bands * rows), f"id {kind}, n long, k1 long, k2 long, registers binary"))
    own = sketches.filter("id is not null and n > 0")
    classes = durable(
        own.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.min_by("registers", "id").alias("registers"))
    )
    band = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)),
            lambda k: F.xxhash64(k, F.substring("registers", k * (2 * rows) + 1, F.lit(2 * rows))),
        )
    )
    buckets = classes.select(band.alias("bucket"), "node")
    leaders = buckets.groupBy("bucket").agg(
        F.min("node").alias("leader"), F.count("*").alias("size")  # the least: mostly the same in all bands
    )
    # A table of its own, so that the join on a large bucket can be split.
    leaders = durable(leaders.filter("size > 1").drop("size"))
    members = durable(buckets.join(leaders.hint("merge"), "bucket"))
    stars = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    near = durable(_estimated(stars, classes, kind, percent / 100 - FAR))
    needed = members.select(F.col("node").alias("id")).distinct()
    sets = durable(read.join(needed.hint("merge"), "id", "left_semi").mapInArrow(_sets(shingle), f"node {kind}, set binary"))
    first = durable(_confirmed(near, sets, kind))
    linked = 100 * F.col("shared") >= percent * F.col("total")
    labels = components(first.filter(linked))

    # Classes of other components in a bucket; distances to the leader rule most out.
    away = first.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("shared") / F.col("total")).alias("d"))
    placed = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"), F.count("*").alias("comps"))
    placed = durable(
        placed.join(mixed.filter("comps > 1").drop("comps"), "bucket")
        .filter("node <> leader")
        .join(away, ["leader", "node"], "left")
        .select("bucket", "node", "comp", "most", "d")
    )
    alive = placed.select("node").distinct()
    each = sets.join(alive.hint("merge"), "node", "left_semi").mapInArrow(_each, f"node {kind}, shingle long")
    rarity = each.groupBy("shingle").agg(F.least(F.count("*"), F.lit((1 << 20) - 1)).alias("df"))
    # Shingles as numbers that sort by rarity; equal numbers of different ones only weaken the bound.
    code = F.shiftleft("df", 43).bitwiseOR(F.col("shingle").bitwiseAND(F.lit((1 << 43) - 1)))
    single = classes.groupBy("node").agg(F.count("*").alias("texts"), F.max("n").alias("n")).filter("texts = 1").drop("texts")
    codes = each.join(rarity.hint("merge"), "shingle").select("node", code.alias("code")).groupBy("node").agg(
        F.array_sort(F.collect_set("code")).alias("rare")  # of one document
    )
    codes = codes.join(single, "node").select("node", "n", F.slice("rare", F.lit(1), (F.col("n") * RARE_SHARE).cast("int") + 1).alias("rare"))
    placed = durable(placed.join(codes.hint("merge"), "node", "left"))
    x, y = placed.filter("comp <> most").alias("x"), placed.alias("y")
    # Up to the lesser end of both lists every common shingle is known; behind it all may be common.
    last = F.least(F.element_at("x.rare", -1), F.element_at("y.rare", -1))
    behind = lambda side: F.col(f"{side}.n") - F.size(F.filter(f"{side}.rare", lambda c: c <= last))
    most = F.size(F.array_intersect("x.rare", "y.rare")) + F.least(behind("x"), behind("y"))
    shareable = F.coalesce((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n")), F.lit(True))
    span = 1 - percent / 100 + 1e-9
    near_ = (
        F.when(F.col("x.d").isNull() & F.col("y.d").isNull(), True)
        .when(F.col("x.d").isNull(), F.col("y.d") >= span - 2e-9)
        .when(F.col("y.d").isNull(), F.col("x.d") >= span - 2e-9)
        .otherwise(F.abs(F.col("x.d") - F.col("y.d")) <= span)
    )
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & near_ & shareable).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    )
    second = durable(_confirmed(_estimated(rest.distinct(), classes, kind, percent / 100 - NEAR), sets, kind).filter(linked))
    if not second.isEmpty():
        labels = components(first.filter(linked).select("a", "b").union(second.select("a", "b")))
    of_class = classes.select("k1", "k2", "n", "node").join(labels, "node", "left").select(
        "k1", "k2", "n", F.coalesce("comp", "node").alias("comp")
    )
    # A document with several texts belongs to the least component of them.
    placed = sketches.select("id", "n", "k1", "k2").join(of_class, ["k1", "k2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return placed.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, as they are."""
    name = "_gone"
    while name in docs.columns:
        name += "_"
    found = near_duplicates(docs, id_col=id_col, **options).filter("not kept")
    gone = found.select(F.col(f"`{id_col}`").alias(name)).distinct()
    return docs.join(gone, integer_id(docs, id_col) == F.col(name), "left_anti")
