"""Removal of long repeated strings, exactly, with run-length indexes of distinct segments.

Every window of ``window`` bytes holds one anchor: the gram of least hash in it, the leftmost of
equals.  Equal windows have equal anchors at equal places, so windows are dealt by anchor.
Neighbouring windows of one anchor are one segment.  An anchor seen once has no repeated window.  A
segment seen twice is repeated as a whole; of the other segments of an anchor, one copy each goes
into a run-length index, whose matching statistics mark the windows that begin elsewhere as well.

Indexes are built per shard of anchors.  An anchor with very many distinct segments is divided over
several indexes: its windows are dealt by where the anchor stands in them (a few classes of places) and
by the text that all windows of that class have around it, so each window is whole in one index and
equal windows meet.  What is still crowded is divided again, by finer classes, down to single places.
So digests only ever tell which segments are copies of each other; everything else is decided by the
matching statistics of an index.

Cases: a null text is empty; texts shorter than the window lose nothing; matches never cross texts;
repeated rows are repeated strings; rows of equal or no id are told apart by their texts; texts of
any length are read in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import flat, integer_id, steps, type_of
from corpuslens.llm.runindex import repeated_windows
from corpuslens.llm.shingles import mix
from corpuslens.session import durable

WINDOW = 200
#: Bytes of the grams that anchors are chosen from; a power of two.
GRAM = 32
#: Places that one pass works on, bytes of one index, and segments of an anchor that one may hold.
BLOCK, SHARD_BYTES, ANCHOR_SEGMENTS = 1 << 20, 1 << 20, 8192
#: Classes of anchor places by which a crowded anchor is divided, one after another; then by place.
CLASSES = (4, 16)
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE5AB0F0E1D * k) for k in range(16)]
_PLACE = np.uint64((1 << 24) - 1)


def gram_keys(part: np.ndarray, gram: int) -> np.ndarray:
    """A hash per gram of bytes."""
    h = part.astype(np.uint64) + np.uint64(1)
    size, level = 1, 0
    while size < gram:
        h = h[:-size] * _ODD[level] + h[size:]
        size, level = 2 * size, level + 1
    return mix(h)


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Keys that compare by hash, then by place."""
    return (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, first window, windows) of all segments of flat texts, in order of place; blocks
    overlap by a window, so each window belongs to one segment."""
    ends = offsets[1:]
    for first in range(0, max(0, len(data) - window + 1), BLOCK):
        part = data[first : first + BLOCK + window - 1]
        h = gram_keys(part, gram)
        low = _ordered(h)
        wide, span = window - gram + 1, 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        anchor = (low & _PLACE).astype(np.int64)
        place = np.arange(len(low)) + first
        text = np.searchsorted(ends, place, side="right")
        inside = place + window <= ends[text]
        cut = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1]))
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(low)))
        start, length = start[inside[start]], length[inside[start]]
        yield h[anchor[start]].view(np.int64), start + first, length


def _digest(part: memoryview | bytes) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)


_SEGMENTS = "array<struct<anchor: long, segment: long, start: long, windows: long>>"


def _find(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = flat(batch.column(2))
            view = memoryview(np.ascontiguousarray(data))
            found = [x for x in segments(data, offsets, window, gram)]
            anchor, start, length = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            digest = np.fromiter((_digest(view[s : s + n + window - 1]) for s, n in zip(start.tolist(), length.tolist())), np.int64, len(start))
            text = np.searchsorted(offsets[1:], start, side="right")
            rows = pa.StructArray.from_arrays(
                [pa.array(anchor), pa.array(digest), pa.array(start - offsets[text] if len(text) else start), pa.array(length)],
                names=["anchor", "segment", "start", "windows"],
            )
            at = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), rows)], names=["id", "key", "segments"]
            )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: what a shuffle of whole texts costs."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in steps(batches):
        texts = [press.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["id", "key", "packed"])


def _unpacked(value) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = _unpacked(packed)
                rows = [(w["anchor"], w["segment"], text[w["start"] : w["start"] + w["windows"] + window - 1]) for w in wanted]
                rows = list({r[:2]: r for r in rows if _digest(r[2]) == r[1]}.values())
                if rows:
                    yield pa.RecordBatch.from_pydict(
                        {"anchor": pa.array([r[0] for r in rows], pa.int64()), "segment": pa.array([r[1] for r in rows], pa.int64()), "bytes": pa.array([r[2] for r in rows], pa.binary())}
                    )

    return run


def _runs(places: np.ndarray) -> list[int]:
    """First and last place of each run of neighbouring places, one after another."""
    cut = np.flatnonzero(np.diff(places) > 1)
    first, last = np.append(places[0], places[cut + 1]), np.append(places[cut], places[-1])
    return np.stack([first, last], axis=1).ravel().tolist()


def _index(window: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates(["anchor", "segment"])
        found = repeated_windows([bytes(b) for b in shard.bytes], window)
        rows = [(a, s, _runs(f)) for a, s, f in zip(shard.anchor, shard.segment, found, strict=True) if len(f)]
        return pd.DataFrame(rows, columns=["anchor", "segment", "runs"])

    return run


def divided(text: bytes, window: int, gram: int, classes: int) -> Iterator[tuple[int, int, int]]:
    """(group, first, windows): a segment's windows by the class of the anchor's place in them.  The group
    is a digest of the class and of what all its windows have in common, anchor included."""
    places, windows = window - gram + 1, len(text) - window + 1
    # The anchor is the leftmost gram of least hash of the whole segment, as it is of each window.
    at = int(_ordered(gram_keys(np.frombuffer(text, np.uint8), gram)).argmin())
    width = -(-places // classes)
    for low in range(0, places, width):
        high = min(low + width, places) - 1  # places low to high of the anchor in the window
        first, last = max(0, at - high), min(windows - 1, at - low)
        if first <= last:
            common = text[at - low : at - high + window]
            yield _digest(low.to_bytes(4, "little") + common), first, last - first + 1


_PARTS = "home long, segment long, first long, windows long, anchor long, part long, bytes binary"


def _divide(window: int, gram: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = []
                for group, first, windows in divided(row["bytes"], window, gram, classes):
                    text = row["bytes"][first : first + windows + window - 1]
                    anchor = _digest(row["anchor"].to_bytes(8, "little", signed=True) + group.to_bytes(8, "little", signed=True))
                    parts.append((row["home"], row["segment"], row["first"] + first, windows, anchor, _digest(text), text))
                names = [field.split()[0] for field in _PARTS.split(", ")]
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=names)

    return run


def _marks(pieces: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(anchor, segment, runs) from indexes of distinct segments, by shard of anchors."""
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, total // shard_bytes)
    dealt = pieces.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "segment", "bytes")
    return dealt.groupBy("shard").applyInPandas(_index(window), "anchor long, segment long, runs array<long>")


def _crowded_marks(pieces: DataFrame, window: int, gram: int, limit: int, shard_bytes: int) -> DataFrame | None:
    """(anchor, segment, runs) of crowded anchors, divided until every index is of bounded size."""
    open_, found = pieces.select(F.col("anchor").alias("home"), "segment", F.lit(0).cast("long").alias("first"), "anchor", "bytes"), None
    for classes in (*CLASSES, window - gram + 1):
        if open_.isEmpty():
            break
        parts = durable(open_.mapInArrow(_divide(window, gram, classes), _PARTS))
        copies = durable(
            parts.groupBy("anchor", "part").agg(F.count("*").alias("n"), F.min(F.struct("home", "segment", "first", "bytes")).alias("one"))
        )
        finest = classes > window - gram
        crowd = copies.groupBy("anchor").agg(F.count("*").alias("d")).filter((F.col("d") > limit) & F.lit(not finest)).select("anchor")
        crowd = durable(crowd)
        calm = copies.join(crowd, "anchor", "left_anti").select("anchor", F.col("part").alias("segment"), "one.bytes")
        runs = _marks(calm, window, shard_bytes).withColumnRenamed("segment", "part")
        every = F.array(F.col("first"), F.col("first") + F.col("windows") - 1)
        slim = parts.select("home", "segment", "first", "windows", "anchor", "part")
        copied = slim.join(copies.filter("n > 1").select("anchor", "part"), ["anchor", "part"]).select("home", "segment", every.alias("runs"))
        partly = slim.join(runs, ["anchor", "part"]).select("home", "segment", F.transform("runs", lambda r: r + F.col("first")).alias("runs"))
        level = durable(copied.unionByName(partly))
        found = level if found is None else found.unionByName(level)
        open_ = copies.join(crowd, "anchor").select("one.home", "one.segment", "one.first", "anchor", "one.bytes")
    if found is None:
        return None
    return found.groupBy(F.col("home").alias("anchor"), "segment").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _finish(window: int, emit_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = _unpacked(packed)
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                row = (len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest())
                out.append((*row, [{"start": a, "end": b} for a, b in merged], rest if emit_text else None))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=["id", *names]
            )

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    anchor_segments: int = ANCHOR_SEGMENTS,
    shard_bytes: int = SHARD_BYTES,
    emit_text: bool = False,
) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256, spans (bytes, end exclusive) and, on
    request, kept: the remaining bytes."""
    if gram & (gram - 1) or not 1 <= gram <= window:
        raise ValueError("the gram is a power of two, and no longer than the window")
    kind = type_of(docs, id_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(integer_id(docs, id_col).alias("id"), F.xxhash64(text, integer_id(docs, id_col)).alias("key"), text.alias("text"))
    found = durable(rows.mapInArrow(_find(window, gram), f"id {kind}, key long, segments {_SEGMENTS}"))
    each = found.select("id", "key", F.explode("segments").alias("s")).select("id", "key", "s.*")
    twice = durable(  # a table of its own, so that the join on a frequent anchor can be split
        each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("segment").alias("a"), F.max("segment").alias("b"))
        .filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    )
    hits = durable(each.join(twice.hint("merge"), "anchor"))
    mixed = durable(
        hits.filter("mixed").groupBy("anchor", "segment")
        .agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "windows")).alias("at"))
    )
    texts = rows.select("id", "key", "text").mapInArrow(_packed, f"id {kind}, key long, packed binary")

    # One copy of each distinct segment of the anchors that have several.
    wanted = mixed.groupBy(F.col("at.key").alias("key")).agg(
        F.collect_list(F.struct("anchor", "segment", F.col("at.start").alias("start"), F.col("at.windows").alias("windows"))).alias("wanted")
    )
    pieces = texts.join(wanted.hint("merge"), "key").select("packed", "wanted")
    pieces = pieces.mapInArrow(_cut_out(window), "anchor long, segment long, bytes binary")
    crowded = mixed.groupBy("anchor").agg(F.count("*").alias("d")).filter(F.col("d") > anchor_segments).select("anchor", F.lit(True).alias("crowded"))
    pieces = durable(pieces.join(crowded, "anchor", "left"))
    marks = _marks(pieces.filter("crowded is null"), window, shard_bytes)
    split = _crowded_marks(pieces.filter("crowded"), window, gram, anchor_segments, shard_bytes)
    marks = durable(marks if split is None else marks.unionByName(split))

    whole = mixed.filter("n > 1").select("anchor", "segment", F.lit(True).alias("whole"))
    judged = hits.join(whole.join(marks, ["anchor", "segment"], "full"), ["anchor", "segment"], "left")
    all_ = F.array(F.struct(F.col("start"), (F.col("start") + F.col("windows") + window - 1).alias("end")))
    some = F.transform(
        F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1),
        lambda k: F.struct(
            (F.col("start") + F.get("runs", 2 * k)).alias("start"),
            (F.col("start") + F.get("runs", 2 * k + 1) + window).alias("end"),
        ),
    )
    some = F.when(F.size("runs") > 0, some)
    spans = F.when(~F.col("mixed") | F.col("whole"), all_).otherwise(some)
    gone = (
        judged.select("id", "key", spans.alias("spans")).filter(F.size("spans") > 0)
        .groupBy("id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one text
    )
    gone = gone.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "spans")
    same = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    last = texts.join(gone.hint("merge"), same, "left").select("id", "packed", "spans")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary"
    done = last.mapInArrow(_finish(window, emit_text), schema).withColumnRenamed("id", id_col)
    return done if emit_text else done.drop("kept")
