"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded slice of a partition's texts.  Its words are numbered by the words of the
benchmark phrases; runs of other words are one break, as no phrase can cross them.  All phrases are
searched backwards at once through the ranks of a wavelet matrix; occurrences are located by
sampled suffix positions and merged into removal spans.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Phrases: every ``window``
consecutive words of an item, or all words of a shorter one.  The benchmark is read in blocks of
bounded size; each block is one broadcast and one pass.

Cases: a null or empty text has no words and no hits; an item without words has no phrase; repeated
items and texts count alike; an item without an id is reported as ``null``; a text longer than a
shard is a shard of its own; empty tables give empty or clean results; other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import flat, integer_id, steps, type_of
from corpuslens.llm.fmindex import FMIndex

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 8 << 20

_FOLD = np.zeros(256, np.uint8)  # 0: not part of a word
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


class Words:
    """Word spans of a flat byte string, in which words do not cross the given offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _FOLD[data]
        word = self.data != 0
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.append(False, word[:-1]) & ~cut[:-1]
        after = np.append(word[1:], False) & ~cut[1:]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.of = np.searchsorted(self.start, offsets)  # first word of each text

    def hashes(self, longest: int) -> np.ndarray:
        """64-bit hash of each word; 0 for longer ones."""
        size = self.end - self.start
        h = size.astype(np.uint64)
        live = np.flatnonzero(size <= longest)
        h[size > longest] = 0
        for k in range(longest):
            live = live[size[live] > k]
            if not len(live):
                break
            x = h[live] * np.uint64(0x9E3779B97F4A7C15) + self.data[self.start[live] + k]
            h[live] = x ^ x >> np.uint64(29)
        return h


class Phrases:
    """The windows of one block of items: vocabulary, windows by length, items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        column = pa.array([t for _, t in items], pa.large_string())
        words = Words(*flat(column))
        self.longest = int((words.end - words.start).max(initial=0))
        self.vocab, number = np.unique(words.hashes(self.longest), return_inverse=True)
        number = number + 1
        windows: dict[tuple, dict[str, None]] = {}
        for (item, _), first, last in zip(items, words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
            own = number[first:last].tolist()
            for k in range(max(0, len(own) - window) + 1 if own else 0):
                windows.setdefault(tuple(own[k : k + window]), {})[item] = None
        self.by_length = {}
        for size in sorted({len(w) for w in windows}):
            rows = [w for w in windows if len(w) == size]
            self.by_length[size] = np.array(rows, np.int64), [list(windows[w]) for w in rows]

    def search(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(length, window number, first word of the occurrence, items by window)."""
        if not len(self.vocab) or not len(words.start):
            return
        h = words.hashes(self.longest)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        symbol = np.where(self.vocab[at] == h, at + 1, 0)
        known = symbol > 0
        first = np.zeros(len(symbol) + 1, bool)
        first[words.of] = True
        opens = known & (first[:-1] | ~np.append(False, known[:-1]))
        word = np.flatnonzero(known)
        if not len(word):
            return
        breaks = opens[word]
        place = np.arange(len(word)) + np.cumsum(breaks)
        text = np.zeros(int(place[-1]) + 2, np.int64)
        text[place] = symbol[word]
        of = np.full(len(text), -1, np.int64)
        of[place] = word
        index = FMIndex(text, len(self.vocab))
        for size, (rows, items) in self.by_length.items():
            lo, hi = index.search(rows)
            n = hi - lo
            which = np.repeat(np.arange(len(rows)), n)
            if len(which):
                suffix = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                yield size, which, of[index.locate(suffix)], items


def _runs(mark: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of marked words inside one text."""
    edge = np.zeros(len(mark) + 1, bool)
    edge[of] = True
    first = np.flatnonzero(mark & ~(np.append(False, mark[:-1]) & ~edge[:-1]))
    last = np.flatnonzero(mark & ~(np.append(mark[1:], False) & ~edge[1:]))
    return first, last


def _scan(block, window: int):
    """Texts -> number of words, hit words, items hit, spans of hit words in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, window)
        for batch in steps(batches, limit=SHARD_BYTES):
            rows = batch.num_rows
            column = batch.column(batch.schema.get_field_index("text"))
            data, offsets = flat(column)
            words = Words(data, offsets)
            step = np.zeros(len(words.start) + 1, np.int64)
            found: list[set] = [set() for _ in range(rows)]
            for size, which, word, items in phrases.search(words):
                np.add.at(step, word, 1)
                np.add.at(step, word + size, -1)
                doc = np.searchsorted(words.of, word, side="right") - 1
                pairs = np.unique(doc * np.int64(len(items)) + which)
                for d, w in zip((pairs // len(items)).tolist(), (pairs % len(items)).tolist(), strict=True):
                    found[d].update(items[w])
            mark = np.cumsum(step[:-1]) > 0
            known = batch.column(batch.schema.get_field_index("state"))
            if known.null_count < rows:  # hits of the blocks before
                for d, old in enumerate(known.to_pylist()):
                    if old:
                        found[d].update(old["items"])
                        mark[words.of[d] + np.array(old["words"], np.int64)] = True
            hits = np.append(0, np.cumsum(mark))[words.of]
            first, last = _runs(mark, words.of)
            head = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before a byte
            start, end = head[words.start[first]], head[words.end[last]]
            spans = [[] for _ in range(rows)]
            for d, s, e in zip((np.searchsorted(words.of, first, side="right") - 1).tolist(), start.tolist(), end.tolist(), strict=True):
                base = int(head[offsets[d]])
                spans[d].append({"start": s - base, "end": e - base})
            numbers = [(np.flatnonzero(mark[a:b])).tolist() if f else [] for a, b, f in zip(words.of[:-1].tolist(), words.of[1:].tolist(), found, strict=True)]
            state = [
                {"n_words": int(n), "n_hit": int(h), "items": sorted(i), "spans": s, "words": w}
                for n, h, i, s, w in zip(np.diff(words.of), np.diff(hits), found, spans, numbers, strict=True)
            ]
            state = pa.array(state, _STATE)
            yield pa.RecordBatch.from_arrays(
                [state if n == "state" else batch.column(k) for k, n in enumerate(batch.schema.names)],
                names=batch.schema.names,
            )

    return run


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_STATE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)), ("words", pa.list_(pa.int64()))]
)
_STATE_SQL = (
    "struct<n_words: long, n_hit: long, items: array<string>,"
    " spans: array<struct<start: long, end: long>>, words: array<long>>"
)


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list]:
    """The items in lists of bounded bytes, one at a time on the driver."""
    block, held = [], 0
    rows = items.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.col(f"`{text_col}`")
    ).filter(F.col(f"`{text_col}`").isNotNull())
    for item, text in rows.toLocalIterator():
        if block and held + len(text) > limit:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep_rows: bool = False,
) -> DataFrame:
    """Per row: the id, n_words, n_hit, items (sorted ids), spans (code points, end exclusive) and
    contaminated; with ``keep_rows`` also ``row``, the given row as a struct."""
    if window < 1:
        raise ValueError("a window has at least one word")
    context = docs.sparkSession.sparkContext
    seen = docs.select(
        integer_id(docs, id_col).alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []),
        F.lit(None).cast(_STATE_SQL).alias("state"),
    )
    for block in _blocks(items, item_id_col, item_text_col, block_bytes):
        seen = seen.mapInArrow(_scan(context.broadcast(block), window), seen.schema)
    return seen.select(
        F.col("id").alias(id_col), *(["row"] if keep_rows else []), "state.n_words", "state.n_hit", "state.items", "state.spans",
        (F.col("state.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, as they are."""
    found = find_contamination(docs, items, keep_rows=True, **options)
    return found.filter("not contaminated").select("row.*")


def cut_spans(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """All rows of ``docs``, the removal spans cut out of their texts."""
    found = find_contamination(docs, items, text_col=text_col, keep_rows=True, **options)
    text = F.col(f"row.`{text_col}`")
    kept = F.aggregate(
        F.reverse("spans"),
        text,
        lambda t, s: F.concat(
            t.substr(F.lit(1), s["start"].cast("int")),
            t.substr((s["end"] + 1).cast("int"), F.length(t)),
        ),
    )
    columns = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)
