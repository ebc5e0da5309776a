"""Bounded-space online packing of tokenised documents into windows of fixed width.

Each partition keeps a fixed number of open windows.  A document fills whole windows first; its
rest goes to the fullest window that still has room (best fit).  Where none has, the fullest is
topped up with the head of that rest and emitted, so an emitted window has no padding.  What is
open at the end of the partitions is merged, whole windows at a time, in groups of partitions.

Cases: a null or empty text has the end id alone; a repeated row is packed again; an empty table
gives no rows; other columns are ignored; a text of any length is cut into as many windows as it
needs.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import integer_id, steps, type_of
from corpuslens.session import durable

WIDTH = 2048
END_ID = 1
OPEN_WINDOWS = 16
#: Partitions whose open windows are merged by one task.
MERGE_PARTITIONS = 256
#: Words that a worker remembers with their ids; beyond it, it starts anew.
KNOWN_WORDS = 500_000

# Texts of these characters are lower-cased and split alike by Python and by the tokenizer.
_PLAIN = re.compile("[\n\t -~¡-ÿ]*")
_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
)
_MARK_AT_MARK = re.compile(r"[^a-z0-9ªµºß-öø-ÿ²³¹¼-¾\s][.,]")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


class _Words(dict):
    """Word -> its ids as bytes; an unknown word is tokenised when it is first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = array("I")
        for piece in [word] if word.isalpha() else _PIECES.findall(word):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.letters)
            found.extend([x.id for x in self.model.tokenize(piece)])
        self[word] = ids = found.tobytes()
        return ids


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Plain texts are tokenised word by word through a table of known words, as no token spans
    white space; any other text goes to the tokenizer as it is."""

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), known
        self.words = _Words(self.tokenizer.model)

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.words) > self.known:
            self.words = _Words(self.tokenizer.model)
        text = text.lower()
        if not _MARK_AT_MARK.search(text):  # a lone mark at a word's end is a token of its own
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . \n")
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), np.uint32)


class _Space:
    """The open windows of one partition."""

    def __init__(self, width: int, windows: int, number: int):
        self.width, self.windows = width, windows
        self.open: list[list] = []  # [fill, sequence]
        self.next = number << 32

    def new(self) -> list:
        self.next += 1
        return [0, self.next - 1]

    def place(self, tokens: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of each piece of a document of so many tokens."""
        start = 0
        while tokens - start >= self.width:
            yield start, self.width, self.new()[1], 0
            start += self.width
        while start < tokens:
            rest = tokens - start
            fits = [w for w in self.open if w[0] + rest <= self.width]
            if fits:
                into = max(fits)
            elif len(self.open) < self.windows:
                self.open.append(into := self.new())
            else:
                into, rest = (w := max(self.open)), self.width - w[0]
            yield start, rest, into[1], into[0]
            start += rest
            into[0] += rest
            if into[0] == self.width:
                self.open.remove(into)


def _packer(path: str, width: int, end_id: int, windows: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        number = TaskContext.get().partitionId()
        space = _Space(width, windows, number)
        kind = None
        for batch in steps(batches):
            kind = batch.schema.field(0)
            cols: list[list] = [[] for _ in range(7)]
            rows, ids = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for start, length, sequence, offset in space.place(len(tokens)):
                    piece = tokens[start : start + length]
                    rows.append(row)
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                    for c, v in zip(cols, (start, length, zlib.crc32(piece.tobytes()), len(tokens), sequence, offset, number), strict=True):
                        c.append(v)
            found = [batch.column(0).take(pa.array(rows, pa.int64()))]
            found += [pa.array(c, pa.int64()) for c in cols]
            names = [kind.name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "dealer"]
            if with_ids:
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                found.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(len(rows), pa.int64())], names=[*names, "left_fill"])
        for fill, sequence in space.open:  # one row for each window that is still open
            row = {"sequence_id": sequence, "dealer": number, "left_fill": fill}
            names = [kind.name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "dealer"]
            cells = [pa.array([row.get(n)], kind.type if n == kind.name else pa.int64()) for n in names]
            if with_ids:
                cells.append(pa.nulls(1, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*cells, pa.array([fill], pa.int64())], names=[*names, "left_fill"])

    return run


def _merger(width: int):
    def run(left: pd.DataFrame) -> pd.DataFrame:
        """Best fit, largest first; a window moves as a whole."""
        bins: list[list[int]] = []
        moved = []
        for fill, sequence in sorted(zip(left.left_fill, left.sequence_id, strict=True), key=lambda x: (-x[0], x[1])):
            fits = [b for b in bins if b[0] + fill <= width]
            into = max(fits) if fits else None
            if into is None:
                bins.append(into := [0, sequence])
            moved.append((sequence, into[1], into[0]))
            into[0] += fill
        return pd.DataFrame(moved, columns=["sequence_id", "merged_id", "shift"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    end_id: int = END_ID,
    open_windows: int = OPEN_WINDOWS,
    merge_partitions: int = MERGE_PARTITIONS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the id, start (the document's ids before it), length, ids (on request),
    ids_crc32, doc_tokens, sequence_id and offset in that sequence.  Sequences shorter than the
    width are padded by the reader, unless their length is a power of two."""
    kind = type_of(docs, id_col)
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "dealer")
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{n}` long" for n in longs)
    schema += (", ids array<int>" if with_ids else "") + ", left_fill long"
    read = docs.select(integer_id(docs, id_col), F.col(f"`{text_col}`").alias("text"))
    dealt = durable(read.mapInArrow(_packer(tokenizer_path, width, end_id, open_windows, with_ids), schema))
    left = dealt.filter("left_fill is not null").select(
        F.floor(F.col("dealer") / merge_partitions).alias("group"), "sequence_id", "left_fill"
    )
    moves = left.groupBy("group").applyInPandas(
        _merger(width), "sequence_id long, merged_id long, shift long"
    )
    pieces = dealt.filter("left_fill is null")
    placed = pieces.join(moves, "sequence_id", "left")
    return placed.select(
        f"`{id_col}`", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens",
        F.coalesce("merged_id", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
