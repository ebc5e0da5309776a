"""Helpers of the Arrow operators: bounded slices of a batch, and strings as flat bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one step of an operator holds; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows where the bytes of ``text`` reach the limit."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(flat(batch.column(batch.schema.get_field_index(text)))[1])
        part, first, held = 0, 0, 0
        for part, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(first, part - first)
                first, held = part, 0
            held += size
        yield batch.slice(first, part + 1 - first)


def integer_id(docs: DataFrame, name: str) -> Column:
    """The id column as it is; a frame without it is refused with a clear message."""
    if name not in docs.columns:
        raise ValueError(f"no column {name!r} among {docs.columns}")
    return F.col(f"`{name}`")


def type_of(docs: DataFrame, name: str) -> str:
    return docs.schema[name].dataType.simpleString()
