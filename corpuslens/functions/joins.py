"""Joins whose strategy follows a measured size instead of an estimate.

Estimates do not see how far an explode or a Python stage multiplies rows, so an unhinted join may
broadcast the corpus side.  Here the small side is measured up to a bound of rows and of bytes:
within both, it is broadcast; beyond either, both sides are shuffled and adaptive execution splits
skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: texts and lists by their length, all else eight."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            inner = F.transform(column, lambda x: _bytes(x, kind.elementType))
            total = F.aggregate(inner, F.lit(0).cast("long"), lambda s, x: s + x)
        else:
            total = F.size(column).cast("long") * 8
        return F.greatest(F.coalesce(total, F.lit(0)), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        total = F.lit(8).cast("long")
        for field in kind.fields:
            total = total + _bytes(column.getField(field.name), field.dataType)
        return total
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + _bytes(F.map_values(column), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a frame stays within both bounds; no more rows than the bound are looked at."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        total = total + _bytes(F.col(f"`{field.name}`"), field.dataType)
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_small(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``large`` join ``small``; reading ``small`` must be cheap, as it is measured first."""
    if is_small(small, max_rows, max_bytes):
        return large.join(F.broadcast(small), list(on), how)
    return large.join(small.hint("merge"), list(on), how)


def of_asked_projects(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks of the projects that are asked about; on a store written by project the others are
    not even read."""
    asked = queries.select("project_id").distinct()
    return join_small(chunks, asked, ["project_id"], "left_semi")
