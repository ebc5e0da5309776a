"""Ordered per-key computations that never put a whole key into one task.

A plain window over ``key`` sorts all rows of the key in one task.  These helpers cut each key
into buckets along its order, work inside a bucket, and carry a small per-bucket summary across:
only one summary row per bucket ever meets in a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add ``name``: the 0-based position of the row (or the running ``weight`` before it) within
    ``keys``.  ``bucket`` must be non-decreasing along ``order``."""
    weight = F.lit(1) if weight is None else weight
    marked = df.withColumn("_bucket", bucket).withColumn("_weight", weight.cast("long"))
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset")
    )
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("_before", F.sum("_weight").over(within) - F.col("_weight"))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_before")).cast("int"))
        .drop("_bucket", "_weight", "_offset", "_before")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: str, bucket_rows: int = BUCKET
) -> DataFrame:
    """Replace nulls of ``value`` by the latest earlier non-null one within ``keys``; ``order`` is
    an integer column."""
    marked = df.withColumn("_bucket", F.floor(F.col(order) / bucket_rows))
    latest = (
        marked.where(F.col(value).isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(F.max_by(value, order).alias("_latest"))
    )
    # A bucket without any value still has to receive the carry, so all buckets take part.
    buckets = marked.groupBy(*keys, "_bucket").agg(F.lit(1).alias("_one"))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.join(latest, [*keys, "_bucket"], "left").select(
        *keys, "_bucket", F.last("_latest", ignorenulls=True).over(across).alias("_carried")
    )
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("_seen", F.last(value, ignorenulls=True).over(within))
        .join(carried, [*keys, "_bucket"])
        .withColumn(value, F.coalesce("_seen", "_carried"))
        .drop("_bucket", "_seen", "_carried")
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "_rank"
) -> DataFrame:
    """The first ``limit`` rows per key under ``order``; the limit is pushed below the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


