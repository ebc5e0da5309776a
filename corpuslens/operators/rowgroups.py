"""Greedy groups of consecutive lines that span tasks.

A group takes one line, then every further line that keeps its words within the room of its list.
Where a group begins depends on all groups before it, so a plain walk needs the whole list in one
task.  Here a list is cut into buckets of consecutive lines.  All a bucket needs to know is how many
words the group that is open at its start has taken; for each such number, ``bucket_map`` tells the
words that are open at its end and how many groups begin in it.  Maps are composed by levels of
``FAN`` buckets, so what meets in one place is a map per bucket, never its lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import durable

BUCKET_ROWS = 1024
FAN = 256

MAP = T.StructType(
    [T.StructField("open", T.ArrayType(T.IntegerType())), T.StructField("begun", T.ArrayType(T.LongType()))]
)
PIECES = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("begun", "first", "lines", "words")])
)


def _next_starts(words: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, jump): the running sum, and for a group that begins at a line where the next begins."""
    ends = np.cumsum(words, dtype=np.int64)
    jump = np.searchsorted(ends, ends - words + room, side="right")
    return ends, np.maximum(jump, np.arange(len(words)) + 1)


def _map_of(words: np.ndarray, room: int) -> dict:
    """For 1 to ``room`` words open at the start (the last of them: full, or none open): words open
    at the end, cut at ``room``, and groups begun."""
    states, n = max(room, 1), len(words)
    ends, jump = _next_starts(words, room)
    left, begun = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        at = jump[i]
        if at >= n:
            left[i], begun[i] = min(ends[-1] - ends[i] + words[i], states), 1
        else:
            left[i], begun[i] = left[at], begun[at] + 1
    taken = np.arange(1, states + 1)
    first = np.where(taken == states, 0, np.searchsorted(ends, room - taken, side="right"))
    inside = np.minimum(first, n - 1)
    through = first >= n
    return {
        "open": np.where(through, np.minimum(taken + ends[-1], states), left[inside]).astype(np.int32),
        "begun": np.where(through, 0, begun[inside]),
    }


@F.pandas_udf(MAP)
def bucket_map(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The map of each bucket of line sizes for the room of its list."""
    for sizes, room in parts:
        yield pd.DataFrame([_map_of(np.asarray(s), int(r)) for s, r in zip(sizes, room)], columns=["open", "begun"])


@F.pandas_udf(PIECES)
def bucket_pieces(sizes: pd.Series, room: pd.Series, taken: pd.Series) -> pd.Series:
    """Each bucket cut into the parts of groups that lie in it, ``taken`` words being open at its
    start; ``begun`` counts the groups begun in the bucket, so 0 is what the open group still takes."""
    out = []
    for line_words, limit, used in zip(sizes, room, taken):
        words, limit, used = np.asarray(line_words), int(limit), int(used)
        ends, jump = _next_starts(words, limit)
        at = 0 if used >= max(limit, 1) else int(np.searchsorted(ends, limit - used, side="right"))
        pieces = [(0, 0, at, int(ends[at - 1]))] if at else []
        while at < len(words):
            stop = int(jump[at])
            pieces.append((pieces[-1][0] + 1 if pieces else 1, at, stop - at, int(ends[stop - 1] - ends[at] + words[at])))
            at = stop
        out.append([dict(zip(("begun", "first", "lines", "words"), p)) for p in pieces])
    return pd.Series(out)


def _after(entry: Column, step: Column) -> Column:
    """The entry of the bucket behind one with the map ``step``."""
    at = entry["taken"] - 1
    return F.struct(
        F.get(step["open"], at).cast("int").alias("taken"),
        (entry["groups"] + F.get(step["begun"], at)).alias("groups"),
    )


def _entries(start: Column, members: Column) -> Column:
    """Members (at, map) in order, each with the words and groups it is entered with."""
    none = F.array().cast("array<struct<at:long,entry:struct<taken:int,groups:bigint>>>")
    walked = F.aggregate(
        members,
        F.struct(start.alias("entry"), none.alias("done")),
        lambda acc, m: F.struct(
            _after(acc["entry"], m["map"]).alias("entry"),
            F.concat(acc["done"], F.array(F.struct(m["at"].alias("at"), acc["entry"].alias("entry")))).alias("done"),
        ),
    )
    return walked["done"]


def _composed(members: Column) -> Column:
    """One map for all members in order."""
    rest = F.slice(members, 2, F.size(members))
    return F.aggregate(
        rest,
        F.get(members, F.lit(0))["map"],
        lambda acc, m: F.struct(
            F.transform(acc["open"], lambda o: F.get(m["map"]["open"], o - 1)).alias("open"),
            F.zip_with(
                acc["begun"], acc["open"], lambda b, o: b + F.get(m["map"]["begun"], o - 1)
            ).alias("begun"),
        ),
    )


def _bucket_entries(maps: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """(keys, bucket, taken, groups) from (keys, bucket, room, map): maps are composed per ``fan``
    buckets, the composed ones walked, then the buckets in each."""
    packed = durable(
        maps.withColumn("_upper", F.floor(F.col("bucket") / fan))
        .groupBy(*keys, "_upper")
        .agg(
            F.first("room").alias("room"),
            F.array_sort(F.collect_list(F.struct(F.col("bucket").alias("at"), "map"))).alias("members"),
        )
        .withColumn("whole", _composed(F.col("members")))
    )
    start = F.struct(F.greatest("room", F.lit(1)).cast("int").alias("taken"), F.lit(0).cast("long").alias("groups"))
    upper = (
        packed.groupBy(*keys)
        .agg(
            F.first("room").alias("room"),
            F.array_sort(F.collect_list(F.struct(F.col("_upper").alias("at"), F.col("whole").alias("map")))).alias("steps"),
        )
        .select(*keys, F.explode(_entries(start, F.col("steps"))).alias("step"))
        .select(*keys, F.col("step.at").alias("_upper"), F.col("step.entry").alias("_start"))
    )
    return (
        packed.join(upper, [*keys, "_upper"])
        .select(*keys, F.explode(_entries(F.col("_start"), F.col("members"))).alias("step"))
        .select(*keys, F.col("step.at").alias("bucket"), "step.entry.taken", "step.entry.groups")
    )


def greedy_groups(
    lines: DataFrame, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS, fan: int = FAN
) -> DataFrame:
    """(keys, group, first, lines, words, text): the groups of every list, numbered from 0, with the
    1-based place of their first line, and their lines joined by newlines.

    ``lines``: keys, ``row`` (long, 0 or more; lines of one row keep their order by ``at``), ``at``,
    ``line`` (not blank), ``words`` of it, and ``room``, equal in a list.  Lists without lines have no
    group.  A room below 1 puts each line into a group of its own.  A group's text is one value: at
    most ``room`` words, or one line."""
    keys = list(keys)
    buckets = durable(
        lines.withColumn("bucket", F.floor(F.col("row") / bucket_rows))
        .groupBy(*keys, "bucket")
        .agg(
            F.first("room").alias("room"),
            F.array_sort(F.collect_list(F.struct("row", "at", "line", "words"))).alias("_items"),
        )
        .select(
            *keys, "bucket", "room", F.size("_items").alias("count"),
            F.col("_items.line").alias("texts"), F.col("_items.words").alias("sizes"),
        )
    )
    wide = buckets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    maps = buckets.join(wide, keys, "left_semi").select(
        *keys, "bucket", "room", bucket_map("sizes", "room").alias("map")
    )
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = buckets.select(
        *keys, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    entered = (
        buckets.join(places, [*keys, "bucket"])
        .join(_bucket_entries(maps, keys, fan), [*keys, "bucket"], "left")
        .withColumn("taken", F.coalesce("taken", F.greatest("room", F.lit(1))).cast("int"))
        .withColumn("groups", F.coalesce("groups", F.lit(0)))
    )
    cut = entered.withColumn("_pieces", bucket_pieces("sizes", "room", "taken"))
    piece = F.col("piece")
    pieces = cut.select(
        *keys, "bucket", "texts", "groups", "_before", "count", F.explode("_pieces").alias("piece")
    ).select(
        *keys,
        (F.col("groups") + piece["begun"] - 1).alias("group"),
        "bucket",
        (F.col("_before") + piece["first"] + 1).alias("first"),
        piece["lines"].alias("lines"),
        piece["words"].alias("words"),
        F.array_join(F.slice("texts", piece["first"] + 1, piece["lines"]), "\n").alias("text"),
        # Only a bucket's open ends can belong to a group of several buckets.
        ((piece["begun"] == 0) | (piece["first"] + piece["lines"] == F.col("count"))).alias("_edge"),
    )
    out = [*keys, "group", "first", "lines", "words", "text"]
    joined = (
        pieces.where("_edge")
        .groupBy(*keys, "group")
        .agg(
            F.min("first").alias("first"),
            F.sum("lines").cast("int").alias("lines"),
            F.sum("words").cast("int").alias("words"),
            F.array_join(F.array_sort(F.collect_list(F.struct("bucket", "text")))["text"], "\n").alias("text"),
        )
    )
    return pieces.where("not _edge").select(*out).unionByName(joined.select(*out))
