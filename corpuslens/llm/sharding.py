"""Balanced label propagation: linked documents move together, shard sizes stay even.

Documents with equal texts are linked.  Every document starts in a shard by hash.  A group of more
rows than a shard holds is cut, by rank inside the group, into parts of equal size that fit; any other
group is one part.  Then, round after round, each part that is not settled asks for the shard that
most of its documents are in, among those with room for all of it.  A shard takes the largest askers
first, whole parts or none, up to its quota; the refused ask again for what has room by then, until
nothing is granted.  Large parts ask before smaller ones (``PHASES``), so that they still find room.
Documents without links, and parts that found no room as a whole, fill what is left in order, so counts
end at most one apart: the law ``rows``.

Rounds work on one row per part.  Ranks and running sums come from sums per bucket and a window inside
a bucket, so no shard or group is ordered by one task.  Joins on a group or part take those of more than
a thousandth of all rows (a thousand at most) by broadcast, and rows without links never meet a join,
so no key is hot.  Only figures per shard reach the driver.

Cases: a null text has size 1 and is linked with nothing; empty texts are equal texts; rows without an
id and repeated rows are placed like any other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import integer_id
from corpuslens.session import durable

SHARDS = 16
#: Hash buckets per key in which rows are ranked.
RANK_BUCKETS = 1024
#: Least size of the parts that ask in a phase, as a divisor of a shard's rows.
PHASES = (2, 8, 32, 128)
#: A group or part of more than this share of all rows is joined by broadcast.
HEAVY = 1000


def ranked(df: DataFrame, keys: list[str], order: str, name: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """``df`` with a gapless rank from 0 within the keys, by bucket of the hash ``order``.

    Buckets are counted first; a task ranks one bucket of one key."""
    slot = F.pmod(F.shiftrightunsigned(order, 20), F.lit(buckets)).alias("_bucket")
    placed = df.select("*", slot)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, "row_hash")
    return (
        placed.select("*", (F.row_number().over(inside) - 1).alias("_own"))
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_own"))
        .drop("_bucket", "_own", "_start")
    )


def _up_to(asked: DataFrame) -> DataFrame:
    """``upto``: rows asked of the same shard by this part and all before it, larger ones first."""
    placed = asked.withColumn("_slot", F.pmod("tie", F.lit(64))).withColumn("_less", -F.col("rows"))
    sums = placed.groupBy("wish", "_less", "_slot").agg(F.sum("rows").alias("_sum"))
    below = Window.partitionBy("wish").orderBy("_less", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("wish", "_less", "_slot", F.coalesce(F.sum("_sum").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("wish", "_less", "_slot").orderBy("tie", "part").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_own", F.sum("rows").over(inside))
        .join(starts, ["wish", "_less", "_slot"])
        .withColumn("upto", F.col("_start") + F.col("_own"))
        .drop("_slot", "_less", "_own", "_start")
    )


def _by_shard(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _join_heavy(rows: DataFrame, known: DataFrame, key: str, heavy: Column) -> DataFrame:
    """``rows`` with the one row of ``known`` for their key; keys without one are left out.  Heavy
    keys, few by definition, are broadcast; the rest are shuffled."""
    light = known.filter(~heavy)
    large = F.broadcast(known.filter(heavy))
    return rows.join(large, key).unionByName(rows.join(large, key, "left_anti").join(light, key))


def _parts(linked: DataFrame, fit: int) -> DataFrame:
    """``part``: a group, or an equal share of one that is larger than a shard."""
    within = linked.filter(F.col("copies") <= fit).withColumn("part", F.xxhash64("group", F.lit(0)))
    over = ranked(linked.filter(F.col("copies") > fit), ["group"], "mix", "_rank")
    number = F.floor(F.col("_rank") * F.ceil(F.col("copies") / fit) / F.col("copies"))
    return within.unionByName(over.withColumn("part", F.xxhash64("group", number + 1)).drop("_rank"))


def _settle(parts: DataFrame, room: list[int], fit: int) -> tuple[DataFrame | None, list[int]]:
    """(part, shard) of all parts that found room as a whole, and the room left.

    ``parts``: part, rows, votes (documents of the part by the shard they start in)."""
    settled, open_parts = None, parts
    for least in (*(max(2, fit // p) for p in PHASES), 0):
        while True:
            # The shard with most of the part's documents, among those with room for all of it.
            choices = F.transform(
                F.zip_with("votes", _by_shard(room), lambda vote, free: F.when(free >= F.col("rows"), vote)),
                lambda vote, at: F.struct(vote.alias("vote"), F.xxhash64("part", at).alias("by"), at.alias("shard")),
            )
            wish = F.array_max(F.filter(choices, lambda c: c["vote"].isNotNull()))["shard"]
            asking = open_parts.filter(F.col("rows") >= least).withColumn("wish", wish).filter("wish is not null")
            asking = asking.withColumn("tie", F.xxhash64("part", "wish"))
            granted = durable(
                _up_to(asking).filter(F.col("upto") <= F.get(_by_shard(room), F.col("wish")))
                .select("part", F.col("wish").alias("shard"), "rows")
            )
            taken = {r["shard"]: r["n"] for r in granted.groupBy("shard").agg(F.sum("rows").alias("n")).collect()}
            if not taken:
                break
            room = [free - taken.get(at, 0) for at, free in enumerate(room)]
            settled = granted if settled is None else settled.unionByName(granted)
            open_parts = durable(open_parts.join(granted.select("part"), "part", "left_anti"))
    return settled, room


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
) -> DataFrame:
    """Per row: the id, size (bytes of the text plus 1), text_crc32, shard and slot."""
    if shards < 1:
        raise ValueError("there is at least one shard")
    text = F.col(f"`{text_col}`")
    base = docs.select(
        integer_id(docs, id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.md5(text.cast("binary"))).alias("group"),
        F.xxhash64(integer_id(docs, id_col), text).alias("row_hash"),
    )
    base = durable(base.withColumn("mix", F.xxhash64("row_hash", F.lit(1))))
    total = base.count()
    fit = max(1, total // shards)
    columns = ["id", "size", "text_crc32", "row_hash", "mix"]
    texts = base.filter("group is not null")
    groups = durable(texts.groupBy("group").agg(F.count("*").alias("copies"), F.min(F.struct(*columns)).alias("one")))
    sizes = groups.filter("copies > 1").select("group", "copies")
    linked = durable(_parts(_join_heavy(texts, sizes, "group", F.col("copies") * HEAVY > total), fit).select(*columns, "part"))
    alone = groups.filter("copies = 1").select("one.*").unionByName(base.filter("group is null").select(*columns))
    start = F.pmod("mix", F.lit(shards)).cast("int")
    parts = durable(
        linked.groupBy("part").agg(
            F.count("*").alias("rows"), F.array(*[F.count_if(start == at) for at in range(shards)]).alias("votes")
        )
    )
    room = [total // shards + (at < total % shards) for at in range(shards)]
    settled, room = _settle(parts, room, fit)
    if settled is None:
        placed, left = None, linked
    else:
        homes = durable(parts.select("part", "rows").join(settled.select("part", "shard"), "part", "left"))
        homed = durable(_join_heavy(linked, homes, "part", F.col("rows") * HEAVY > total))
        placed, left = homed.filter("shard is not null").select(*columns, "shard"), homed.filter("shard is null").select(*columns, "part")
    # What is left fills the room in order: parts that found none first, each in one piece if it can.
    rest = left.select(*columns, F.lit(0).alias("late"), F.xxhash64("part", F.lit(2)).alias("by")).unionByName(
        alone.select(*columns, F.lit(1).alias("late"), F.col("mix").alias("by"))
    )
    first = left.count()
    rank = F.col("rank") + F.when(F.col("late") == 1, first).otherwise(0)
    ends = [sum(room[: at + 1]) for at in range(shards)]
    filled = ranked(rest, ["late"], "by", "rank").withColumn(
        "shard", F.coalesce(*[F.when(rank < end, F.lit(at)) for at, end in enumerate(ends)])
    ).select(*columns, "shard")
    state = durable(filled if placed is None else filled.unionByName(placed))
    return ranked(state, ["shard"], "mix", "slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long")
    )
