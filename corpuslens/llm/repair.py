"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``: perhaps one system turn,
then user and assistant in turn.  The cheapest repair is the lightest derivation of a weighted
hypergraph.  An item ``(i, q)`` says that ``i`` rows are dealt with and the grammar stands in state
``q``; given rows are axioms.  A deduction takes an item and a row (kept, given another role or
deleted), or an item alone (an empty turn inserted), to the next item.  Its weight is the pair (cost,
audit): costs add up and the edit's initial is appended, so a consequent is never lighter than an
antecedent (superior), and of two derivations of one item the lighter stays lighter however it goes
on (monotone: equal cost means that neither audit is a beginning of the other).  Hence the agenda may
finalise items in the order in which they are popped, and stops at the goal.

Conversations of usual size meet in one row each.  A conversation of more rows or bytes than
``LARGE_ROWS`` or ``LARGE_BYTES`` is ranked by a range partitioning and cut into segments; the agenda
solves each segment from all four states, and a second agenda run over segments as axioms chains
them.  The memory of that last run is the size of the answer (the audit is one value); a digest of
SHA-256 is sequential by nature and streams through one task per conversation.

Order within a conversation: turn (nulls first), role, text (in large ones: 64 characters of it, then
its hash).  Cases: a null role or text is one space; a role that begins with none of ``s``, ``u``,
``a`` (also an empty one) cannot be kept; an empty text is blank; rows without conversation id form
one conversation; repeated rows are duplicates; a text of any length is judged whole; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.joins import join_small
from corpuslens.session import durable

LARGE_ROWS = 2048
LARGE_BYTES = 8 << 20
#: Rows of a segment, as a power of two.
SEGMENT_BITS = 10

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
UNFINISHED = 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> {initial: next state}
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GOALS = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED, SOUND = "bdt-"
_SPACE = " \t\n\x0b\x0c\r"

_STEP = "struct<row:int,edit:string,role:string>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


class Repair(NamedTuple):
    """``report``: one row per conversation; ``turns``: one per edit, in order of ``at``."""

    report: DataFrame
    turns: DataFrame


def deductions(initials: list[str], faults: str, row: int, state: int) -> Iterator[tuple]:
    """(row, state, cost, letter) of each consequent of an item."""
    for initial in ROLE:
        if initial in NEXT[state]:
            yield row, NEXT[state][initial], COST[INSERT], INSERT
    if row == len(initials):
        return
    yield row + 1, state, COST[DELETE], DELETE
    if faults[row] in (BLANK, DUPLICATE):
        return
    left = UNFINISHED if faults[row] == TRUNCATED else 0
    for initial, after in NEXT[state].items():
        if initial == initials[row]:
            yield row + 1, after, COST[KEEP] + left, KEEP
        elif initial in ROLE:
            yield row + 1, after, COST[REROLE] + left, REROLE


def lightest(initials: list[str], faults: str, start: int = START, goals=GOALS, every: bool = False):
    """Weight (cost, audit) by final state, of the lightest goal or of every goal."""
    final: set[tuple[int, int]] = set()
    known = {(0, start): (0, "")}
    agenda = [(0, "", 0, start)]
    found = {}
    while agenda:
        cost, audit, row, state = heapq.heappop(agenda)
        if (row, state) in final:
            continue
        final.add((row, state))
        if row == len(initials) and state in goals:
            found[state] = (cost, audit)
            if not every or len(found) == len(goals):
                break
        for to_row, to_state, more, letter in deductions(initials, faults, row, state):
            item, weight = (to_row, to_state), (cost + more, audit + letter)
            if item not in final and (item not in known or weight < known[item]):
                known[item] = weight
                heapq.heappush(agenda, (*weight, *item))
    return found


def replay(initials: list[str], roles: list[str], audit: str, state: int = START) -> list[dict]:
    """The edits of an audit: the row each one deals with (none for an insertion) and the role after
    it (none for a deletion).  The grammar leaves no choice of role."""
    edits, row = [], 0
    for letter in audit:
        if letter == DELETE:
            edits.append({"row": row, "edit": letter, "role": None})
        elif letter == KEEP:
            edits.append({"row": row, "edit": letter, "role": roles[row]})
            state = NEXT[state][initials[row]]
        else:
            initial = "a" if state == USER else "u"
            edits.append({"row": None if letter == INSERT else row, "edit": letter, "role": ROLE[initial]})
            state = NEXT[state][initial]
        row += letter != INSERT
    return edits


def faults_of(roles: list[str], texts: list[str]) -> str:
    """The first fault of each row, as a letter."""
    seen, found = set(), []
    for role, text in zip(roles, texts, strict=True):
        bare = text.rstrip(_SPACE)
        if not bare:
            fault = BLANK
        elif (role, text) in seen:
            fault = DUPLICATE
        else:
            fault = SOUND if bare[-1] in ".!?" else TRUNCATED
        seen.add((role, text))
        found.append(fault)
    return "".join(found)


def _illegal(initials: list[str]) -> int:
    return sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation: counts, audit and edits beside the rows."""
    for batch in batches:
        columns: dict[str, list] = {name: [] for name in (*_COUNTS, "audit", "edits")}
        for rows in batch.column("rows"):
            roles = [r["role"].as_py() for r in rows]
            texts = [r["text"].as_py() for r in rows]
            initials, faults = [r[:1] for r in roles], faults_of(roles, texts)
            ((cost, audit),) = lightest(initials, faults).values()
            for name, letter in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
                columns[name].append(faults.count(letter))
            columns["illegal"].append(_illegal(initials))
            columns["cost"].append(cost)
            columns["audit"].append(audit)
            columns["edits"].append(replay(initials, roles, audit))
        kinds = [pa.int64()] * len(_COUNTS) + [pa.string(), pa.list_(pa.struct([("row", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True))],
            names=[*batch.schema.names, *columns],
        )


def _solve_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment: the lightest derivations from each state to each state."""
    paths = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        illegal, first, last, found = [], [], [], []
        for rows in batch.column("rows").to_pylist():
            initials, faults = [r["role"][:1] for r in rows], "".join(r["fault"] for r in rows)
            illegal.append(_illegal(initials))
            first.append(initials[0])
            last.append(initials[-1])
            found.append(
                [
                    {"start": start, "end": end, "cost": cost, "audit": audit}
                    for start in range(4)
                    for end, (cost, audit) in lightest(initials, faults, start, range(4), every=True).items()
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("segment"), pa.array(illegal, pa.int64()), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(found, paths)],
            names=["conv", "segment", "illegal", "first", "last", "paths"],
        )


def chain(segments: list[list[dict]]) -> tuple[int, str, list[int]]:
    """Lightest derivation over segments as axioms: an item is (segments chained, state).  Returns cost,
    audit and the state in which each segment is entered."""
    final: dict[tuple[int, int], tuple[int, int] | None] = {}
    agenda = [(0, "", 0, START, None)]
    while agenda:
        cost, audit, at, state, before = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final[at, state] = before
        if at == len(segments) and state in GOALS:
            entered, item = [], before
            while item is not None:
                entered.append(item[1])
                item = final[item]
            return cost, audit, entered[::-1]
        for path in segments[at] if at < len(segments) else ():
            if path["start"] == state and (at + 1, path["end"]) not in final:
                heapq.heappush(agenda, (cost + path["cost"], audit + path["audit"], at + 1, path["end"], (at, state)))
    raise AssertionError("deleting every row is always a repair")


def _chain_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and segment.  Per conversation its totals, per segment its part."""
    held: dict = {"conv": None}

    def done() -> Iterator[pa.RecordBatch]:
        if not held.get("segments"):
            return
        cost, audit, entered = chain(held["paths"])
        exits = [*entered[1:], None]
        parts = []
        for paths, start, end in zip(held["paths"], entered, exits, strict=True):
            at = sum(map(len, parts))
            fits = [p["audit"] for p in paths if p["start"] == start and (p["end"] == end or end is None)]
            parts.append(next(a for a in fits if audit.startswith(a, at) and (end is not None or at + len(a) == len(audit))))
        rows = [(held["conv"], None, held["illegal"], cost, audit, None)]
        rows += [(held["conv"], s, None, None, a, q) for s, a, q in zip(held["segments"], parts, entered, strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["conv", "segment", "illegal", "cost", "audit", "state"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != held["conv"]:
                yield from done()
                held = {"conv": row["conv"], "segments": [], "paths": [], "illegal": 0, "last": None}
            if held["last"] is not None:
                held["illegal"] += held["last"] + row["first"] not in LEGAL
            held["segments"].append(row["segment"])
            held["paths"].append(row["paths"])
            held["illegal"] += row["illegal"]
            held["last"] = row["last"]
    yield from done()


def _replay_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edit = pa.list_(pa.struct([("pos", pa.int64()), ("step", pa.int32()), ("row", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            roles = [r["role"] for r in row["rows"]]
            edits = replay([r[:1] for r in roles], roles, row["audit"], row["state"])
            for step, e in enumerate(edits):
                e["step"], e["pos"] = step, None if e["row"] is None else row["rows"][e["row"]]["pos"]
            found.append(edits)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("segment"), pa.array(found, edit)], names=["conv", "segment", "edits"])


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation in order; only the running digest is held."""
    conv, digest, out = None, None, []
    for batch in batches:
        for key, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if key != conv:
                if digest:
                    out.append((conv, digest.hexdigest()))
                conv, digest = key, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
    if digest:
        out.append((conv, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[at] for r in out], pa.string()) for at in range(2)], names=["conv", "repaired_sha256"]
    )


def _shares(rows: DataFrame) -> DataFrame:
    """Rows, bytes and missing turns of each conversation."""
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return rows.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.count("*").alias("n"),
        F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"),
    )


def _usual(rows: DataFrame, shares: DataFrame) -> Repair:
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    kinds = ", ".join(f"{n} long" for n in _COUNTS)
    solved = grouped.mapInArrow(
        _solve, f"conv string, rows {grouped.schema['rows'].dataType.simpleString()}, {kinds}, audit string, edits array<{_STEP}>"
    )

    def line(e: Column) -> Column:
        return F.concat(e["role"], F.lit(":"), F.when(e["row"].isNull(), "").otherwise(F.get("rows", e["row"])["text"]))

    lines = F.transform(F.filter("edits", lambda e: e["role"].isNotNull()), line)
    solved = durable(solved.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)))
    turns = solved.select("conv", "rows", F.posexplode("edits").alias("at", "e")).select(
        "conv", F.col("at").cast("long").alias("at"), F.get("rows", F.col("e.row"))["turn"].alias("turn"), "e.edit", "e.role",
        F.when(F.col("e.edit") == DELETE, None).when(F.col("e.row").isNull(), "").otherwise(F.get("rows", F.col("e.row"))["text"]).alias("text"),
    )
    return Repair(solved.select("conv", *_COUNTS, "audit", "repaired_sha256"), turns)


def _large(rows: DataFrame) -> Repair:
    start, fingerprint = F.substring("text", 1, 64), F.xxhash64("text")
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), start.asc(), fingerprint.asc(), F.asc("spread")]
    # Equal rows may be many; their order is of no account, so their place in the input parts them.
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    placed = durable(
        spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
        .withColumn("pos", F.monotonically_increasing_id())
        .withColumn("segment", F.shiftright("pos", SEGMENT_BITS))
    )
    bare = F.rtrim("text", F.lit(_SPACE))
    judged = placed.select(
        "conv", "segment", "pos", "role", (bare == "").alias("blank"), (~bare.rlike(r"[.!?]\z")).alias("cut"), F.sha2("text", 256).alias("print")
    )
    first = judged.filter("not blank").groupBy("conv", "role", "print").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    # By position, so that no text is a hot key of this join.
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    flagged = durable(judged.join(first, "pos", "left").select("conv", "segment", "pos", "role", fault.alias("fault")))
    counts = flagged.groupBy("conv").agg(
        *[F.count_if(F.col("fault") == letter).alias(name) for name, letter in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))]
    )
    segments = durable(flagged.groupBy("conv", "segment").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "fault"))).alias("rows")))
    solved = segments.mapInArrow(
        _solve_segments,
        "conv string, segment long, illegal long, first string, last string, paths array<struct<start:int,end:int,cost:long,audit:string>>",
    )
    chained = durable(
        solved.repartition("conv").sortWithinPartitions("conv", "segment")
        .mapInArrow(_chain_segments, "conv string, segment long, illegal long, cost long, audit string, state int")
    )
    parts = chained.filter("segment is not null").select("conv", "segment", "audit", "state")
    edits = segments.join(parts, ["conv", "segment"]).mapInArrow(
        _replay_segments, "conv string, segment long, edits array<struct<pos:long,step:int,row:int,edit:string,role:string>>"
    ).select("conv", "segment", F.explode("edits").alias("e")).select("conv", "segment", "e.step", "e.pos", "e.edit", "e.role")
    text = F.when(F.col("edit") == DELETE, None).when(F.col("edit") == INSERT, "").otherwise(F.col("text"))
    turns = durable(
        edits.join(placed.select("pos", "turn", "text"), "pos", "left").select(
            "conv", (F.shiftleft("segment", SEGMENT_BITS + 2) + F.col("step")).alias("at"), "turn", "edit", "role", text.alias("text")
        )
    )
    lines = turns.filter("role is not null").select("conv", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = lines.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "line").mapInArrow(_hash_lines, "conv string, repaired_sha256 string")
    report = chained.filter("segment is null").join(counts, "conv").join(digests, "conv", "left")
    empty = hashlib.sha256().hexdigest()
    return Repair(report.select("conv", *_COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")), turns)


def repair(
    rows: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    large_rows: int = LARGE_ROWS,
    large_bytes: int = LARGE_BYTES,
) -> Repair:
    """Cheapest repair of every conversation.

    ``report``: the id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    ``turns``: the id, ``at`` (ascending along a conversation), the turn of the given row, edit
    (K, R, D, I), role and text after it (null where deleted)."""
    given = rows.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_col}`").cast("string")), F.lit("")).alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"),
    )
    shares = durable(_shares(given))
    large = shares.filter((F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).select("conv")
    slim = given.drop("conv_id")
    if large.isEmpty():
        found = _usual(slim, shares)
    else:
        usual = _usual(join_small(slim, large, ["conv"], "left_anti"), shares)
        long = _large(join_small(slim, large, ["conv"], "left_semi"))
        found = Repair(usual.report.unionByName(long.report), usual.turns.unionByName(long.turns))
    ids = shares.select("conv", F.col("conv_id").alias(conv_col), "gaps")
    report = ids.join(found.report, "conv").drop("conv")
    turns = found.turns.join(ids.drop("gaps"), "conv").select(conv_col, "at", "turn", "edit", "role", "text")
    return Repair(report, turns)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn``, modulo 20: dropped (0), emptied (1), without
    ``.!?`` (2), repeated (3), role user (4).  Nulls are one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .filter("kind <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )
