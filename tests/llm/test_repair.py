from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from corpuslens.llm import repair as rp
from corpuslens.llm.queries import op13_repair

ROWS = "conv_id long, turn long, role string, text string, audit string, conv string"


def cheapest(roles, faults):
    """By trying all edit sequences up to the cost of deleting everything."""
    best = (3 * len(roles), "D" * len(roles), ())

    def go(row, cost, audit, out):
        nonlocal best
        initials = "".join(r[:1] for r, _ in out)
        if (cost, audit) > best[:2] and cost >= best[0] or not re.fullmatch("s?(ua)*u?", initials):
            return
        if row == len(roles) and re.fullmatch("(s?(ua)+)?", initials) and (cost, audit) < best[:2]:
            best = (cost, audit, out)
        for role in ("user", "assistant"):
            go(row, cost + 2, audit + "I", (*out, (role, None)))
        if row == len(roles):
            return
        go(row + 1, cost + 3, audit + "D", out)
        if faults[row] in "bd":
            return
        left = faults[row] == "t"
        if roles[row][:1] in ("s", "u", "a"):
            go(row + 1, cost + left, audit + "K", (*out, (roles[row], row)))
        for role in ("user", "assistant"):
            go(row + 1, cost + 2 + left, audit + "R", (*out, (role, row)))

    go(0, 0, "", ())
    return best


def expected(rows):
    """Report of one conversation from (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = "", set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults += "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    roles = [r for _, r, _ in rows]
    cost, audit, out = cheapest(roles, faults)
    turns = {t for t, _, _ in rows if t is not None}
    lines = "\n".join(f"{role}:{'' if row is None else rows[row][2]}" for role, row in out)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(x[:1] + y[:1] not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])), cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
    )


def report(found):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in found.report.collect()
    }


@pytest.fixture(scope="module")
def conversations():
    import random

    rng = random.Random(5)
    made = []
    for conv in range(120):
        for _ in range(rng.randrange(1, 6)):
            turn = rng.choice((None, 0, 1, 2, 3, 9))
            role = rng.choice(("user", "assistant", "system", "user", "assistant", None, "", "tool", "support"))
            text = rng.choice(("a.", "b?", "c", "d e", "", " \n", None, "e!  \n", "x ", "é. "))
            made.append((conv, turn, role, text, "x", None))
    made += [(None, 1, "user", "q.", None, None), (None, None, None, None, None, None), (500, 4, "user", "long. " * 50000, "", "")]
    return made


def by_conversation(rows):
    grouped = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        grouped[conv].append((turn, role, text))
    return {conv: expected(part) for conv, part in grouped.items()}


def test_equals_trying_all_edits(spark, conversations):
    got = report(rp.repair(spark.createDataFrame(conversations, ROWS).repartition(5)))
    assert got == by_conversation(conversations)


def test_turns_are_the_repaired_conversation(spark, conversations):
    found = rp.repair(spark.createDataFrame(conversations, ROWS))
    want, lines, audits = report(found), defaultdict(list), defaultdict(str)
    for r in sorted(found.turns.collect(), key=lambda r: r["at"]):
        audits[r.conv_id] += r.edit
        if r.role is not None:
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, row in want.items():
        assert (audits[conv], hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest()) == (row[6], row[7])


def test_segments_give_the_same(spark, conversations, monkeypatch):
    """Every conversation of more than two rows as a large one, in segments of two rows."""
    monkeypatch.setattr(rp, "SEGMENT_BITS", 1)
    found = rp.repair(spark.createDataFrame(conversations, ROWS).repartition(3), large_rows=2)
    got = report(found)
    assert got == by_conversation(conversations)
    lines = defaultdict(list)
    for r in sorted(found.turns.collect(), key=lambda r: r["at"]):
        if r.role is not None:
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == row[7] for c, row in got.items())


def test_one_conversation_of_most_rows(spark):
    """A third is one row repeated; all else alternates."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k}.", None, None) for k in range(6000)]
    rows += [(1, 7000, "user", "same", None, None)] * 3000 + [(2, 0, "user", "a.", None, None)]
    got = report(rp.repair(spark.createDataFrame(rows, ROWS).repartition(6)))
    text = "\n".join([f"{('user', 'assistant')[k % 2]}:t{k}." for k in range(6000)])
    # The last user turn is cut (1) and needs an answer (2); deleting it costs 3 as well, and D comes first.
    assert got[1][1:7] == (0, 2999, 1, 2999, 3000 * 3, "K" * 6000 + "D" * 3000)
    assert got[1][7] == hashlib.sha256(text.encode()).hexdigest()
    assert got[2][5:7] == (2, "KI")


def test_damage_rule(spark, tmp_path):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "s. t"), ("user", "u?"), ("assistant", "a!")])]
    rows += [(None, None, None, None), (77, None, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        left[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in op13_repair(spark, str(tmp_path)).collect()
    }
    assert got == {conv: expected(part) for conv, part in left.items()}


def test_empty(spark):
    found = rp.repair(spark.createDataFrame([], ROWS))
    assert found.report.count() == 0 and found.turns.count() == 0
