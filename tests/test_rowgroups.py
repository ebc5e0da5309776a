"""Row groups across buckets against a plain walk and against the one-value form."""

from __future__ import annotations

import random

import pytest
from support import table_cells

from corpuslens.operators import chunking, grids
from corpuslens.operators.rowgroups import greedy_groups
from corpuslens.sources import sections as sc

LINES = "t string, row long, at int, line string, words int, room int"


def walk(sizes, room):
    groups, at = [], 0
    while at < len(sizes):
        stop, used = at + 1, sizes[at]
        while stop < len(sizes) and used + sizes[stop] <= room:
            used += sizes[stop]
            stop += 1
        groups.append((at + 1, stop - at, used))
        at = stop
    return groups


@pytest.mark.parametrize("bucket_rows,fan", [(3, 2), (7, 3), (1024, 256)])
def test_groups_match_a_plain_walk(spark, bucket_rows, fan):
    rng = random.Random(bucket_rows)
    lists = {f"{k}": ([rng.choice([1, 1, 2, 3, 9, 30]) for _ in range(rng.choice([1, 2, 5, 40, 90]))], rng.choice([-3, 0, 1, 2, 5, 12, 29, 200])) for k in range(24)}
    rows = [(k, i * 2 // 3, i, " ".join(f"{k}.{i}.{j}" for j in range(n)), n, room) for k, (sizes, room) in lists.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    got = {}
    for r in greedy_groups(spark.createDataFrame(rows, LINES), ["t"], bucket_rows, fan).collect():
        got.setdefault(r.t, []).append(r)
    assert set(got) == set(lists)
    for k, (sizes, room) in lists.items():
        found = sorted(got[k], key=lambda r: r.group)
        assert [r.group for r in found] == list(range(len(found)))
        assert [(r["first"], r.lines, r.words) for r in found] == walk(sizes, room)
        for r in found:
            assert r.text == "\n".join(" ".join(f"{k}.{i}.{j}" for j in range(sizes[i])) for i in range(r["first"] - 1, r["first"] - 1 + r.lines))


def test_no_lines(spark):
    assert greedy_groups(spark.createDataFrame([], LINES), ["t"]).count() == 0


def shown(chunks):
    names = ("data_row_start", "data_row_end", "total_rows", "table_chunk_type", "caption", "chunk_index", "section_index")
    return sorted(
        (r.document_id, r.chunk_index, r.text, r.token_count, r.content_hash, *[str(r.meta[n]) for n in names])
        for r in chunks.collect()
    )


def test_rows_give_the_chunks_of_whole_texts(spark, monkeypatch):
    rng = random.Random(5)
    tables = {
        "caption only": [[("People", 2, None, None)], (["Name", "Role"], True), ["ann", "x"]],
        "lone header": [(["Name", "Role"], True)],
        "blank rows": [(["Name", "Role"], True), ["", ""], ["ann", "x"], [" ", ""]],
        "lines in cells": [(["Name", "Role"], True), ["ann\nb\n\n c", "x"], ["bob", "y y y y\nz"]],
        "two-line caption": [[("Peo\nName | Role\nple", 2, None, None)], (["Name", "Role"], True), ["ann", "x"], ["bob", "y"]],
        "caption is a row": [[("a b", 2, None, None)], (["Name", "Role"], True), ["a b", ""], ["Name", "Role"], ["q", "r"]],
        "header is caption": [[("Name | Role", 2, None, None)], (["Name", "Role"], True), ["ann", "x"]],
        "nested": [(["Name", "Role"], True), ["ann", ("x", 1, None, "deep er")], ["bob", "y"]],
        "empty": [[""]],
        "one column": [["only"], [""], ["rows here"]],
    }
    for k in range(4):
        tables[f"tall {k}"] = [(["Name", "Role"], True)] + [
            [" ".join("w" * rng.randint(1, 6) for _ in range(rng.choice([1, 1, 2, 8]))), str(i)] for i in range(rng.choice([30, 80]))
        ]
    cells = table_cells(spark, tables)
    want = shown(chunking.chunk_sections(sc.number_blocks(grids.table_blocks(cells)), 16, 2))
    blocks, rows = grids.table_parts(cells)
    # Buckets of four rows here, so groups span several of them.
    monkeypatch.setattr(chunking, "BUCKET_ROWS", 4)
    assert shown(chunking.chunk_sections(sc.number_blocks(blocks), 16, 2, table_rows=rows)) == want
