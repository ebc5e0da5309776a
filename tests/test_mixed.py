"""The mixed-store queries meet the cases they claim, on the given tables."""

from __future__ import annotations

import pytest

from corpuslens.catalog import load

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queries():
    return load()[0]


def test_companions_shared_tables_and_cuts(spark, queries):
    rows = queries["expanded_context"](spark, SF_DIR).collect()
    assert any(r.chunk_id.endswith(":0000") for r in rows)  # the text beside a table
    assert any(r.facets == "0,1" for r in rows)  # one table for two facets
    assert {r.is_partial for r in rows} == {True, False}
    # Rows that a group covers never stand beside it.
    assert not any(r.chunk_id.endswith(":0003") for r in rows)


def test_overlaps_are_dropped(spark, queries):
    """Of a group and the rows in it only the one asked for first is left."""
    rows = queries["mixed_evidence"](spark, SF_DIR).collect()
    chosen = {}
    for r in rows:
        chosen.setdefault(r.query_id, set()).add(int(r.chunk_id[-4:]))
    assert any(1 in c for c in chosen.values()) and any(3 in c for c in chosen.values())
    assert not any({1, 3} <= c for c in chosen.values())


def test_notes_name_cut_tables(spark, queries):
    notes = [r.note for r in queries["facet_notes"](spark, SF_DIR).collect()]
    assert any("is partial; provided rows" in n for n in notes) and any("is partial" not in n for n in notes)


def test_modes_use_their_routes(spark, queries):
    rows = queries["mixed_modes"](spark, SF_DIR).collect()
    kinds = {(int(r.query_id) % 3, r.vector_score is None, r.keyword_score is None) for r in rows}
    assert {k for k in kinds if k[0] == 0} == {(0, False, True)} and {k for k in kinds if k[0] == 1} == {(1, True, False)}
    assert any(k[0] == 2 for k in kinds)
