from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from support import table_cells

from corpuslens.functions import text as tx
from corpuslens.functions.ordered import carry_forward, dense_index
from corpuslens.operators import chunking, grids
from corpuslens.session import durable
from corpuslens.sources import sections as sc


def docs(spark, *texts):
    rows = [("p", str(i), f"{i}.txt", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "project_id string, document_id string, document_name string, text string"
    )


def test_text_section_lines_and_rejects(spark):
    found, rejected = sc.text_sections(docs(spark, "﻿\r\n  a  \r\n\r\nb\rc \n", " \n\t\n"))
    row = found.select("text", "meta.line_start", "meta.line_end").first()
    assert (row.text, row.line_start, row.line_end) == ("a\nb\nc", 2, 5)
    assert [r.document_id for r in rejected.collect()] == ["1"]


def test_window_chunks(spark):
    found, _ = sc.text_sections(docs(spark, "alpha beta gamma delta epsilon zeta eta theta"))
    rows = chunking.chunk_sections(found, 4, 2, single_section=True).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == [
        "alpha beta gamma delta", "gamma delta epsilon zeta", "epsilon zeta eta theta"
    ]
    again = chunking.chunk_sections(found, 4, 2).orderBy("chunk_index").collect()
    assert [r.content_hash for r in rows] == [r.content_hash for r in again]


@pytest.mark.parametrize("size, overlap", [(0, 0), (4, 4), (4, -1)])
def test_window_limits(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.chunk_text(sc.text_sections(docs(spark, "a"))[0], size, overlap)


def test_windows_match_a_plain_loop(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 6, 7, 8, 13, 50)]
    found, _ = sc.text_sections(docs(spark, *texts))
    got = {}
    for r in chunking.chunk_sections(found, 7, 3, single_section=True).collect():
        got.setdefault(r.document_id, {})[r.chunk_index] = r.text
    for i, text in enumerate(texts):
        words, start, want = text.split(), 0, []
        while True:
            want.append(" ".join(words[start : start + 7]))
            if start + 7 >= len(words):
                break
            start += 4
        assert [got[str(i)][k] for k in sorted(got[str(i)])] == want


def blocks(spark, tables):
    return sc.number_blocks(grids.table_blocks(table_cells(spark, tables)))


def test_row_groups_repeat_caption_and_header(spark):
    found = blocks(
        spark,
        {"d": [[("People", 2, None, None)], (["Name", "Role"], True), ["ann", "x"], ["bob", "y"], ["cy", "z"], ["di", "w"]]},
    )
    rows = chunking.chunk_sections(found, 10, 2).where("meta.type = 'table'").orderBy("chunk_index")
    got = [(r.text.split("\n")[:2], r.meta.data_row_start, r.meta.data_row_end, r.meta.total_rows, r.meta.table_chunk_type) for r in rows.collect()]
    assert got == [
        (["People", "Name | Role"], 1, 2, 4, "table_group"),
        (["People", "Name | Role"], 3, 4, 4, "table_group"),
    ]


def test_small_table_is_one_whole_chunk(spark):
    found = blocks(spark, {"d": [(["Name", "Role"], True), ["ann", "x"]]})
    row = chunking.chunk_table(found.where("meta.type = 'table'"), 100).first()
    assert (row.meta.table_chunk_type, row.meta.data_row_start, row.meta.data_row_end) == ("table", 1, 1)


def test_grid_spans_merges_and_nested_text(spark):
    cells = table_cells(
        spark,
        {"d": [["a", ("b", 2, None, None)], [("", 1, "continue", None), "c"], [("", 1, "continue", None), ("", 1, None, "deep"), "e"]]},
    )
    rows = grids.expand_grid(cells).orderBy("row_index").collect()
    assert [list(r["values"]) for r in rows] == [
        ["a", "b", "b"], ["a", "c", ""], ["a", "[nested table: deep]", "e"]
    ]


def test_merges_of_tall_tables_cross_buckets_of_rows(spark):
    """Columns continued over whole buckets and over rows that are not there, and a width only one row knows."""
    n = 4 * grids.FILL_ROWS + 9
    gap = range(grids.FILL_ROWS + 5, 3 * grids.FILL_ROWS + 7)
    rows, expected = [], {}
    above = [None, None, None]
    for r in range(n):
        own = [
            str(r) if r % 300 == 0 else None,
            f"b{r}" if r == 3 else None,
            "" if r == 0 or r % 7 else None,
        ]
        if r in gap:
            continue
        above = [o if o is not None or r == 0 else a for o, a in zip(own, above, strict=True)]
        above = [(o or "") if r == 0 else a for o, a in zip(own, above, strict=True)]
        expected[r] = [*above, "w" if r == n - 1 else ""]
        for c, o in enumerate([*own, *(["w"] if r == n - 1 else [])]):
            rows.append(("p", "t", "t.docx", 0, 0, r, c, o or "", 1, "continue" if o is None else None, False, None))
    rows += [("p", "small", "s.docx", 0, 0, r, 0, "x" if r == 0 else "", 1, "continue" if r else None, False, None) for r in range(3)]
    cells = spark.createDataFrame(rows, table_cells(spark, {"d": [["a"]]}).schema)
    found = grids.expand_grid(cells)
    got = {r.row_index: list(r["values"]) for r in found.where("document_id = 't'").collect()}
    assert got == expected
    assert [list(r["values"]) for r in found.where("document_id = 'small'").collect()] == [["x"]] * 3


def test_grid_is_not_dealt_out_cell_by_cell(spark):
    """Above the cut, rows of merged tables are filled where they lie."""
    found = grids.expand_grid(table_cells(spark, {"d": [["a", "b"], [("", 1, "continue", None), "c"]]}))
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()
    assert sorted(list(r["values"]) for r in found.collect()) == [["a", "b"], ["a", "c"]]


def test_headers(spark):
    tables = {
        "marked": [(["x1", "x2"], True), ["a", "b"]],
        "vocab": [["Name", "Role"], ["web", "front"], ["db", "back"]],
        "rows": [["web-01", "10"], ["web-02", "20"], ["web-03", "30"]],
        "lone": [["Name", "Role"]],
        "prose": [["This is a sentence.", "b"], ["c", "d"]],
    }
    found = grids.structure_tables(table_cells(spark, tables))[1]
    got = {r.document_id: (list(r.headers), r.header_source, r.data_start) for r in found.collect()}
    assert got["marked"] == (["x1", "x2"], "word_marker", 1)
    assert got["vocab"] == (["Name", "Role"], "heuristic_vocab", 1)
    assert got["rows"] == (["Column 1", "Column 2"], "generated", 0)
    assert got["lone"] == (["Column 1", "Column 2"], "generated", 0)
    assert got["prose"] == ([], "none", 0)


def test_row_sections_are_labelled(spark):
    found = blocks(spark, {"d": [(["Name", "Role"], True), ["ann", ""], ["", ""]]})
    got = [(r.meta.type, r.text) for r in found.orderBy("section_index").collect()]
    assert got == [("table", "Name | Role\nann | \n |"), ("table_header", "Name | Role"), ("table_row", "Name: ann")]


def test_uploads(spark):
    rows = [("p", "1", " in/a b.PDF ", 5), ("p", "2", "x.exe", 5), ("p", "3", "y.md", 0), ("p", "4", "z.txt", 99), ("p", "5", "._", 1)]
    df = spark.createDataFrame(rows, "project_id string, document_id string, filename string, size_bytes long")
    got = {r.document_id: r for r in sc.validate_uploads(df, max_bytes=50).collect()}
    assert got["1"].storage_path == "uploads/p/1/a_b.PDF"
    assert got["2"].reject_reason == "Unsupported file type: .exe"
    assert got["3"].reject_reason == sc.EMPTY_UPLOAD
    assert got["4"].reject_reason == sc.LARGE_UPLOAD
    assert (got["5"].safe_filename, got["5"].reject_reason) == ("upload.bin", "Unsupported file type: .bin")


def test_sheet_rows(spark):
    rows = [("p", "d", "d.xlsx", 0, "S", "visible", 1, [" a ", None, ""]), ("p", "d", "d.xlsx", 0, "S", "visible", 2, ["", None]), ("p", "d", "d.xlsx", 1, "H", "hidden", 1, ["x"]), ("p", "d", "d.xlsx", 2, "T", "visible", 1, ["b", "c"])]
    df = spark.createDataFrame(rows, "project_id string, document_id string, document_name string, sheet_index int, sheet_name string, sheet_state string, row_index int, values array<string>")
    got = [(r.section_index, r.text, r.meta.sheet_name) for r in sc.sheet_row_sections(df).orderBy("section_index").collect()]
    assert got == [(0, "a", "S"), (1, "b | c", "T")]


def test_ordered_helpers_match_plain_windows(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id").cast("int").alias("o"),
        F.when(F.hash("id") % 50 == 0, F.col("id")).alias("v"),
    )
    placed = dense_index(df, ["k"], F.floor(F.col("o") / 64), [F.col("o")], "n")
    carried = carry_forward(placed, ["k"], "o", "v", bucket_rows=64).orderBy("o").collect()
    count, last, raw = {}, {}, {r.o: r.v for r in df.collect()}
    for r in carried:
        assert r.n == count.get(r.k, 0)
        count[r.k] = r.n + 1
        last[r.k] = raw[r.o] if raw[r.o] is not None else last.get(r.k)
        assert r.v == last[r.k]


def test_rows_of_a_table_are_dealt_out_once(spark):
    """Keys that are constants (one table per document) cost no second exchange."""
    cells = table_cells(spark, {"d": [["a", "b"], [("", 1, "continue", None), "c"]]}).withColumn("table_index", F.lit(0)).withColumn("block_index", F.lit(0))
    found = grids.raw_rows(cells).groupBy(*grids.TABLE, "_bucket", "_deal").agg(F.count("*"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_given_whole_equal_rows_given_by_cells(spark):
    """A reader's rows with their cells in any order, spans, merges and nested text."""
    cells = table_cells(spark, {"d": [[("t", 2, None, None)], ["a", ("b", None, None, "in")], [("", 1, "continue", None), "c"]], "e": [(["x"], True)]})
    cell = F.struct("col_index", "text", "span", "v_merge", "nested_text")
    rows = cells.groupBy(*grids.TABLE, "row_index", "is_header_marker").agg(F.reverse(F.array_sort(F.collect_list(cell))).alias("cells"))
    order = ["document_id", "row_index"]
    got, want = grids.expand_grid(rows).orderBy(*order).collect(), grids.expand_grid(cells).orderBy(*order).collect()
    assert got == want and len(got) == 4
    assert grids.structure_tables(rows)[1].orderBy("document_id").collect() == grids.structure_tables(cells)[1].orderBy("document_id").collect()


def test_rows_of_tables_are_stored_once(spark, monkeypatch):
    """Structure is read off the filled buckets: no second copy of the rows, and one row per table where a bucket is a table."""
    kept = []

    def seen(df):
        kept.append(durable(df))
        return kept[-1]

    monkeypatch.setattr(grids, "durable", seen)
    rows, tables = grids.structure_tables(table_cells(spark, {"d": [["a", "b"], [("", 1, "continue", None), "c"]], "e": [["x"], ["1"]]}))
    assert [df.count() for df in kept if {"texts", "values", "rows"} & set(df.columns)] == [2]
    assert rows.count() == 4 and tables.count() == 2
    assert "hashpartitioning" not in rows._jdf.queryExecution().toString()


def test_only_the_first_prefix_of_a_column_is_told_apart(spark):
    """Cells of other prefixes are one group; where the first row has no cell, all are kept apart."""
    cells = table_cells(spark, {"d": [["web-1", ""], ["web-2", "ab1"], ["db-3", "cd2"], ["x-4", "ab3"]]})
    rows = grids.expand_grid(cells).withColumn("head", F.array(F.lit("web-1"), F.lit("")))
    found = grids._by_prefix(rows, ("head",), first=F.get("head", F.col("col"))).collect()
    assert sorted((r.col, r.prefix or "", r.n, r.first_row) for r in found) == [(0, "", 2, 2), (0, "web", 2, 0), (1, "ab1", 1, 1), (1, "ab3", 1, 3), (1, "cd2", 1, 2)]


def test_a_tall_table_changes_nothing_of_the_others(spark):
    """Captions and headers are the same where every table is one bucket and where one is not."""
    small = {
        "captioned": [[("Hosts", 2, None, None)], ["Name", "Role"], ["web", "front"], ["db", ("", 1, "continue", None)]],
        "lone": [["Hosts", ""], ["Name", "Role"], ["web", "front"]],
        "marked": [(["x1", "x2"], True), ["a", "b"]],
        "rows": [["web-01", "10"], ["web-02", "2.0"], ["web-03", "3 0"]],
        "repeats": [["Name", "Role"], ["Name", "1"], ["2", "3"]],
        "gap": [["", "b"], ["Name"], [("", 1, "continue", None), "c"]],
    }
    tall = {"tall": [["Name", "Role"]] + [["a", ("", 1, "continue" if r % 3 else None, None)] for r in range(grids.FILL_ROWS)]}
    alone, beside = (grids.structure_tables(table_cells(spark, t))[1].where("document_id <> 'tall'").collect() for t in (small, {**small, **tall}))
    assert len(alone) == len(small) and sorted(alone) == sorted(beside)
    captions = {r.document_id: r.caption for r in alone}
    assert captions["captioned"] == "Hosts" and captions["lone"] == "Hosts" and captions["rows"] is None


def test_word_count_of_odd_texts(spark):
    texts = ["", " ", "a", " a", "a ", " a\tb \n", "a b", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.word_count(F.col("t")), F.size(tx.words(F.col("t")))).collect()
    assert [r[0] for r in found] == [r[1] for r in found]
    assert [r[0] for r in found][:7] == [0, 0, 1, 1, 1, 2, 2]
