"""Small builders for fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import schema

CELLS = (
    "project_id string, document_id string, document_name string, table_index int, block_index int,"
    " row_index int, col_index int, text string, span int, v_merge string, is_header_marker boolean,"
    " nested_text string"
)


def table_cells(spark, tables):
    """``tables``: {document: [(cells, options)]}; a cell is text or (text, span, merge, nested)."""
    rows = []
    for document, grid in tables.items():
        for r, entry in enumerate(grid):
            values, marked = entry if isinstance(entry, tuple) else (entry, False)
            for c, value in enumerate(values):
                text, span, merge, nested = value if isinstance(value, tuple) else (value, 1, None, None)
                rows.append(("p", document, document + ".docx", 0, 0, r, c, text, span, merge, marked, nested))
    return spark.createDataFrame(rows, CELLS)


def chunk_rows(spark, rows):
    """Rows (document, index, text[, embedding[, project]]) as active store rows without metadata."""
    full = []
    for row in rows:
        document, at, text, embedding, project = (*row, None, None)[:5] if len(row) == 3 else (*row, None)[:5]
        full.append((project or "p", document, document + ".txt", at, f"{document}:{at}", text, embedding))
    df = spark.createDataFrame(
        full,
        "project_id string, document_id string, document_name string, chunk_index int,"
        " chunk_id string, text string, embedding array<float>",
    )
    return df.select("*", F.lit(True).alias("is_active"), schema.meta().alias("meta"))


def questions(spark, rows):
    """Rows (id, query[, embedding])."""
    full = [(row[0], "p", row[1], row[2] if len(row) > 2 else None) for row in rows]
    return spark.createDataFrame(
        full, "query_id string, project_id string, query string, embedding array<float>"
    )


def pool(spark, rows):
    """Candidate rows as dictionaries over sensible defaults."""
    fields = {
        "query_id": "string", "rank": "int", "chunk_id": "string", "document_id": "string",
        "fused_score": "double", "exact_identifiers": "int", "contained_identifiers": "int",
        "table_index": "int", "kind": "string", "data_row": "int", "first": "int", "last": "int",
    }
    data = [tuple({"query_id": "q", "document_id": "d", **row}.get(n) for n in fields) for row in rows]
    df = spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t in fields.items()))
    return df.withColumn(
        "meta",
        schema.meta(
            table_index=F.col("table_index"), table_chunk_type=F.col("kind"), data_row=F.col("data_row"),
            data_row_start=F.col("first"), data_row_end=F.col("last"),
        ),
    ).drop("table_index", "kind", "data_row", "first", "last")
