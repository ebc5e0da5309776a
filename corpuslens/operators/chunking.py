"""Sections to chunks: word windows for text, row groups for tables, index and hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens import schema
from corpuslens.functions import text as tx
from corpuslens.functions.ordered import dense_index
from corpuslens.operators.rowgroups import BUCKET_ROWS, greedy_groups

CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
KEYS = ("project_id", "document_id", "document_name", "section_index")


def sealed(section_meta: Column, **learned: Column) -> Column:
    """Section metadata plus what chunking adds to it."""
    return schema.meta(
        section_meta,
        section_index=F.col("section_index"),
        chunker_version=F.lit(schema.CHUNKER_VERSION),
        **learned,
    )


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")


def chunk_text(
    sections: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Overlapping word windows; the last one is the first to reach the end of the section."""
    check_window(size, overlap)
    step = size - overlap
    count = F.size("_words")
    last = F.when(count <= size, F.lit(0)).otherwise(
        F.ceil((count - size) / F.lit(step)).cast("int")
    )
    pieces = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda at: F.struct(
                F.array_join(F.slice("_words", at * step + 1, F.lit(size)), " ").alias("text"),
                F.least(F.lit(size), count - at * step).alias("token_count"),
            ),
        ),
    )
    # Blank sections leave after the outer form: a test before it would be pushed below the
    # projections that make the text and its words, and make both once more for every section.
    return (
        sections.withColumn("_words", tx.words(F.col("text")))
        .withColumn("meta", sealed(F.col("meta")))
        .select(*KEYS, "meta", F.posexplode_outer(pieces).alias("local_index", "piece"))
        .where("piece is not null")
        .select(
            *KEYS,
            "local_index",
            F.col("piece.text").alias("text"),
            F.col("piece.token_count").alias("token_count"),
            "meta",
        )
    )


def header_line(headers: Column) -> Column:
    return F.coalesce(
        F.array_join(F.filter(headers, lambda h: h.isNotNull() & (h != "")), " | "), F.lit("")
    )


def _first_position(lines: Column, wanted: Column) -> Column:
    return F.when(wanted == "", F.lit(0)).otherwise(F.array_position(lines, wanted).cast("int"))


GROUPS = T.ArrayType(
    T.StructType([T.StructField(name, T.IntegerType()) for name in ("first", "rows", "words")])
)


@F.pandas_udf(GROUPS)
def _row_groups(sizes: pd.Series, room: pd.Series) -> pd.Series:
    """Cut each list of row sizes into greedy groups of at most ``room`` words; each boundary is
    one search in the running sum."""
    out = []
    for row_sizes, limit in zip(sizes, room):
        ends = np.cumsum(np.asarray(row_sizes, dtype=np.int64))
        groups, start, used = [], 0, 0
        while start < len(ends):
            stop = max(int(np.searchsorted(ends, used + limit, side="right")), start + 1)
            groups.append(
                {"first": start + 1, "rows": stop - start, "words": int(ends[stop - 1] - used)}
            )
            start, used = stop, int(ends[stop - 1])
        out.append(groups)
    return pd.Series(out)


def _without_titles(sections: DataFrame, text: Column) -> DataFrame:
    """Add ``_rows``, the lines of ``text`` but for the first that is the caption (``_caption``, at
    ``_caption_at``, 0 where there is none) and the first that is the header line (``_header``), and
    ``_fixed``, the words of these two."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), tx.strip), lambda line: line != ""
    )
    return (
        sections.withColumn("_lines", lines)
        .withColumn("_caption", F.coalesce(F.col("meta.caption"), F.lit("")))
        .withColumn("_header", header_line(F.col("meta.headers")))
        .withColumn("_caption_at", _first_position(F.col("_lines"), F.col("_caption")))
        .withColumn(
            "_header_at",
            # The caption line is taken first, so an equal header line is the next one.
            F.when(
                F.col("_header") == F.col("_caption"),
                F.when(F.col("_caption_at") == 0, F.lit(0)).otherwise(
                    _first_position(
                        F.expr("slice(_lines, _caption_at + 1, size(_lines))"), F.col("_header")
                    )
                ),
            ).otherwise(_first_position(F.col("_lines"), F.col("_header"))),
        )
        .withColumn(
            "_header_at",
            F.when(
                (F.col("_header") == F.col("_caption")) & (F.col("_header_at") > 0),
                F.col("_header_at") + F.col("_caption_at"),
            ).otherwise(F.col("_header_at")),
        )
        .withColumn(
            "_rows",
            F.expr(
                "filter(_lines, (line, at) -> at + 1 != _caption_at and at + 1 != _header_at)"
            ),
        )
        .withColumn("_fixed", tx.word_count(F.col("_caption")) + tx.word_count(F.col("_header")))
    )


def chunk_table(sections: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Greedy groups of whole rows, each repeating caption and header line.

    A group always takes one row, then every further row that keeps rows plus repeated lines
    within ``size`` words."""
    check_window(size, 0)
    parts = _without_titles(sections, F.col("text")).withColumn("_sizes", F.transform("_rows", tx.word_count))
    groups = F.when(
        F.size("_rows") == 0,
        F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("rows"), F.lit(0).alias("words"))),
    ).otherwise(_row_groups("_sizes", F.lit(size) - F.col("_fixed")))
    total = F.coalesce(F.col("meta.row_count"), F.lit(0))
    first = F.col("group.first")
    last = F.col("group.first") + F.greatest(F.col("group.rows") - 1, F.lit(0))
    empty = F.col("group.rows") == 0
    shown_caption = F.when(F.col("_caption_at") > 0, F.col("_caption")).otherwise(F.lit(""))
    body = F.concat(
        F.array(shown_caption, F.col("_header")),
        F.slice("_rows", F.greatest(first, F.lit(1)), F.col("group.rows")),
    )
    text = F.when(empty, tx.strip(F.col("text"))).otherwise(
        F.array_join(F.filter(body, lambda line: line != ""), "\n")
    )
    tokens = F.when(empty, tx.word_count(F.col("text"))).otherwise(
        F.col("group.words") + F.col("_fixed")
    )
    return (
        parts.select(
            "*", F.posexplode(groups).alias("local_index", "group")
        )
        .where(F.col("text") != "")
        .select(
            *KEYS,
            "local_index",
            text.alias("text"),
            tokens.alias("token_count"),
            sealed(
                F.col("meta"),
                data_row_start=first,
                data_row_end=last,
                total_rows=total,
                table_chunk_type=table_chunk_kind(first, last, total),
            ).alias("meta"),
        )
    )


def chunk_table_rows(
    sections: DataFrame, rows: DataFrame, size: int = CHUNK_SIZE, bucket_rows: int | None = None
) -> DataFrame:
    """``chunk_table`` for tables whose sections carry no text: their data rows are lines of
    ``rows`` (project_id, document_id, table_index, row_index, line, caption, headers), so a table of
    any height is cut by as many tasks as it has buckets.

    Caption and headers of a row are those of its section's metadata.  A section without rows is one
    chunk of its caption and header line."""
    check_window(size, 0)
    table = ["project_id", "document_id", "table_index"]

    def lead(caption: Column, headers: Column) -> Column:
        header = header_line(headers)
        return F.concat_ws("\n", F.when(caption != "", caption), F.when(header != "", header))

    def words_of(caption: Column, headers: Column) -> Column:
        return tx.word_count(F.coalesce(caption, F.lit(""))) + tx.word_count(header_line(headers))

    titled = _without_titles(sections, lead(F.col("meta.caption"), F.col("meta.headers"))).withColumn(
        "table_index", F.col("meta.table_index")
    )
    ahead = titled.select(
        *table, F.lit(-1).alias("row_index"), F.lit(size) - F.col("_fixed"), F.posexplode("_rows").alias("at", "line")
    ).toDF(*table, "row_index", "room", "at", "line")
    lines = rows.select(
        *table,
        F.col("row_index"),
        (F.lit(size) - words_of(F.col("caption"), F.col("headers"))).alias("room"),
        F.posexplode(F.transform(F.split("line", "\n"), tx.strip)).alias("at", "line"),
    ).where(F.col("line") != "")
    groups = greedy_groups(
        lines.unionByName(ahead)
        .withColumn("row", (F.col("row_index") + 1).cast("long"))
        .withColumn("words", tx.word_count(F.col("line")))
        .drop("row_index"),
        table,
        bucket_rows or BUCKET_ROWS,
    ).withColumnsRenamed({"text": "_body", "first": "_first", "lines": "_count"})
    empty = F.col("group").isNull()
    first = F.coalesce("_first", F.lit(0)).cast("int")
    last = F.when(empty, 0).otherwise(F.col("_first") + F.col("_count") - 1).cast("int")
    total = F.coalesce(F.col("meta.row_count"), F.lit(0))
    title = F.when(F.col("_caption_at") > 0, F.col("_caption")).otherwise(F.lit(""))
    body = F.array_join(F.filter(F.array(title, "_header", "_body"), lambda line: line != ""), "\n")
    bare = lead(F.col("meta.caption"), F.col("meta.headers"))
    return (
        titled.drop("_lines", "_rows").join(groups, table, "left")
        .withColumn("text", F.when(empty, tx.strip(bare)).otherwise(body))
        .where(F.col("text") != "")
        .select(
            *KEYS,
            F.coalesce("group", F.lit(0)).cast("int").alias("local_index"),
            "text",
            F.when(empty, tx.word_count(bare)).otherwise(F.col("words") + F.col("_fixed")).alias("token_count"),
            sealed(
                F.col("meta"),
                data_row_start=first,
                data_row_end=last,
                total_rows=total,
                table_chunk_type=table_chunk_kind(first, last, total),
            ).alias("meta"),
        )
    )


def table_chunk_kind(first: Column, last: Column, total: Column) -> Column:
    whole = (total > 0) & (first == 1) & (last == total)
    return F.when(whole, F.lit("table")).otherwise(F.lit("table_group"))


def assign_chunk_index(chunks: DataFrame, single_section: bool = False) -> DataFrame:
    """Number chunks 0..n-1 per document.

    With one section per document the local number already is the answer and nothing is
    shuffled; otherwise only per-bucket counts are carried across a document's sections."""
    if single_section:
        numbered = chunks.withColumn("chunk_index", F.col("local_index"))
    else:
        numbered = dense_index(
            chunks,
            ["project_id", "document_id"],
            F.floor(F.col("section_index") / 256),
            [F.col("section_index"), F.col("local_index")],
            "chunk_index",
        )
    return numbered.drop("local_index")


HASHED_META = (
    "section_index", "table_chunk_type", "table_index", "data_row_start", "data_row_end",
    "data_row", "page_number", "line_start", "line_end", "sheet_name", "row_start",
    "paragraph_start", "caption", "chunker_version",
)


def chunk_hash() -> Column:
    """SHA-256 over identity, text and the fields that place the chunk in its document."""
    parts = [F.col("project_id"), F.col("document_id")]
    parts += [F.coalesce(F.col(f"meta.{name}").cast("string"), F.lit("")) for name in HASHED_META]
    parts += [header_line(F.col("meta.headers")), F.col("text")]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def chunk_sections(
    sections: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    single_section: bool = False,
    tables: bool = True,
    table_rows: DataFrame | None = None,
) -> DataFrame:
    """All chunks of all sections, numbered and hashed.

    With ``table_rows``, the texts of tables are there and not in their sections."""
    check_window(size, overlap)
    if tables:
        tabular = F.coalesce(F.col("meta.type") == "table", F.lit(False))
        found = sections.where(tabular)
        cut = chunk_table(found, size) if table_rows is None else chunk_table_rows(found, table_rows, size)
        pieces = chunk_text(sections.where(~tabular), size, overlap).unionByName(cut)
    else:
        pieces = chunk_text(sections, size, overlap)
    numbered = assign_chunk_index(pieces, single_section)
    if tables:
        at = F.when(F.col("meta.type") == "table", F.col("chunk_index"))
        numbered = numbered.withColumn("meta", schema.meta(F.col("meta"), chunk_index=at))
    return numbered.withColumn("content_hash", chunk_hash())


def as_store_rows(chunks: DataFrame, version: Column | int = 1) -> DataFrame:
    """Add id, activity and an empty embedding: the shape every retrieval operator reads."""
    version = F.lit(version) if isinstance(version, int) else version
    return chunks.select(
        "project_id",
        "document_id",
        "document_name",
        "section_index",
        "chunk_index",
        F.concat_ws(":", "document_id", version, "chunk_index").alias("chunk_id"),
        "text",
        "token_count",
        "content_hash",
        "meta",
        F.lit(True).alias("is_active"),
    )
