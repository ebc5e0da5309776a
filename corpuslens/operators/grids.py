"""Table structure from cell grids: spans, merges, captions, headers and row sections.

Input ``cells``: project_id, document_id, document_name, table_index, block_index, row_index,
col_index, text, span, v_merge, is_header_marker, nested_text (row and column from 0).  Readers that give
whole rows pass them as they are: without the columns of a cell, but with ``cells``, an array of
(col_index, text, span, v_merge, nested_text).

A row is held as an array of cells; whatever needs several rows of a table is an aggregate with a
map-side part or a join on the table key, so a table of any height spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.functions import text as tx
from corpuslens.functions.joins import join_small
from corpuslens.functions.ordered import carry_forward
from corpuslens.session import durable

TABLE = ("project_id", "document_id", "document_name", "table_index", "block_index")
KEY = ("project_id", "document_id", "table_index")
# What is known of a table beside its key, and what its rows have to know of its candidate header row.
CAPTION = ("column_count", "row_total", "caption", "skip", "head", "marked", "rows_below")
CANDIDATE = ("skip", "head", "_lowered")

# What still looks like a label, and how sure each signal makes us.
MAX_LABEL = 50
SHORT_LABEL = 20
NOT_LABEL_END = r"[.。!？?；;：:]$"
SENTENCE_END = r"[.。!?]$"
MARKED, DISTINCT, STRUCTURED, PATTERN, WEAK = 0.9, 0.75, 0.55, 0.6, 0.4
ACCEPTED = 0.6


def merge_nested_text(text: Column, nested: Column) -> Column:
    """Cell text with nested-table text appended in brackets."""
    own = tx.strip(F.coalesce(text, F.lit("")))
    inner = tx.strip(F.coalesce(nested, F.lit("")))
    note = F.concat(F.lit("[nested table: "), inner, F.lit("]"))
    return F.when(nested.isNull() | (inner == ""), own).when(own == "", note).otherwise(F.concat_ws(" ", own, note))


#: Rows of a table that are filled together, as one value.
FILL_ROWS = 256


def raw_rows(cells: DataFrame) -> DataFrame:
    """One row per table row: ``texts`` (nested text merged in), ``spans`` and ``merges`` of its cells in column order.

    The rows of a bucket of ``FILL_ROWS`` lie in one partition, so what is done per bucket needs no other shuffle.
    They are dealt by ``_deal``: of keys that are constants the planner forgets that rows were dealt by them."""
    parts = ("col_index", "text", "span", "v_merge", "nested_text")
    bucket = F.floor(F.col("row_index") / FILL_ROWS)
    placed = cells.withColumn("_bucket", bucket).withColumn("_deal", F.xxhash64(*TABLE, "_bucket")).repartition("_deal")
    marked = F.coalesce(F.col("is_header_marker"), F.lit(False))
    if "cells" in cells.columns:
        at = F.col("cells.col_index")
        ordered = F.sort_array(F.transform("cells", lambda c: F.struct(*[c[part].alias(part) for part in parts])))
        rows = placed.withColumn("marked", marked).withColumn("_sorted", F.when(at != F.sort_array(at), ordered))
        of = lambda part: F.when(F.col("_sorted").isNull(), F.col(f"cells.{part}")).otherwise(F.col(f"_sorted.{part}"))
    else:
        rows = placed.groupBy(*TABLE, "_bucket", "_deal", "row_index").agg(
            F.sort_array(F.collect_list(F.struct(*parts))).alias("_sorted"), F.bool_or(marked).alias("marked")
        )
        of = lambda part: F.col(f"_sorted.{part}")
    nested = F.array_max(of("nested_text")).isNotNull()
    # Rows without nested text, nearly all, take the short way.
    own = F.transform(of("text"), lambda text: tx.strip(F.coalesce(text, F.lit(""))))
    merged = F.zip_with(of("text"), of("nested_text"), merge_nested_text)
    return rows.select(
        *TABLE, "_bucket", "_deal", "row_index", F.when(nested, merged).otherwise(own).alias("texts"),
        of("span").alias("spans"), of("v_merge").alias("merges"), "marked", nested.alias("nested"),
    )


def _padded(texts: Column, width: Column) -> Column:
    """A row's texts with empty ones up to ``width``."""
    missing = F.array_repeat(F.lit(""), width - F.size(texts))
    return F.when(F.size(texts) == width, texts).otherwise(F.concat(texts, missing))


def _filled(rows: Column, width: Column) -> Column:
    """The texts of a bucket's rows, a continued cell (null) taking the one above; null above all of them stays null."""
    none = F.array().cast("array<array<string>>")

    def step(done: Column, row: Column) -> Column:
        own = _padded(row["texts"], width)
        above = F.get(done, F.size(done) - 1)
        filled = F.transform(own, lambda text, at: F.coalesce(text, F.get(above, at)))
        return F.concat(done, F.array(F.when(row["continued"], filled).otherwise(own)))

    return F.aggregate(rows, none, step)


def _filled_buckets(cells: DataFrame) -> tuple[DataFrame, bool]:
    """(buckets, whole): one row per bucket of table rows, as a cut, with ``column_count`` of the table and, one entry per
    row, ``indexes``, ``raws``, ``marks``, ``nests`` and ``texts``; and whether every table is one bucket.

    Merges are filled within a bucket before it is stored; what a table of several buckets carries from
    one to the next is one row per bucket and column."""
    # The first row has nothing above it, so it keeps its own text.
    below = F.col("row_index") > 0
    span = lambda c: F.coalesce(c["spans"], F.lit(1))
    zipped = F.arrays_zip("texts", "spans", "merges")
    spread = F.flatten(
        F.transform(
            zipped,
            lambda c: F.array_repeat(
                F.when(~(F.coalesce(c["merges"] == "continue", F.lit(False)) & below), c["texts"]), span(c)
            ),
        )
    )
    continued = F.coalesce(below & F.array_contains("merges", "continue"), F.lit(False))
    single = (F.coalesce(F.array_min("spans"), F.lit(1)) == 1) & (F.coalesce(F.array_max("spans"), F.lit(1)) == 1)
    texts = F.coalesce(F.when(single & ~continued, F.col("texts")).otherwise(spread), F.array().cast("array<string>"))
    raw = F.transform(zipped, lambda c: F.struct(c["texts"].alias("text"), span(c).alias("span")))
    row = F.struct("row_index", F.col("_texts").alias("texts"), "raw", "marked", "nested", "continued")
    # Grouped by the hash first: groups are sorted by numbers, not by names.
    grouped = (
        raw_rows(cells)
        .withColumn("continued", continued)
        .withColumn("raw", F.when(F.col("row_index") == 0, raw))
        .withColumn("_texts", texts)
        .groupBy("_deal", *TABLE, "_bucket")
        .agg(
            F.sort_array(F.collect_list(row)).alias("rows"),
            F.max(F.size("_texts")).alias("width"),
            F.min(F.size("_texts")).alias("_narrowest"),
            F.bool_or("continued").alias("_continued"),
        )
    )
    as_given = ~F.col("_continued") & (F.col("_narrowest") == F.col("width"))
    buckets = durable(
        grouped.select(
            *TABLE, "_bucket", "width",
            F.col("rows.row_index").alias("indexes"), F.col("rows.raw").alias("raws"),
            F.col("rows.marked").alias("marks"), F.col("rows.nested").alias("nests"),
            F.when(as_given, F.col("rows.texts")).otherwise(_filled(F.col("rows"), F.col("width"))).alias("texts"),
        )
    )
    # Only tables of more than one bucket have anything to carry, and a width that a bucket does not know.
    tall = durable(
        buckets.groupBy(*KEY).agg(F.max("width").alias("_width"), F.count(F.lit(1)).alias("_buckets"))
        .where("_buckets > 1").drop("_buckets")
    )
    if tall.isEmpty():
        return buckets.withColumnRenamed("width", "column_count"), True
    parts = join_small(buckets, tall, KEY, "left")
    last = _padded(F.get("texts", F.size("texts") - 1), F.col("_width"))
    # The texts at the end of a bucket stand between its own place and that of the next one with rows.
    place = F.col("_bucket") * 2
    ends = (
        parts.where("_width > 0")
        .select(*KEY, "_bucket", F.posexplode(last).alias("_col", "_end"))
        .select(
            *KEY, "_col",
            F.explode(
                F.array(
                    F.struct(place.alias("place"), F.lit(None).cast("string").alias("text")),
                    F.struct((place + 1).alias("place"), F.col("_end").alias("text")),
                )
            ).alias("_e"),
        )
        .select(*KEY, "_col", F.col("_e.place").alias("_place"), F.col("_e.text").alias("_text"))
    )
    above = durable(
        carry_forward(ends, [*KEY, "_col"], "_place", "_text")
        .where("_place % 2 = 0")
        .groupBy(*KEY, F.expr("_place div 2").alias("_bucket"))
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_col", "_text"))), lambda c: c["_text"]).alias("_above")
        )
    )
    carried = F.transform(
        "texts",
        lambda row: F.transform(_padded(row, F.col("_width")), lambda text, at: F.coalesce(text, F.get("_above", at))),
    )
    filled = durable(
        join_small(parts, above, (*KEY, "_bucket"), "left")
        .withColumn("texts", F.when(F.col("_width").isNull(), F.col("texts")).otherwise(carried))
        .withColumn("column_count", F.coalesce("_width", "width"))
        .drop("width", "_width", "_above")
    )
    return filled, False


def _bucket_rows(buckets: DataFrame, *carried: str) -> DataFrame:
    """The rows of filled buckets, each with the columns ``carried`` of its bucket."""
    lists = ("raws", "marks", "nests", "texts")
    of = lambda name, alias: F.get(name, F.col("_at")).alias(alias)
    return buckets.select(
        *TABLE, "column_count", *carried, *lists, F.posexplode("indexes").alias("_at", "row_index")
    ).select(
        *TABLE, "row_index", "column_count", of("raws", "raw"), of("marks", "marked"), of("nests", "nested"),
        of("texts", "values"), *carried,
    )


def expand_grid(cells: DataFrame) -> DataFrame:
    """Rows as equally wide arrays: spans repeated, vertical merges filled, short rows padded.

    They are read off buckets that are already cut.  ``raw`` is kept of a table's first row, the only one that is looked at."""
    return _bucket_rows(_filled_buckets(cells)[0])


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def looks_like_header(values: Column) -> Column:
    filled = non_empty(values)
    return (F.size(filled) > 0) & F.forall(
        filled, lambda v: (F.char_length(v) <= MAX_LABEL) & ~v.rlike(NOT_LABEL_END)
    )


def detect_caption(rows: DataFrame) -> DataFrame:
    """Per table: the caption or null, the candidate header row below it, the shape, and the rows below that row.

    One aggregation of ``expand_grid`` rows with a map-side part."""
    first = F.col("row_index") == 0
    filled = non_empty(F.col("values"))
    row = F.struct("values", "marked")
    parts = rows.select(
        *KEY, "column_count",
        F.when(first, _spanning(F.col("raw"))).alias("_spanning"),
        F.when(first, _lone(filled)).alias("_lone"),
        F.when(first, row).alias("_row0"),
        F.when(F.col("row_index") == 1, row).alias("_row1"),
        F.when(first, 0).otherwise(F.size(filled)).alias("_filled_below"),
        F.lit(1).alias("row_total"),
        (~first).cast("int").alias("_below_first"),
        (F.col("row_index") > 1).cast("int").alias("_below_second"),
    )
    return _captions(_merged(parts)).select(*KEY, *CAPTION)


def _spanning(raw: Column) -> Column:
    """The text of the first cell that spans more than half of its table."""
    wide = F.filter(raw, lambda c: (c["text"] != "") & (c["span"] > F.col("column_count") / 2))
    return F.get(wide, F.lit(0))["text"]


def _lone(filled: Column) -> Column:
    return F.when(F.size(filled) == 1, F.get(filled, F.lit(0)))


def _caption_parts(buckets: DataFrame, whole: bool) -> DataFrame:
    """Filled buckets with what each knows of its table's caption, as ``detect_caption`` has it of a row.

    Filled cells are asked for only beside a lone cell in the first row, which a bucket that is the whole table knows."""
    place = lambda at: F.array_position("indexes", at)
    has = lambda at: (place(at) > 0).cast("int")
    of = lambda name, at: F.get(name, (place(at) - 1).cast("int"))
    row = lambda at: F.when(place(at) > 0, F.struct(of("texts", at).alias("values"), of("marks", at).alias("marked")))
    first = non_empty(of("texts", 0))
    rows = F.size("indexes")
    filled_below = F.size(non_empty(F.flatten("texts"))) - F.when(place(0) > 0, F.size(first)).otherwise(0)
    return (
        buckets.withColumn("_spanning", _spanning(of("raws", 0)))
        .withColumn("_lone", _lone(first))
        .withColumn("_row0", row(0))
        .withColumn("_row1", row(1))
        .withColumn("_filled_below", F.when(F.col("_lone").isNotNull(), filled_below) if whole else filled_below)
        .withColumn("row_total", rows.cast("long"))
        .withColumn("_below_first", rows - has(0))
        .withColumn("_below_second", rows - has(0) - has(1))
    )


def _merged(parts: DataFrame) -> DataFrame:
    highest = ("_spanning", "_lone", "_row0", "_row1", "column_count")
    counts = ("_filled_below", "row_total", "_below_first", "_below_second")
    return parts.groupBy(*KEY).agg(
        *[F.max(name).alias(name) for name in highest], *[F.sum(name).alias(name) for name in counts]
    )


def _captions(tables: DataFrame) -> DataFrame:
    """Tables, one row each with all of its parts, with the columns ``CAPTION``."""
    others = F.when(F.col("_below_first") > 0, F.col("_filled_below") / F.col("_below_first"))
    by_shape = F.when((F.col("column_count") > 1) & (others > 1), F.col("_lone"))
    captioned = F.col("caption").isNotNull()
    return (
        tables.withColumn("caption", F.coalesce("_spanning", by_shape))
        .withColumn("skip", F.when(captioned, 1).otherwise(0))
        .withColumn("_head", F.when(captioned, F.col("_row1")).otherwise(F.col("_row0")))
        .withColumn("head", F.col("_head.values"))
        .withColumn("marked", F.coalesce("_head.marked", F.lit(False)))
        .withColumn(
            "rows_below", F.when(captioned, F.col("_below_second")).otherwise(F.col("_below_first")).cast("long")
        )
    )


def _is_numeric(cell: Column) -> Column:
    """A text with digits has nothing else but ``.-_`` and spaces; one of several lines is looked at without these."""
    lines = cell.rlike("[\n\r\x85\u2028\u2029]")
    return cell.rlike(r"^(?U)[\d.\-_ ]+$") | (lines & F.translate(cell, ".-_ ", "").rlike(r"^(?U)\d+$"))


def _by_prefix(
    rows: DataFrame, carried: tuple[str, ...] = (), *more: Column, first: Column | None = None
) -> DataFrame:
    """Filled cells by column and first three characters, with what is counted of them.

    Cells are looked at one row each: expressions over arrays are not compiled.  Only the first filled cell's prefix is asked
    for later: where ``first``, the text of a column in the first row, has it, all others are counted together."""
    cells = (
        rows.select(*KEY, "row_index", *carried, F.posexplode("values").alias("col", "cell"))
        .where(F.col("cell") != "")
        .withColumn("_digits", F.col("cell").rlike(r"(?U)\d"))
        .withColumn("_numeric", F.col("_digits") & _is_numeric(F.col("cell")))
    )
    prefix = F.substring("cell", 1, 3)
    if first is not None:
        prefix = F.when((first != "") & (prefix != F.substring(first, 1, 3)), None).otherwise(prefix)
    # Cells sharing a prefix are counted first; the column then looks up its first cell's count.
    return cells.groupBy(*KEY, "col", prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("row_index").alias("first_row"),
        F.count_if("_numeric").alias("numeric"),
        F.count_if(F.col("_digits") & ~F.col("_numeric")).alias("mixed"),
        *more,
    )


def _structured(by_prefix: DataFrame, *sums: str) -> DataFrame:
    """Per table: its structured columns, and the sums of further counts."""
    columns = by_prefix.groupBy(*KEY, "col").agg(
        F.sum("n").alias("cells"),
        F.min_by(F.char_length("prefix"), "first_row").alias("prefix_length"),
        F.min_by("n", "first_row").alias("sharing"),
        F.sum("numeric").alias("numeric"),
        F.sum("mixed").alias("mixed"),
        *[F.sum(name).alias(name) for name in sums],
    )
    prefixed = (F.col("prefix_length") == 3) & (F.col("sharing") >= F.col("cells") * 0.6)
    patterned = F.greatest("numeric", "mixed") >= F.col("cells") * 0.8
    structured = (F.col("cells") >= 2) & (prefixed | patterned)
    return columns.groupBy(*KEY).agg(
        F.count_if(structured).alias("structured_columns"), *[F.sum(name).alias(name) for name in sums]
    )


def column_structure(rows: DataFrame) -> DataFrame:
    """Per table: how many columns repeat a prefix or a digit pattern.  ``rows`` start at the
    candidate header row."""
    return _structured(_by_prefix(rows))


def detect_headers(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """Per table with a candidate row: its confidence and the signal that rests on."""
    candidates = _candidates(captions).select(*KEY, *CANDIDATE)
    return _judge_headers(rows.select(*KEY, "row_index", "values").join(candidates, [*KEY]), captions)


def _candidates(captions: DataFrame) -> DataFrame:
    """Tables whose header rests on their cells, with what these have to know of the candidate row."""
    lowered = F.transform(non_empty(F.col("head")), lambda v: F.lower(v))
    unsettled = ~F.col("marked") & (F.col("rows_below") > 0) & looks_like_header(F.col("head"))
    return captions.where(unsettled).withColumn("_lowered", lowered)


def _judge_headers(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """``detect_headers`` of rows that know their ``_candidates``."""
    body = rows.where(F.col("row_index") >= F.col("skip"))
    below = F.col("row_index") > F.col("skip")
    cell = F.col("cell")
    data_like = (F.char_length(cell) > MAX_LABEL) | F.col("_digits")
    label_like_cell = ~data_like & (F.char_length(cell) < SHORT_LABEL) & ~cell.rlike(SENTENCE_END)
    by_prefix = _by_prefix(
        body, CANDIDATE,
        F.count_if(below & F.array_contains("_lowered", F.lower(cell))).alias("repeats"),
        F.count_if(below & data_like).alias("data_cells"),
        F.count_if(below & label_like_cell).alias("label_cells"),
        first=F.get("head", F.col("col")),
    )
    joined = (
        captions.where(F.col("head").isNotNull())
        .join(_structured(by_prefix, "repeats", "data_cells", "label_cells"), [*KEY], "left")
    )
    structured = F.coalesce("structured_columns", F.lit(0))
    by_columns = F.when(
        F.when(F.col("column_count") == 1, structured >= 1).otherwise(
            structured * 2 >= F.col("column_count")
        ),
        STRUCTURED,
    ).otherwise(DISTINCT)
    has_labels = F.size(non_empty(F.col("head"))) > 0
    label_like = looks_like_header(F.col("head"))
    alone = F.col("rows_below") == 0
    distinct = has_labels & (F.coalesce("repeats", F.lit(0)) == 0)
    confidence = (
        F.when(F.col("marked"), MARKED)
        .when(~label_like, 0.0)
        .when(alone, WEAK)
        .when(distinct, by_columns)
        .when(F.col("data_cells") > F.col("label_cells"), PATTERN)
        .otherwise(WEAK)
    )
    source = (
        F.when(F.col("marked"), "word_marker")
        .when(~label_like, "none")
        .when(alone, "heuristic_weak")
        .when(distinct, "heuristic_vocab")
        .when(F.col("data_cells") > F.col("label_cells"), "heuristic_pattern")
        .otherwise("heuristic_weak")
    )
    return joined.select(
        *KEY,
        confidence.cast("double").alias("confidence"),
        source.alias("source"),
    )


def resolve_headers(detected: DataFrame, captions: DataFrame) -> DataFrame:
    """Per table: final headers, and the row index its data starts at.  An unsure header row
    stays data under generated names."""
    joined = captions.join(detected, [*KEY], "left")
    found = F.coalesce(
        (F.size("head") > 0) & (F.col("source") != "none"), F.lit(False)
    )
    accepted = found & (F.col("confidence") >= ACCEPTED)
    unsure = found & ~accepted
    generated = F.transform(
        F.sequence(F.lit(1), F.col("column_count")),
        lambda at: F.concat(F.lit("Column "), at.cast("string")),
    )
    return joined.select(
        *KEY,
        "caption",
        "column_count",
        "row_total",
        F.when(accepted, F.col("head"))
        .when(unsure, generated)
        .otherwise(F.array().cast("array<string>"))
        .alias("headers"),
        F.when(accepted, F.col("confidence")).otherwise(0.0).alias("header_confidence"),
        F.when(accepted, F.col("source"))
        .when(unsure, "generated")
        .otherwise("none")
        .alias("header_source"),
        (F.col("skip") + F.when(accepted, 1).otherwise(0)).alias("data_start"),
    )


def label_row(values: Column, headers: Column) -> Column:
    """``header: value`` for filled cells; the bare value where the column has no header."""
    pairs = F.zip_with(
        values,
        F.slice(headers, F.lit(1), F.size(values)),
        lambda v, h: F.when(v == "", F.lit(None))
        .when(F.coalesce(h, F.lit("")) == "", v)
        .otherwise(F.concat_ws(": ", h, v)),
    )
    return F.filter(pairs, lambda v: v.isNotNull())


def structure_tables(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, tables): expanded rows, and the resolved header of each table.

    Both are read several times below, so each is cut once instead of planned again.  A table of one bucket has its
    caption and its candidate header row beside its rows; only where there are others are buckets of a table aggregated and joined."""
    buckets, whole = _filled_buckets(cells)
    parts = _caption_parts(buckets, whole)
    if whole:
        tables = _captions(parts)
        captions = durable(tables.select(*KEY, *CAPTION))
        # Such tables are small: what is counted of their cells is counted where they lie.
        headed = _candidates(tables).select(*buckets.columns, *CANDIDATE).repartition(*KEY)
    else:
        captions = durable(_captions(_merged(parts)).select(*KEY, *CAPTION))
        headed = buckets.join(_candidates(captions).select(*KEY, *CANDIDATE), [*KEY])
    detected = _judge_headers(_bucket_rows(headed, *CANDIDATE), captions)
    return _bucket_rows(buckets), durable(resolve_headers(detected, captions))


BLOCK = ("project_id", "document_id", "document_name", "block_index")


def table_blocks(cells: DataFrame) -> DataFrame:
    """Whole-table, header and per-row blocks, to be numbered within their document.

    The whole-table block holds the text of its table in one value; ``table_parts`` is the form
    for tables of any height."""
    described = _described(cells)
    line = F.struct("row_index", _row_line().alias("line"))
    lines = F.transform(
        F.array_sort(F.collect_list(F.when(_is_data(), line))), lambda item: item["line"]
    )
    grouped = _per_table(described, lines.alias("_lines"))
    none = F.array().cast("array<string>")
    text = tx.strip(
        F.array_join(
            F.concat(
                F.when(_has_caption(), F.array("caption")).otherwise(none),
                F.when(_has_headers(), F.array(_header_text())).otherwise(none),
                F.col("_lines"),
            ),
            "\n",
        )
    )
    whole = _whole_blocks(grouped.withColumn("text", text).where(F.col("text") != ""))
    return whole.unionByName(_header_blocks(described)).unionByName(_row_blocks(described))


def table_parts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, rows): the blocks of ``table_blocks``, where a whole table has no text, and the data
    rows it consists of, one line each, for ``chunking.chunk_table_rows``.  No value and no task
    holds a table."""
    described = durable(_described(cells))
    filled = F.max(_is_data() & (tx.strip(_row_line()) != "")).alias("_filled")
    known = (
        (tx.strip(F.coalesce("caption", F.lit(""))) != "")
        | (_has_headers() & (tx.strip(_header_text()) != ""))
        | F.coalesce("_filled", F.lit(False))
    )
    grouped = _per_table(described, filled).where(known)
    whole = _whole_blocks(grouped.withColumn("text", F.lit(None).cast("string")))
    blocks = whole.unionByName(_header_blocks(described)).unionByName(_row_blocks(described))
    rows = described.where(_is_data()).select(
        *TABLE, "row_index", _row_line().alias("line"), "caption", "headers"
    )
    return blocks, rows


def _described(cells: DataFrame) -> DataFrame:
    rows, tables = structure_tables(cells)
    return rows.select(*TABLE, "row_index", "values", "nested").join(tables, [*KEY])


def _has_headers() -> Column:
    return F.size("headers") > 0


def _has_caption() -> Column:
    return F.coalesce("caption", F.lit("")) != ""


def _header_text() -> Column:
    return F.array_join(non_empty(F.col("headers")), " | ")


def _is_data() -> Column:
    return F.col("row_index") >= F.col("data_start")


def _row_line() -> Column:
    return F.array_join("values", " | ")


def _per_table(described: DataFrame, *more: Column) -> DataFrame:
    """One row per table: its header facts, the count of its data rows, which of them are nested."""
    facts = ("caption", "headers", "column_count", "header_confidence", "header_source")
    at = F.when(_is_data() & F.col("nested"), F.col("row_index") - F.col("data_start"))
    return described.groupBy(*TABLE).agg(
        F.count_if(_is_data()).cast("int").alias("_count"),
        F.array_sort(F.collect_list(at)).alias("_nested"),
        *[F.first(name).alias(name) for name in facts],
        *more,
    )


def _whole_blocks(tables: DataFrame) -> DataFrame:
    return tables.where(F.col("_count") + F.size("headers") > 0).select(
        *BLOCK,
        F.lit(0).alias("part"),
        F.lit(0).alias("part_row"),
        "text",
        schema.meta(
            format=F.lit("docx"),
            type=F.lit("table"),
            table_chunk_type=F.lit("table"),
            table_index=F.col("table_index"),
            block_index=F.col("block_index"),
            caption=F.col("caption"),
            headers=F.col("headers"),
            column_count=F.col("column_count"),
            row_count=F.col("_count"),
            header_confidence=F.col("header_confidence"),
            header_source=F.col("header_source"),
            nested_table_fallback=F.size("_nested") > 0,
            nested_rows=F.col("_nested"),
        ).alias("meta"),
    )


def _header_blocks(described: DataFrame) -> DataFrame:
    return described.where((F.col("row_index") == 0) & _has_headers()).select(
        *BLOCK,
        F.lit(1).alias("part"),
        F.lit(0).alias("part_row"),
        _header_text().alias("text"),
        schema.meta(
            format=F.lit("docx"),
            type=F.lit("table_header"),
            table_chunk_type=F.lit("table_header"),
            table_index=F.col("table_index"),
            block_index=F.col("block_index"),
            row=F.lit(0),
            headers=F.col("headers"),
            header_source=F.col("header_source"),
        ).alias("meta"),
    ).where(F.col("text") != "")


def _row_blocks(described: DataFrame) -> DataFrame:
    row_text = F.when(
        _has_headers(), F.array_join(label_row(F.col("values"), F.col("headers")), " | ")
    ).otherwise(_row_line())
    return described.where(_is_data()).select(
        *BLOCK,
        F.lit(2).alias("part"),
        (F.col("row_index") - F.col("data_start") + 1).cast("int").alias("part_row"),
        row_text.alias("text"),
        schema.meta(
            format=F.lit("docx"),
            type=F.lit("table_row"),
            table_chunk_type=F.lit("table_row"),
            table_index=F.col("table_index"),
            block_index=F.col("block_index"),
            data_row=F.col("row_index") - F.col("data_start") + 1,
            headers=F.when(_has_headers(), F.col("headers")),
            nested_table_fallback=F.when(F.col("nested"), F.lit(True)),
        ).alias("meta"),
    ).where(F.regexp_replace("text", r"^[ |]+", "") != "")
