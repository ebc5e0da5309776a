"""Table structure: one table per customer, its orders as rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.catalog import base
from corpuslens.catalog.registry import query, with_
from corpuslens.operators import chunking
from corpuslens.operators import grids as gr
from corpuslens.session import durable
from corpuslens.sources import sections as sc

LABELS = ("Order", "Status", "Priority", "Date")


def table_rows(spark, sf_dir):
    """Caption, header and order rows, each with its cells.  By segment a customer's table lacks its caption
    or header row, or marks the latter; some cells span, merge, nest or are missing."""
    customer = base.table(spark, sf_dir, "customer")
    orders = base.table(spark, sf_dir, "orders").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    place = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    segment = F.col("c_mktsegment")
    captioned, labelled = segment != "BUILDING", segment != "MACHINERY"
    offset = captioned.cast("int") + labelled.cast("int")
    keyed = orders.withColumn("n", F.row_number().over(place))

    def cell(at, text, span=1, merge=None, nested=None):
        return F.struct(
            F.lit(at).alias("col_index"),
            text.alias("text"),
            F.lit(span).alias("span"),
            (F.lit(None).cast("string") if merge is None else merge).alias("v_merge"),
            (F.lit(None).cast("string") if nested is None else nested).alias("nested_text"),
        )

    key = F.col("o_orderkey")
    data = F.array(
        cell(0, key.cast("string")),
        cell(1, F.col("o_orderstatus"), merge=F.when(key % 3 == 0, "continue")),
        cell(2, F.col("o_orderpriority"), nested=F.when(key % 10 == 0, "gift")),
        cell(3, F.date_format("o_orderdate", "yyyy-MM-dd")),
    )
    short = F.when(key % 7 == 0, F.slice(data, 1, 3)).otherwise(data)
    first = F.col("n") == 1
    row = lambda index, marked, row_cells: F.struct(
        index.cast("int").alias("row_index"), marked.alias("is_header_marker"), row_cells.alias("cells")
    )
    no = F.lit(False)
    rows = F.array(
        F.when(first & captioned, row(F.lit(0), no, F.array(cell(0, F.col("c_name"), 4)))),
        F.when(
            first & labelled,
            row(
                captioned.cast("int"), segment == "HOUSEHOLD",
                F.array(*[cell(at, F.lit(label)) for at, label in enumerate(LABELS)]),
            ),
        ),
        row(F.col("n") - 1 + offset, no, short),
    )
    document = F.concat(F.lit("cust-"), F.col("c_custkey").cast("string"))
    return (
        keyed.select(
            F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("project_id"),
            document.alias("document_id"),
            F.concat(document, F.lit(".docx")).alias("document_name"),
            F.lit(0).alias("table_index"),
            F.lit(0).alias("block_index"),
            F.explode(rows).alias("r"),
        )
        .where("r is not null")
        .select(
            "project_id", "document_id", "document_name", "table_index", "block_index",
            "r.row_index", "r.is_header_marker", "r.cells",
        )
    )


def cells(spark, sf_dir):
    """The same rows cell by cell."""
    return (
        table_rows(spark, sf_dir)
        .withColumn("c", F.explode("cells"))
        .select(
            "project_id", "document_id", "document_name", "table_index", "block_index",
            "row_index", "c.col_index", "c.text", "c.span", "c.v_merge", "is_header_marker",
            "c.nested_text",
        )
    )


def sections(spark, sf_dir):
    return sc.number_blocks(gr.table_blocks(table_rows(spark, sf_dir)))


def table_store(spark, sf_dir):
    """Chunks of all customer tables, without vectors."""
    chunks = chunking.as_store_rows(chunking.chunk_sections(durable(sections(spark, sf_dir)), 40, 5))
    return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))


GRID = """placed AS (
  SELECT o.*, c.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
         CAST(c_mktsegment <> 'BUILDING' AS INTEGER) AS cap, CAST(c_mktsegment <> 'MACHINERY' AS INTEGER) AS lab
  FROM orders o JOIN customer c ON o_custkey = c_custkey),
raw_cells AS (
  SELECT c_custkey, 0 AS r, 0 AS c, c_name AS v, 4 AS span, false AS cont, false AS marked, false AS nested FROM placed WHERE n = 1 AND cap = 1
  UNION ALL
  SELECT c_custkey, cap, i, ['Order', 'Status', 'Priority', 'Date'][i + 1], 1, false, c_mktsegment = 'HOUSEHOLD', false
  FROM placed, range(4) t(i) WHERE n = 1 AND lab = 1
  UNION ALL
  SELECT c_custkey, n - 1 + cap + lab, i,
         [CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority || CASE WHEN o_orderkey % 10 = 0 THEN ' [nested table: gift]' ELSE '' END, strftime(o_orderdate, '%Y-%m-%d')][i + 1],
         1, i = 1 AND o_orderkey % 3 = 0 AND n - 1 + cap + lab > 0, false, i = 2 AND o_orderkey % 10 = 0
  FROM placed, range(4) t(i) WHERE NOT (i = 3 AND o_orderkey % 7 = 0)),
widths AS (SELECT c_custkey, CAST(max(w) AS BIGINT) AS width FROM (SELECT c_custkey, r, sum(span) AS w FROM raw_cells GROUP BY ALL) GROUP BY c_custkey),
row_list AS (SELECT c_custkey, r, bool_or(marked) AS marked, bool_or(nested) AS nested FROM raw_cells GROUP BY ALL),
spread AS (SELECT c_custkey, r, c + i AS col, v, cont FROM raw_cells, range(4) t(i) WHERE i < span),
padded AS (
  SELECT rl.c_custkey, rl.r, p.col, coalesce(s.v, '') AS v, coalesce(s.cont, false) AS cont
  FROM row_list rl JOIN widths w USING (c_custkey) JOIN (SELECT CAST(i AS INTEGER) AS col FROM range(4) t(i)) p ON p.col < w.width
  LEFT JOIN spread s ON s.c_custkey = rl.c_custkey AND s.r = rl.r AND s.col = p.col),
grid AS (
  SELECT c_custkey, r, col, last_value(CASE WHEN NOT cont THEN v END IGNORE NULLS) OVER (PARTITION BY c_custkey, col ORDER BY r ROWS UNBOUNDED PRECEDING) AS v FROM padded),
grid_rows AS (
  SELECT c_custkey, r, list(v ORDER BY col) AS vs FROM grid GROUP BY ALL),
captions AS (
  SELECT rl.c_custkey, w.width, rl.row_total, coalesce(sp.v, CASE WHEN w.width > 1 AND o.others > 1 THEN l.v END) AS caption
  FROM (SELECT c_custkey, count(*) AS row_total FROM row_list GROUP BY ALL) rl JOIN widths w USING (c_custkey)
  LEFT JOIN (SELECT rc.c_custkey, min_by(rc.v, rc.c) AS v FROM raw_cells rc JOIN widths USING (c_custkey) WHERE rc.r = 0 AND rc.v <> '' AND rc.span > width / 2.0 GROUP BY ALL) sp USING (c_custkey)
  LEFT JOIN (SELECT c_custkey, max(v) AS v FROM grid WHERE r = 0 AND v <> '' GROUP BY ALL HAVING count(*) = 1) l USING (c_custkey)
  LEFT JOIN (SELECT c_custkey, avg(k) AS others FROM (SELECT c_custkey, r, count(*) FILTER (v <> '') AS k FROM grid WHERE r > 0 GROUP BY ALL) GROUP BY ALL) o USING (c_custkey)),
skips AS (SELECT *, CASE WHEN caption IS NULL THEN 0 ELSE 1 END AS skip FROM captions),
heads AS (SELECT s.*, g.vs AS head, rl.marked FROM skips s JOIN grid_rows g ON g.c_custkey = s.c_custkey AND g.r = s.skip JOIN row_list rl ON rl.c_custkey = s.c_custkey AND rl.r = s.skip),
data_cells AS (SELECT g.* FROM grid g JOIN skips s USING (c_custkey) WHERE g.r > s.skip AND g.v <> ''),
column_stats AS (
  SELECT c_custkey, col, count(*) AS n, min_by(v, r) AS f, list(v) AS vs,
         count(*) FILTER (regexp_matches(regexp_replace(v, '[._ -]', '', 'g'), '^[0-9]+$')) AS num,
         count(*) FILTER (regexp_matches(v, '[0-9]') AND NOT regexp_matches(regexp_replace(v, '[._ -]', '', 'g'), '^[0-9]+$')) AS mix
  FROM grid JOIN skips USING (c_custkey) WHERE r >= skip AND v <> '' GROUP BY ALL),
structures AS (
  SELECT c_custkey, count(*) FILTER (n >= 2 AND ((length(f) >= 3 AND len(list_filter(vs, lambda x: x[1:3] = f[1:3])) >= n * 0.6) OR greatest(num, mix) >= n * 0.8)) AS structured
  FROM column_stats GROUP BY ALL),
signals AS (
  SELECT h.c_custkey, count(DISTINCT d.r) AS data_rows, bool_or(list_contains(list_transform(h.head, lambda x: lower(x)), lower(d.v))) AS repeated,
         count(*) FILTER (length(d.v) > 50 OR regexp_matches(d.v, '[0-9]')) AS datas,
         count(*) FILTER (NOT (length(d.v) > 50 OR regexp_matches(d.v, '[0-9]')) AND length(d.v) < 20 AND NOT regexp_matches(d.v, '[.。!?]$')) AS labels
  FROM heads h JOIN data_cells d USING (c_custkey) GROUP BY ALL),
judged AS (
  SELECT h.*, coalesce(structured, 0) AS structured, CASE
    WHEN marked THEN 'word_marker'
    WHEN len(list_filter(head, lambda x: x <> '')) = 0 OR len(list_filter(head, lambda x: length(x) > 50 OR regexp_matches(x, '[.。!？?；;：:]$'))) > 0 THEN 'none'
    WHEN coalesce(data_rows, 0) = 0 THEN 'heuristic_weak'
    WHEN NOT coalesce(repeated, false) THEN 'heuristic_vocab'
    WHEN datas > labels THEN 'heuristic_pattern' ELSE 'heuristic_weak' END AS source
  FROM heads h LEFT JOIN signals s USING (c_custkey) LEFT JOIN structures t USING (c_custkey)),
confident AS (
  SELECT *, CAST(CASE source WHEN 'word_marker' THEN 0.9 WHEN 'none' THEN 0.0 WHEN 'heuristic_weak' THEN 0.4 WHEN 'heuristic_pattern' THEN 0.6
    ELSE CASE WHEN (width = 1 AND structured >= 1) OR (width > 1 AND structured * 2 >= width) THEN 0.55 ELSE 0.75 END END AS DOUBLE) AS confidence FROM judged),
resolved AS (
  SELECT s.c_custkey, s.caption, s.width, s.skip,
    CASE WHEN source <> 'none' AND confidence >= 0.6 THEN head WHEN source <> 'none' THEN list_transform(range(1, s.width + 1), lambda i: 'Column ' || i) ELSE CAST([] AS VARCHAR[]) END AS headers,
    CASE WHEN source <> 'none' AND confidence >= 0.6 THEN confidence ELSE CAST(0 AS DOUBLE) END AS header_confidence,
    CASE WHEN source <> 'none' AND confidence >= 0.6 THEN source WHEN source <> 'none' THEN 'generated' ELSE 'none' END AS header_source,
    s.skip + CASE WHEN source <> 'none' AND confidence >= 0.6 THEN 1 ELSE 0 END AS data_start
  FROM skips s LEFT JOIN confident c USING (c_custkey)),
data_rows AS (
  SELECT g.c_custkey, g.r - v.data_start + 1 AS data_row, g.vs, v.headers, v.caption,
         CASE WHEN len(v.headers) > 0 THEN array_to_string(list_filter(list_transform(range(1, len(g.vs) + 1),
            lambda i: CASE WHEN g.vs[i] = '' THEN NULL WHEN coalesce(v.headers[i], '') = '' THEN g.vs[i] ELSE v.headers[i] || ': ' || g.vs[i] END), lambda x: x IS NOT NULL), ' | ')
         ELSE array_to_string(g.vs, ' | ') END AS row_text, array_to_string(g.vs, ' | ') AS line
  FROM grid_rows g JOIN resolved v USING (c_custkey) WHERE g.r >= v.data_start),
tables_ AS (
  SELECT v.c_custkey, v.caption, v.headers, array_to_string(list_filter(v.headers, lambda x: x <> ''), ' | ') AS header_line,
         coalesce(d.lines, CAST([] AS VARCHAR[])) AS lines
  FROM resolved v LEFT JOIN (SELECT c_custkey, list(line ORDER BY data_row) AS lines FROM data_rows GROUP BY ALL) d USING (c_custkey)),
blocks AS (
  SELECT c_custkey, 0 AS part, 0 AS part_row, 'table' AS type, trim(array_to_string(list_concat(
           CASE WHEN caption IS NULL THEN CAST([] AS VARCHAR[]) ELSE [caption] END, CASE WHEN len(headers) > 0 THEN [header_line] ELSE CAST([] AS VARCHAR[]) END, lines), chr(10))) AS text FROM tables_
  UNION ALL SELECT c_custkey, 1, 0, 'table_header', header_line FROM tables_ WHERE len(headers) > 0
  UNION ALL SELECT c_custkey, 2, data_row, 'table_row', row_text FROM data_rows WHERE trim(row_text, ' |') <> ''),
table_sections AS (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY part, part_row) - 1 AS section_index FROM blocks WHERE text <> '')"""


@query("expand_grid", with_(GRID, body="""SELECT 'cust-' || c_custkey AS document_id, CAST(r AS INTEGER) AS row_index, CAST(width AS INTEGER) AS column_count,
      array_to_string(vs, '|') AS cells FROM grid_rows JOIN widths USING (c_custkey)"""))
def expand_grid(spark, sf_dir):
    """Spans repeated, merges filled, nested text appended, short rows padded."""
    return gr.expand_grid(cells(spark, sf_dir)).select(
        "document_id", "row_index", "column_count", F.array_join("values", "|").alias("cells")
    )


@query("table_captions", with_(GRID, body="""SELECT 'cust-' || c_custkey AS document_id, CAST(width AS INTEGER) AS column_count, row_total, caption FROM captions"""))
def table_captions(spark, sf_dir):
    """Captions and shapes."""
    return gr.detect_caption(gr.expand_grid(table_rows(spark, sf_dir))).select(
        "document_id", "column_count", "row_total", "caption"
    )


@query("table_headers", with_(GRID, body="""SELECT 'cust-' || c_custkey AS document_id, confidence, source FROM confident"""))
def table_headers(spark, sf_dir):
    """How sure the candidate header row is, and why."""
    rows = gr.expand_grid(table_rows(spark, sf_dir))
    return gr.detect_headers(rows, durable(gr.detect_caption(rows))).select("document_id", "confidence", "source")


@query("column_structure", with_(GRID, body="SELECT 'cust-' || c_custkey AS document_id, structured AS structured_columns FROM structures"))
def column_structure(spark, sf_dir):
    """Columns that repeat a prefix or digit pattern."""
    rows = gr.expand_grid(table_rows(spark, sf_dir))
    captions = gr.detect_caption(rows)
    body = rows.join(captions.select(*gr.KEY, "skip"), [*gr.KEY]).where("row_index >= skip")
    return gr.column_structure(body).select("document_id", "structured_columns")


@query("resolved_headers", with_(GRID, body="""SELECT 'cust-' || c_custkey AS document_id, array_to_string(headers, '|') AS headers, header_confidence, header_source,
      CAST(data_start AS INTEGER) AS data_start FROM resolved"""))
def resolved_headers(spark, sf_dir):
    """Final headers and first data row."""
    return gr.structure_tables(table_rows(spark, sf_dir))[1].select(
        "document_id", F.array_join("headers", "|").alias("headers"), "header_confidence",
        "header_source", "data_start",
    )


@query("table_sections", with_(GRID, body="""SELECT 'cust-' || c_custkey AS document_id, CAST(section_index AS INTEGER) AS section_index, type, text FROM table_sections"""))
def table_sections(spark, sf_dir):
    """Whole-table, header and row sections."""
    return sections(spark, sf_dir).select("document_id", "section_index", "meta.type", "text")


@query(
    "table_chunks",
    "WITH RECURSIVE " + GRID + """,
  fixed AS (SELECT c_custkey, caption, header_line, lines, len(lines) AS total,
      len(list_filter(regexp_split_to_array(coalesce(caption, ''), '\\s+'), lambda x: x <> '')) + len(list_filter(regexp_split_to_array(header_line, '\\s+'), lambda x: x <> '')) AS overhead FROM tables_),
  sized AS (SELECT c_custkey, overhead, i, len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '')) AS w
      FROM (SELECT c_custkey, overhead, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM fixed)),
  summed AS (SELECT *, sum(w) OVER (PARTITION BY c_custkey ORDER BY i) AS s FROM sized),
  stops AS (SELECT a.c_custkey, a.i, greatest(a.i, max(b.i)) AS stop FROM summed a LEFT JOIN summed b
      ON b.c_custkey = a.c_custkey AND b.i >= a.i AND b.s - (a.s - a.w) + a.overhead <= 40 GROUP BY a.c_custkey, a.i),
  walk AS (SELECT c_custkey, i, coalesce(stop, i) AS stop FROM stops WHERE i = 1
      UNION ALL SELECT s.c_custkey, s.i, coalesce(s.stop, s.i) FROM walk w JOIN stops s ON s.c_custkey = w.c_custkey AND s.i = w.stop + 1)
  SELECT 'cust-' || w.c_custkey AS document_id, CAST(i AS INTEGER) AS data_row_start, CAST(stop AS INTEGER) AS data_row_end, CAST(total AS INTEGER) AS total_rows,
    CASE WHEN i = 1 AND stop = total THEN 'table' ELSE 'table_group' END AS table_chunk_type,
    array_to_string(list_concat(CASE WHEN caption IS NULL THEN CAST([] AS VARCHAR[]) ELSE [caption] END, CASE WHEN header_line = '' THEN CAST([] AS VARCHAR[]) ELSE [header_line] END,
      list_transform(lines[i:stop], lambda x: trim(x))), chr(10)) AS text
  FROM walk w JOIN fixed USING (c_custkey)""",
)
def table_chunks(spark, sf_dir):
    """Greedy row groups with caption and header repeated, cut where the rows lie."""
    blocks, rows = gr.table_parts(table_rows(spark, sf_dir))
    found = sc.number_blocks(blocks).where("meta.type = 'table'")
    return chunking.chunk_table_rows(found, rows, 40).select(
        "document_id", "meta.data_row_start", "meta.data_row_end", "meta.total_rows",
        "meta.table_chunk_type", "text",
    )
