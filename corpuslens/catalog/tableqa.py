"""Questions about tables: intent, facets, choice, expansion, budget, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.catalog import base, grids
from corpuslens.catalog.registry import query, with_
from corpuslens.functions import intent
from corpuslens.operators import prompts as pr
from corpuslens.operators import tables as tb
from corpuslens.plans import retrieval
from corpuslens.session import durable, released_shuffles

_ASKED_SQL = """asked AS (
  SELECT conv_id || '-' || turn AS query_id, CASE (conv_id + turn) % 12
    WHEN 0 THEN 'List all the rows of ' WHEN 1 THEN 'what is the ' WHEN 2 THEN '列出所有行 ' WHEN 3 THEN '列出所有行为 '
    WHEN 4 THEN 'show the SERVER list ' WHEN 5 THEN 'please display each host ' WHEN 6 THEN 'show table and list all records of '
    WHEN 7 THEN '列出记录以及显示表格 ' WHEN 8 THEN 'enumerate servers ' WHEN 9 THEN 'list every entry, also table contents, and show rows of '
    WHEN 10 THEN '主机 ' ELSE '' END
    || text AS query FROM conversations)"""


def _asked(spark, sf_dir):
    turn = (F.col("conv_id") + F.col("turn")) % 12
    leads = (
        "List all the rows of ", "what is the ", "列出所有行 ", "列出所有行为 ", "show the SERVER list ",
        "please display each host ", "show table and list all records of ", "列出记录以及显示表格 ",
        "enumerate servers ", "list every entry, also table contents, and show rows of ", "主机 ", "",
    )
    lead = F.element_at(F.array(*map(F.lit, leads)), (turn + 1).cast("int"))
    return base.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.concat(lead, "text").alias("query"),
    )


# Fixed values, written out for the checking engine: what names listing, tables and their rows.
_NAMED_LISTS = "server列表|服务器列表|账号列表|节点列表|主机列表|服务列表|配置表|记录列表"
_NAMED_LISTS_EN = r"\bserver\s+list\b|\blist\s+of\s+servers\b|\bhost\s+list\b|\baccount\s+list\b"
_LISTING_ZH = (
    "(列出|罗列|显示).*(表格|数据表|配置表|记录表)|表格.*(列出|全部)|列出.*记录|"
    "(列出|罗列|显示|展示).*(数据行|每一行|所有行|全部行|各行)|完整表格|表格内容|逐行|全部记录|所有记录"
)
_LISTING_EN = (
    r"\blist\s+(all\s+)?(the\s+)?(server|servers|row|rows|record|records|entrie|entries|table|tables)\b|"
    r"\bshow\s+(all\s+)?(the\s+)?(row|rows|table|tables|record|records)\b|\bshow\s+the\s+(full\s+)?table\b|"
    r"\bcomplete\s+table\b|\btable\s+(content|contents)\b|\bevery\s+(row|record|entry)\b|\ball\s+(rows|records|entries)\b"
)
_VERBS_ZH = "列出|罗列|显示|展示"
_VERBS_EN = r"\b(list|show|display|enumerate)\b"
_THINGS_ZH = "表格|数据表|配置表|记录表|记录|条目|数据行|每一行|所有行|全部行|各行|服务器|主机|账号|节点|实例"
_THINGS_EN = r"\b(table|row|record|records|entrie|entries|all\s+rows|every\s+row)\b|(^|[^a-z])(server|host|account|node|instance|record|entry)($|[^a-z])"
_ONE_ROW = r"\bwhat\s+is\s+the\b|\bfind\s+the\b|\blookup\b|\b(propertie|properties)\s+of\b|\b(detail|details)\s+(of|for)\b|\b(attribute|attributes)\s+of\b"


def _full_sql(column):
    """Whole-table intent without look-around: rows followed by 为 are taken out first."""
    bare = f"regexp_replace({column}, '(所有行|全部行|各行)为', '', 'g')"
    low = f"replace(lower({column}), 'ß', 'ss')"
    found = lambda text, pattern: f"regexp_matches({text}, '{pattern}')"
    verb = f"({found(column, _VERBS_ZH)} OR {found(low, _VERBS_EN)})"
    thing = f"({found(bare, _THINGS_ZH)} OR {found(low, _THINGS_EN)})"
    return (
        f"({found(column, _NAMED_LISTS)} OR {found(low, _NAMED_LISTS_EN)} OR {found(bare, _LISTING_ZH)}"
        f" OR {found(low, _LISTING_EN)} OR ({verb} AND {thing}))"
    )


@query(
    "table_intent",
    with_(_ASKED_SQL, body=f"""SELECT query_id, query, {_full_sql("query")} AS is_full_table,
          {_full_sql("query")} OR regexp_matches(lower(query), '{_ONE_ROW}') AS is_table FROM asked"""),
)
def table_intent(spark, sf_dir):
    """Which questions are about a table, and about all of it."""
    q = F.col("query")
    return _asked(spark, sf_dir).select(
        "query_id", "query", intent.is_full_table(q).alias("is_full_table"), intent.is_table(q).alias("is_table")
    )


@query(
    "split_facets",
    with_(_ASKED_SQL, f"""parts AS (SELECT query_id, query, list_filter(list_transform(regexp_split_to_array(trim(query),
            '(?i)\\s+(?:and|also)\\s+|(?:以及|并且|同时|和)'), lambda x: trim(x, ' ,;，；')), lambda x: x <> '') AS ps FROM asked),
          chosen AS (SELECT query_id, CASE WHEN len(ps) BETWEEN 2 AND 4 AND len(list_filter(ps, lambda p: NOT {_full_sql("p")})) = 0 THEN ps ELSE [trim(query)] END AS fs FROM parts)""",
          body="SELECT query_id, CAST(generate_subscripts(fs, 1) - 1 AS INTEGER) AS facet_index, unnest(fs) AS facet_query FROM chosen"),
)
def split_facets(spark, sf_dir):
    """Clauses of compound whole-table questions."""
    return _asked(spark, sf_dir).select(
        "query_id", F.posexplode(intent.facets(F.col("query"))).alias("facet_index", "facet_query")
    )


_POOL_SQL = """facet_list AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'list all the records of customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
      WHEN 1 THEN 'show the table of cust ' || s_suppkey WHEN 2 THEN 'list rows with priorit and date' ELSE 'describe the weather' END AS facet_query FROM supplier),
pool AS (
  SELECT f.s_suppkey, f.facet_query, c_custkey, CAST(i + 1 AS INTEGER) AS rank,
         ((f.s_suppkey * 37 + i * 61) % 100) / 100.0::DOUBLE AS vector_score, CASE WHEN i % 2 = 0 THEN CAST((f.s_suppkey + i) % 7 AS DOUBLE) END AS keyword_score
  FROM facet_list f JOIN (SELECT c_custkey, c_custkey // (SELECT count(*) FROM supplier) AS i,
    c_custkey % (SELECT count(*) FROM supplier) AS k FROM customer) c ON c.k = f.s_suppkey % (SELECT count(*) FROM supplier)),
pooled AS (SELECT p.*, t.caption, t.headers FROM pool p JOIN tables_ t USING (c_custkey)),
tokens AS (SELECT s_suppkey, facet_query, list_distinct(regexp_extract_all(trim(regexp_replace(facet_query, '[_\\s-]+', ' ', 'g')), '[a-z0-9]+')) AS ts,
             trim(regexp_replace(facet_query, '[_\\s-]+', ' ', 'g')) AS q FROM facet_list),
header_pairs AS (
  SELECT p.s_suppkey, p.c_custkey, lower(h) AS h, t.q, t.ts FROM (SELECT s_suppkey, c_custkey, unnest(headers) AS h FROM pooled) p JOIN tokens t USING (s_suppkey) WHERE h <> ''),
header_scores AS (
  SELECT s_suppkey, c_custkey, max(CASE WHEN contains(q, h) THEN 1.0
      WHEN len(list_filter(ts, lambda x: length(x) >= 3 AND list_contains(list_filter(regexp_extract_all(h, '[a-z0-9]+'), lambda y: length(y) >= 3), x))) > 0 THEN 1.0
      WHEN len(list_filter(ts, lambda x: length(x) >= 3 AND len(list_filter(regexp_extract_all(h, '[a-z0-9]+'), lambda y: length(y) >= 3 AND (starts_with(x, y) OR starts_with(y, x)))) > 0)) > 0 THEN 0.9
      ELSE 0.0 END)::DOUBLE AS header_score FROM header_pairs GROUP BY ALL),
scores AS (
  SELECT p.s_suppkey, p.c_custkey, p.rank, 'cust ' || p.c_custkey AS name, t.q, t.ts, lower(p.caption) AS cap, coalesce(h.header_score, 0.0::DOUBLE) AS header_score,
    CASE WHEN contains(t.q, 'cust ' || p.c_custkey) THEN 1.0::DOUBLE ELSE len(list_intersect(['cust', CAST(p.c_custkey AS VARCHAR)], t.ts)) / 2.0::DOUBLE * 0.8::DOUBLE END AS name_score,
    CASE WHEN contains(t.q, lower(p.caption)) THEN 1.0::DOUBLE WHEN len(list_filter(t.ts, lambda x: length(x) > 2 AND contains(lower(p.caption), x))) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS caption_score,
    greatest(least(vector_score, 1.0::DOUBLE), 0.0::DOUBLE) AS retrieval_score, CASE WHEN s_suppkey % 4 < 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS intent_score
  FROM pooled p JOIN tokens t USING (s_suppkey) LEFT JOIN header_scores h USING (s_suppkey, c_custkey)),
totals AS (SELECT *, round((name_score * 3.0::DOUBLE + caption_score * 2.0::DOUBLE + header_score * 2.0::DOUBLE + retrieval_score * 2.0::DOUBLE + intent_score * 1.0::DOUBLE) / 10.0::DOUBLE, 4) AS score FROM scores)"""


def _pool(spark, sf_dir):
    """(facets, candidates): every customer's table is a candidate of one supplier's question."""
    key = F.col("s_suppkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("list all the records of customer#"), F.lpad(key.cast("string"), 9, "0")))
        .when(key % 4 == 1, F.concat(F.lit("show the table of cust "), key.cast("string")))
        .when(key % 4 == 2, "list rows with priorit and date").otherwise("describe the weather")
    )
    facets = base.table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("query_id"), F.lit(0).alias("facet_index"), text.alias("facet_query"), key.alias("k")
    )
    _, tables = grids.gr.structure_tables(grids.table_rows(spark, sf_dir))
    share = F.lit(base.table(spark, sf_dir, "supplier").count())
    customers = base.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("document_id"),
        F.floor(F.col("c_custkey") / share).cast("int").alias("i"), (F.col("c_custkey") % share).alias("_part"),
    )
    wanted = facets.withColumn("_part", F.col("k") % share).join(customers, "_part").drop("_part")
    candidates = wanted.join(
        tables.select("project_id", "document_id", "table_index", "caption", "headers"), "document_id"
    ).select(
        "query_id", "facet_index", "facet_query", "project_id", "document_id",
        F.concat("document_id", F.lit(".docx")).alias("document_name"),
        F.lit("vector").alias("mode"),
        (F.col("i") + 1).alias("rank"),
        ((F.col("k") * 37 + F.col("i") * 61) % 100 / F.lit(100.0)).alias("vector_score"),
        F.when(F.col("i") % 2 == 0, ((F.col("k") + F.col("i")) % 7).cast("double")).alias("keyword_score"),
        F.lit(None).cast("double").alias("fused_score"),
        schema.meta(
            table_index=F.col("table_index"), caption=F.col("caption"), headers=F.col("headers"),
            table_chunk_type=F.lit("table"),
        ).alias("meta"),
    )
    return facets, candidates


@query(
    "score_tables",
    with_(grids.GRID, _POOL_SQL, body="""SELECT CAST(s_suppkey AS VARCHAR) AS query_id, 'cust-' || c_custkey AS document_id, round(name_score, 9) AS name_score, caption_score,
          header_score, round(retrieval_score, 3) AS retrieval_score, intent_score, score FROM totals"""),
)
def score_tables(spark, sf_dir):
    """Table scores with their parts."""
    return tb.score_tables(_pool(spark, sf_dir)[1]).select(
        "query_id", "document_id", F.round("name_score", 9).alias("name_score"), "caption_score",
        "header_score", "retrieval_score", "intent_score", "score",
    )


@query(
    "select_tables",
    with_(grids.GRID, _POOL_SQL, """placed_scores AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, rank) AS p,
            lead(score) OVER (PARTITION BY s_suppkey ORDER BY score DESC, rank) AS second FROM totals)""",
          body="""SELECT CAST(f.s_suppkey AS VARCHAR) AS query_id, CASE WHEN score IS NULL THEN 'none' WHEN score < 0.15 THEN 'insufficient_score'
          WHEN score - second < 0.15::DOUBLE THEN 'ambiguous' ELSE 'selected' END AS status, CASE WHEN score >= 0.15 AND NOT coalesce(score - second < 0.15::DOUBLE, false) THEN 'cust-' || c_custkey END AS document_id
          FROM facet_list f LEFT JOIN placed_scores p ON p.s_suppkey = f.s_suppkey AND p.p = 1"""),
)
def select_tables(spark, sf_dir):
    """One table, a tie to ask about, or none."""
    facets, candidates = _pool(spark, sf_dir)
    return tb.select_tables(facets, tb.score_tables(candidates)).select(
        "query_id", "status", F.col("selected.document_id").alias("document_id")
    )


@query(
    "preferred_tables",
    with_(grids.GRID, _POOL_SQL, """placed_scores AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, rank) AS p,
            lead(score) OVER (PARTITION BY s_suppkey ORDER BY score DESC, rank) AS second FROM totals),
          outcomes AS (SELECT f.s_suppkey, CASE WHEN score IS NULL THEN 'none' WHEN score < 0.15 THEN 'insufficient_score'
            WHEN score - second < 0.15::DOUBLE THEN 'ambiguous' ELSE 'selected' END AS status FROM facet_list f LEFT JOIN placed_scores p ON p.s_suppkey = f.s_suppkey AND p.p = 1)""",
          body="""SELECT CAST(o.s_suppkey AS VARCHAR) AS query_id, CASE WHEN o.s_suppkey % 5 < 3 THEN o.status WHEN t.c_custkey IS NOT NULL AND o.s_suppkey % 5 = 3 THEN 'selected' ELSE 'insufficient_score' END AS status
          FROM outcomes o LEFT JOIN tables_ t ON t.c_custkey = o.s_suppkey"""),
)
def preferred_tables(spark, sf_dir):
    """Confirmed tables override the choice while they exist within the asked document."""
    facets, candidates = _pool(spark, sf_dir)
    outcomes = tb.select_tables(facets, tb.score_tables(candidates))
    customer = base.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("project_id"),
    )
    scopes = facets.join(customer, "k").select(
        "query_id", "project_id", F.when(F.col("k") % 5 == 4, "cust-elsewhere").otherwise("").alias("scope")
    )
    wanted = facets.where("k % 5 > 2").select(
        "query_id", "facet_index", F.concat(F.lit("cust-"), "query_id").alias("document_id"), F.lit(0).alias("table_index")
    )
    store = durable(grids.table_store(spark, sf_dir))
    return tb.prefer_tables(outcomes, wanted, store, scopes).select("query_id", "status")


@query(
    "expanded_tables",
    with_(grids.GRID, body="""SELECT 'cust-' || c_custkey AS document_id, count(*) AS sections FROM (
          SELECT c_custkey FROM table_sections WHERE type = 'table' UNION ALL
          SELECT s.c_custkey FROM table_sections s WHERE s.type <> 'table' AND NOT EXISTS (SELECT 1 FROM table_sections t WHERE t.type = 'table' AND t.c_custkey = s.c_custkey)) GROUP BY ALL"""),
)
def expanded_tables(spark, sf_dir):
    """Tables expanded to the chunks no parent covers, counted by section."""
    store = durable(grids.table_store(spark, sf_dir))
    keys = store.select("project_id", "document_id", F.col("meta.table_index").alias("table_index"))
    return tb.expand_tables(store, keys).groupBy("document_id").agg(
        F.count_distinct("section_index").alias("sections")
    )


_ITEMS_SQL = """items AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
         CAST(l_quantity AS INTEGER) AS words FROM lineitem)"""


def _items(spark, sf_dir):
    """Line items as row chunks of their order's table; quantity is their length in words."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return base.table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order)).select(
        F.col("l_orderkey").cast("string").alias("query_id"),
        F.concat_ws(":", "l_orderkey", F.lpad(F.col("n").cast("string"), 3, "0")).alias("chunk_id"),
        F.col("n").alias("chunk_index"),
        F.repeat(F.lit("w "), F.col("l_quantity").cast("int")).alias("text"),
        schema.meta(table_chunk_type=F.lit("table_row"), data_row=F.col("n")).alias("meta"),
    )


@query(
    "context_budget",
    with_(_ITEMS_SQL, """folded AS (SELECT k, list_reduce(list_concat([struct_pack(used := 0, kept := 0, words := 0)], list(struct_pack(used := 0, kept := 0, words := words) ORDER BY n)),
            lambda a, b: CASE WHEN a.used + b.words <= 60 THEN struct_pack(used := a.used + b.words, kept := a.kept + 1, words := 0) ELSE a END) AS f, count(*) AS total FROM items GROUP BY k)""",
          body="SELECT CAST(k AS VARCHAR) AS query_id, f.used AS words_used, f.kept AS chunks_kept, total > f.kept AS is_partial FROM folded"),
)
def context_budget(spark, sf_dir):
    """First fit with skipping, per order."""
    _, summary = tb.apply_budget(_items(spark, sf_dir), ("query_id",), [F.col("chunk_index")], 60)
    return summary


def _shared(spark, sf_dir):
    items = _items(spark, sf_dir)
    key = F.col("query_id").cast("long")
    tagged = items.select(
        F.floor(key / 3).cast("string").alias("query_id"),
        F.col("query_id").alias("document_id"),
        F.lit(0).alias("table_index"),
        "chunk_id", "chunk_index", "text", "meta",
        (key % 3).cast("int").alias("facet"),
    )
    groups = tagged.groupBy("query_id", "document_id", "table_index").agg(
        F.first("facet").alias("first_facet"), F.array(F.first("facet")).alias("facet_indexes")
    )
    return tb.apply_shared_budget(groups, tagged.drop("facet"), 120)


def _fit(items, room):
    """First fit with skipping, as a fold over a list of word counts."""
    return f"""list_reduce(list_concat([struct_pack(used := 0::BIGINT, kept := 0::BIGINT, words := 0::BIGINT)], {items}),
      lambda a, b: CASE WHEN a.used + b.words <= {room} THEN struct_pack(used := a.used + b.words, kept := a.kept + 1, words := 0::BIGINT) ELSE a END)"""


def _offer(at):
    """What the table at a place gets of the room that is left, and the room after it."""
    g = f"g{at}"
    return (
        f"""given{at} AS (SELECT *, CASE WHEN {g}.total > {g}.f.kept AND room > 0 THEN {_fit(g + ".xs", f"{g}.f.used + room")} ELSE {g}.f END AS a{at} FROM left{at - 1})""",
        f"""left{at} AS (SELECT * REPLACE (greatest(room - greatest(coalesce(a{at}.used, 0) - coalesce({g}.f.used, 0), 0), 0) AS room) FROM given{at})""",
    )


@query(
    "shared_budget",
    with_(_ITEMS_SQL, """listed AS (SELECT k // 3 AS q, k, CAST(k % 3 AS INTEGER) AS facet, count(*) AS total,
            list(struct_pack(used := 0::BIGINT, kept := 0::BIGINT, words := words::BIGINT) ORDER BY n) AS xs FROM items GROUP BY k),
          shares AS (SELECT *, 120 // count(*) OVER (PARTITION BY q) AS share, row_number() OVER (PARTITION BY q ORDER BY facet) AS i FROM listed)""",
          f"fitted AS (SELECT *, {_fit('xs', 'share')} AS f FROM shares)",
          """left0 AS (SELECT q, greatest(120 - sum(f.used), 0)::BIGINT AS room, any_value(t) FILTER (i = 1) AS g1, any_value(t) FILTER (i = 2) AS g2,
            any_value(t) FILTER (i = 3) AS g3 FROM (SELECT q, i, f, struct_pack(k := k, facet := facet, total := total, xs := xs, f := f) AS t FROM fitted) GROUP BY q)""",
          *_offer(1), *_offer(2), *_offer(3),
          body=" UNION ALL ".join(
              f"""SELECT CAST(q AS VARCHAR) AS query_id, CAST(g{i}.k AS VARCHAR) AS document_id, g{i}.facet AS first_facet,
              CAST(a{i}.used AS INTEGER) AS words_used, g{i}.total > a{i}.kept AS is_partial FROM left3 WHERE g{i} IS NOT NULL""" for i in (1, 2, 3))),
)
def shared_budget(spark, sf_dir):
    """One budget over up to three orders."""
    return _shared(spark, sf_dir)[1].select(
        "query_id", "document_id", "first_facet", "words_used", "is_partial"
    )


@query(
    "table_coverage",
    """WITH spans AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 2 AS f, l_linenumber * 2 + CAST(l_quantity AS INTEGER) % 4 AS l FROM lineitem),
      flagged AS (SELECT *, CASE WHEN f > coalesce(max(l) OVER (PARTITION BY k ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM spans),
      islands AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
      merged AS (SELECT k, island, min(f) AS f, max(l) AS l FROM islands GROUP BY ALL)
      SELECT CAST(k AS VARCHAR) AS document_id, string_agg(f || '-' || l, ',' ORDER BY f) AS row_ranges,
        (SELECT max(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 4 ELSE NULLIF(CAST(l_quantity AS INTEGER) % 5, 0) END) FROM lineitem WHERE l_orderkey = k) AS total_rows FROM merged GROUP BY k""",
)
def table_coverage(spark, sf_dir):
    """Merged row ranges and the known number of rows per order."""
    first = F.col("l_linenumber") * 2
    parts = base.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        schema.meta(
            data_row_start=first, data_row_end=first + F.col("l_quantity").cast("int") % 4,
            total_rows=F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber") * 4),
            row_count=F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity").cast("int") % 5),
        ).alias("meta"),
    )
    covered = tb.table_coverage(parts, ("document_id",))
    return covered.select(
        "document_id",
        F.array_join(
            F.transform("row_ranges", lambda r: F.concat_ws("-", r["first"], r["last"])), ","
        ).alias("row_ranges"),
        "total_rows",
    )


def _table_questions(spark, sf_dir):
    """One question per supplier, asked in the project of the customer with the same number."""
    customer = base.table(spark, sf_dir, "customer")
    key = F.col("s_suppkey")
    text = (
        F.when(key % 3 == 0, F.concat(F.lit("list all the records of "), F.col("c_name")))
        .when(
            key % 3 == 1,
            F.concat(F.lit("show the table of "), F.col("c_name"), F.lit(" and list all rows of "), F.col("c_name")),
        )
        .otherwise(F.concat(F.lit("which status has order "), key.cast("string")))
    )
    return base.table(spark, sf_dir, "supplier").join(customer, key == F.col("c_custkey")).select(
        key.cast("string").alias("query_id"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("project_id"),
        text.alias("query"),
        F.lit("keyword").alias("mode"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def _retrieved(spark, sf_dir):
    """Every question answered over a store of all tables, which is cut with what retrieval reads of it."""
    with released_shuffles(spark):
        store = durable(grids.table_store(spark, sf_dir).drop("section_index", "token_count", "content_hash"))
        return retrieval.retrieve_full(_table_questions(spark, sf_dir), store)


@query("retrieve_tables")
def retrieve_tables(spark, sf_dir):
    """Intent, pools, choice, expansion, budget and evidence for every question."""
    return _retrieved(spark, sf_dir).ranked.select(
        "query_id", "rank", "chunk_id", "expanded", "evidence_selection_reason"
    )


@query("table_prompts")
def table_prompts(spark, sf_dir):
    """M6-M8: prompts over retrieved tables, with notes where a table was cut."""
    found = _retrieved(spark, sf_dir)
    results = durable(found.results)
    sources = results.where("expanded and is_compound").select("query_id", "document_id", "rank").join(
        found.coverage.select("query_id", "document_id", "facet_indexes"), ["query_id", "document_id"]
    )
    compound = found.queries.where("is_compound").select("query_id")
    notes = pr.facet_notes(
        found.outcomes.join(compound, "query_id", "left_semi"), sources,
        found.coverage.join(compound, "query_id", "left_semi"),
    ).unionByName(pr.partial_note(found.coverage.join(compound, "query_id", "left_anti")))
    built = pr.build_prompts(found.queries, results, notes=notes)
    return built.select(
        "query_id", "should_refuse", F.size("messages").alias("messages"),
        F.char_length(F.get("messages", F.lit(0))["content"]).alias("system_length"),
    )
