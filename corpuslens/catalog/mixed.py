"""Questions over a store in which text and tables of one document meet.

A customer is a document: a plain text (the document of the same number, where there is one), and a
table of its orders: a group that covers the first half of the rows, a header, and every row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.catalog import base, grids, sqlbase
from corpuslens.catalog.registry import query, with_
from corpuslens.catalog.tableqa import _POOL_SQL, _fit, _pool
from corpuslens.operators import evidence, fusion
from corpuslens.operators import prompts as pr
from corpuslens.operators import tables as tb
from corpuslens.plans import retrieval
from corpuslens.session import durable

BUDGET = 60
TOP = 5

STORE_SQL = """numbered AS (
  SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r,
         count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority AS line FROM orders),
store AS (
  SELECT c, 'cust-' || c || ':' || lpad(CAST(2 + r AS VARCHAR), 4, '0') AS chunk_id, CAST(2 + r AS INTEGER) AS chunk_index, line AS text,
         'table_row' AS kind, r AS row, NULL::BIGINT AS first, NULL::BIGINT AS last FROM numbered
  UNION ALL SELECT c, 'cust-' || c || ':0001', 1, string_agg(line, ' ' ORDER BY r), 'table_group', NULL, 1, max((n + 1) // 2)
  FROM numbered WHERE r <= (n + 1) // 2 GROUP BY c
  UNION ALL SELECT DISTINCT c, 'cust-' || c || ':0002', 2, 'order status priority', 'table_header', NULL, NULL, NULL FROM numbered
  UNION ALL SELECT c_custkey, 'cust-' || c_custkey || ':0000', 0, text, NULL, NULL, NULL, NULL FROM customer JOIN documents ON doc_id = c_custkey),
sized AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM store)"""


def store(spark, sf_dir):
    """The mixed store: one document per customer, its text and its table of orders."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = base.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c"), F.row_number().over(order).alias("r"),
        F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).cast("int").alias("n"),
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("line"),
    )
    half = F.floor((F.col("n") + 1) / 2).cast("int")
    table = {"table_index": F.lit(0), "caption": F.concat(F.lit("Orders of "), F.col("c").cast("string"))}
    parts = [
        rows.select("c", (F.col("r") + 2).alias("chunk_index"), F.col("line").alias("text"), schema.meta(table_chunk_type=F.lit("table_row"), data_row=F.col("r"), total_rows=F.col("n"), **table).alias("meta")),
        rows.where(F.col("r") <= half).groupBy("c", "n").agg(F.array_join(F.sort_array(F.collect_list(F.struct("r", "line")))["line"], " ").alias("text")).select(
            "c", F.lit(1).alias("chunk_index"), "text",
            schema.meta(table_chunk_type=F.lit("table_group"), data_row_start=F.lit(1), data_row_end=half, total_rows=F.col("n"), **table).alias("meta"),
        ),
        rows.select("c", "n").distinct().select(
            "c", F.lit(2).alias("chunk_index"), F.lit("order status priority").alias("text"),
            schema.meta(table_chunk_type=F.lit("table_header"), total_rows=F.col("n"), **table).alias("meta"),
        ),
        base.table(spark, sf_dir, "customer").join(base.table(spark, sf_dir, "documents"), F.col("doc_id") == F.col("c_custkey")).select(
            F.col("c_custkey").alias("c"), F.lit(0).alias("chunk_index"), "text", schema.meta(format=F.lit("text")).alias("meta")
        ),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    name = F.concat(F.lit("cust-"), F.col("c").cast("string"))
    return every.select(
        F.lit("p").alias("project_id"), name.alias("document_id"), F.concat(name, F.lit(".docx")).alias("document_name"), "chunk_index",
        F.concat_ws(":", name, F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"), "text", "meta",
        F.lit(True).alias("is_active"), F.col("c"),
    )


# One question per customer.  Of every three the first is about one table, beside which the text of the document is found; the
# other two ask for two tables by two facets, which are the same table for every ninth.
_GROUPS_SQL = """asked AS (
  SELECT c_custkey AS q, c_custkey AS c, 0 AS facet FROM customer
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 9 = 1 THEN c_custkey ELSE (c_custkey + 1) % (SELECT count(*) FROM customer) END, 1 FROM customer WHERE c_custkey % 3 > 0),
groups AS (SELECT q, c, min(facet) AS facet, list(facet ORDER BY facet) AS facets FROM asked GROUP BY q, c),
own AS (
  SELECT c, chunk_id, words, row_number() OVER (PARTITION BY c ORDER BY CASE kind WHEN 'table_group' THEN 0 ELSE 2 END, coalesce(first, row), chunk_index, chunk_id) AS n
  FROM sized s WHERE kind = 'table_group' OR (kind = 'table_row' AND row > (SELECT g.last FROM sized g WHERE g.c = s.c AND g.kind = 'table_group'))),
listed AS (
  SELECT g.q, g.c, g.facet, g.facets, (SELECT count(*) FROM own o WHERE o.c = g.c) AS total,
         (SELECT coalesce(list(struct_pack(used := 0::BIGINT, kept := CAST([] AS VARCHAR[]), words := o.words::BIGINT, id := o.chunk_id) ORDER BY o.n), []) FROM own o WHERE o.c = g.c) AS xs
  FROM groups g),
beside AS (SELECT c, list(struct_pack(used := 0::BIGINT, kept := CAST([] AS VARCHAR[]), words := words::BIGINT, id := chunk_id)) AS ys FROM sized WHERE kind IS NULL GROUP BY c)"""


def _fold(items: str, room: str) -> str:
    """First fit with skipping that keeps ids."""
    return f"""list_reduce(list_concat([struct_pack(used := 0::BIGINT, kept := CAST([] AS VARCHAR[]), words := 0::BIGINT, id := '')], {items}),
      lambda a, b: CASE WHEN a.used + b.words <= {room} THEN struct_pack(used := a.used + b.words, kept := list_append(a.kept, b.id), words := 0::BIGINT, id := '') ELSE a END)"""


def _offered(at: int) -> tuple[str, str]:
    g = f"g{at}"
    return (
        f"given{at} AS (SELECT *, CASE WHEN {g}.total > len({g}.f.kept) AND room > 0 THEN {_fold(g + '.xs', f'{g}.f.used + room')} ELSE {g}.f END AS a{at} FROM left{at - 1})",
        f"left{at} AS (SELECT * REPLACE (greatest(room - greatest(coalesce(a{at}.used, 0) - coalesce({g}.f.used, 0), 0), 0) AS room) FROM given{at})",
    )


_CONTEXT_SQL = (
    STORE_SQL, _GROUPS_SQL,
    f"single AS (SELECT l.*, coalesce(ys, []) AS ys, {_fold('list_concat(xs, coalesce(ys, []))', str(BUDGET))} AS f FROM listed l LEFT JOIN beside USING (c) WHERE q % 3 = 0)",
    f"shares AS (SELECT *, {BUDGET} // count(*) OVER (PARTITION BY q) AS share, row_number() OVER (PARTITION BY q ORDER BY facet) AS i FROM listed WHERE q % 3 > 0)",
    f"fitted AS (SELECT *, {_fold('xs', 'share')} AS f FROM shares)",
    f"""left0 AS (SELECT q, greatest({BUDGET} - sum(f.used), 0)::BIGINT AS room, any_value(t) FILTER (i = 1) AS g1, any_value(t) FILTER (i = 2) AS g2
      FROM (SELECT q, i, f, struct_pack(c := c, facets := facets, total := total, xs := xs, f := f) AS t FROM fitted) GROUP BY q)""",
    *_offered(1), *_offered(2),
    """context AS (
      SELECT q, c, [0] AS facets, total + len(ys) > len(f.kept) AS is_partial, unnest(f.kept) AS chunk_id, generate_subscripts(f.kept, 1) AS rank FROM single
      UNION ALL SELECT q, g1.c, g1.facets, g1.total > len(a1.kept) OR g1.total = 0, unnest(a1.kept), generate_subscripts(a1.kept, 1) FROM left2
      UNION ALL SELECT q, g2.c, g2.facets, g2.total > len(a2.kept) OR g2.total = 0, unnest(a2.kept), len(a1.kept) + generate_subscripts(a2.kept, 1) FROM left2 WHERE g2 IS NOT NULL)""",
)


def _context(spark, sf_dir):
    """(groups, kept, summaries of single and shared questions, lists)."""
    chunks = durable(store(spark, sf_dir))
    customer = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"))
    n = customer.count()
    second = F.when(F.col("q") % 9 == 1, F.col("q")).otherwise((F.col("q") + 1) % n)
    facets = customer.select("q", F.col("q").alias("c"), F.lit(0).alias("facet_index")).unionByName(
        customer.where("q % 3 > 0").select("q", second.alias("c"), F.lit(1).alias("facet_index"))
    )
    name = F.concat(F.lit("cust-"), F.col("c").cast("string"))
    outcomes = facets.select(
        F.col("q").cast("string").alias("query_id"), "facet_index",
        F.struct(name.alias("document_id"), F.lit(0).alias("table_index"), F.concat(name, F.lit(".docx")).alias("document_name"), F.lit(None).cast("string").alias("caption")).alias("selected"),
    )
    groups = durable(tb.facet_groups(outcomes).withColumn("project_id", F.lit("p")))
    identity = ("project_id", "document_id", "table_index")
    lists = durable(tb.budget_lists(tb.expand_tables(chunks, groups), identity, BUDGET))
    single = F.col("query_id").cast("long") % 3 == 0
    alone = groups.where(single)
    companions = chunks.where(tb.not_tabular()).join(alone.select("query_id", "document_id"), "document_id").select(
        "query_id", "chunk_id", tb.tx.word_count(F.col("text")).alias("words"), F.lit(1).alias("rank")
    )
    kept, summary = tb.companion_budget(alone, lists, companions, identity, BUDGET)
    shared, outcome = tb.share_budget(groups.where(~single), lists, identity, BUDGET)
    return chunks, groups, kept, summary, shared, outcome


@query(
    "expanded_context",
    with_(*_CONTEXT_SQL, body="""SELECT CAST(q AS VARCHAR) AS query_id, 'cust-' || c AS document_id, array_to_string(facets, ',') AS facets,
          chunk_id, CAST(rank AS INTEGER) AS rank, is_partial FROM context"""),
)
def expanded_context(spark, sf_dir):
    """Kept chunks of expanded tables, companion texts and tables shared by two facets, in order."""
    _, groups, kept, summary, shared, outcome = _context(spark, sf_dir)
    single = kept.join(summary.select("query_id", "is_partial"), "query_id").join(groups.select("query_id", "facet_indexes"), "query_id")
    both = shared.join(outcome.select("query_id", "document_id", "is_partial"), ["query_id", "document_id"])
    names = ("query_id", "document_id", "facet_indexes", "chunk_id", "rank", "is_partial")
    return single.select(*names).unionByName(both.select(*names)).select(
        "query_id", "document_id", F.array_join(F.col("facet_indexes").cast("array<string>"), ",").alias("facets"), "chunk_id", "rank", "is_partial"
    )


@query(
    "facet_notes",
    with_(
        *_CONTEXT_SQL,
        """parts AS (SELECT q, 0 AS i, g1 AS g, a1 AS a FROM left2 UNION ALL SELECT q, 1, g2, a2 FROM left2 WHERE g2 IS NOT NULL),
        places AS (SELECT q, unnest(facets) AS facet, rank FROM context WHERE q % 3 > 0),
        facet_lines AS (SELECT x.q, x.facet, 'Facet ' || (x.facet + 1) || ': table of ' || x.c || '; sources: ' || coalesce(string_agg('[Source ' || rank || ']', ', ' ORDER BY rank), '') AS line
          FROM asked x LEFT JOIN places p ON p.q = x.q AND p.facet = x.facet WHERE x.q % 3 > 0 GROUP BY x.q, x.facet, x.c),
        spans AS (SELECT x.q, x.c, coalesce(first, row) AS f, coalesce(last, row) AS l FROM context x JOIN sized s USING (chunk_id) WHERE x.q % 3 > 0),
        flagged AS (SELECT *, CASE WHEN f > coalesce(max(l) OVER (PARTITION BY q, c ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM spans),
        islands AS (SELECT q, c, island, min(f) AS f, max(l) AS l FROM (SELECT *, sum(fresh) OVER (PARTITION BY q, c ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS island FROM flagged) GROUP BY ALL),
        covered AS (SELECT q, c, string_agg(CASE WHEN f = l THEN CAST(f AS VARCHAR) ELSE f || '-' || l END, ', ' ORDER BY f) AS ranges FROM islands GROUP BY q, c),
        totals AS (SELECT c, max(n) AS n FROM numbered GROUP BY c),
        cut_lines AS (SELECT p.q, p.i, unnest(p.g.facets) AS facet, CASE WHEN ranges IS NULL THEN 'no rows were retained.' ELSE 'provided rows ' || ranges || ' of ' || n || '.' END AS text
          FROM parts p LEFT JOIN covered v ON v.q = p.q AND v.c = p.g.c LEFT JOIN totals t ON t.c = p.g.c WHERE p.g.total > len(p.a.kept) OR p.g.total = 0),
        cuts AS (SELECT q, string_agg('Facet ' || (facet + 1) || ' is partial; ' || text, chr(10) ORDER BY i, facet) AS text FROM cut_lines GROUP BY q),
        lines_ AS (SELECT q, string_agg(line, chr(10) ORDER BY facet) AS text FROM facet_lines GROUP BY q)""",
        body="""SELECT CAST(l.q AS VARCHAR) AS query_id, '@FACETS@' || chr(10) || l.text || CASE WHEN c.text IS NULL THEN '' ELSE chr(10) || c.text || chr(10) || '@NOT_COMPLETE@' END || chr(10) || chr(10) AS note
          FROM lines_ l LEFT JOIN cuts c USING (q)""".replace("@FACETS@", pr.FACETS.replace("'", "''")).replace("@NOT_COMPLETE@", pr.NOT_COMPLETE.replace("'", "''")),
    ),
)
def facet_notes(spark, sf_dir):
    """Which sources answer which facet, and which rows of a cut table are there."""
    chunks, groups, _, _, shared, outcome = _context(spark, sf_dir)
    kept = durable(shared)
    keys = ("query_id", "document_id", "table_index")
    covered = tb.table_coverage(kept.join(chunks.select("chunk_id", "meta"), "chunk_id"), keys)
    # A table of which nothing was kept still has its number of rows.
    totals = tb.table_coverage(chunks.withColumn("table_index", F.col("meta.table_index")), ("document_id", "table_index")).select("document_id", "table_index", "total_rows")
    coverage = outcome.join(covered.drop("total_rows"), [*keys], "left").join(totals, ["document_id", "table_index"], "left")
    asked = groups.where("cast(query_id as long) % 3 > 0").select("query_id", "document_id", F.explode("facet_indexes").alias("facet_index"))
    outcomes = asked.select("query_id", "facet_index", F.concat(F.lit("table of "), F.substring_index("document_id", "-", -1)).alias("facet_query"))
    return pr.facet_notes(outcomes, kept.select("query_id", "rank", "facet_indexes"), coverage)


_FACETS_SQL = """placed_scores AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, rank) AS p,
    lead(score) OVER (PARTITION BY s_suppkey ORDER BY score DESC, rank) AS second FROM totals),
  facets AS (SELECT f.s_suppkey // 3 AS q, CAST(f.s_suppkey % 3 AS INTEGER) AS facet, c_custkey, CASE WHEN score IS NULL THEN 'none' WHEN score < 0.15 THEN 'insufficient_score'
    WHEN score - second < 0.15::DOUBLE THEN 'ambiguous' ELSE 'selected' END AS status FROM facet_list f LEFT JOIN placed_scores p ON p.s_suppkey = f.s_suppkey AND p.p = 1)"""


@query(
    "select_facets",
    with_(grids.GRID, _POOL_SQL, _FACETS_SQL, body="""SELECT CAST(q AS VARCHAR) AS query_id, CAST(count(*) AS INTEGER) AS facet_count, bool_and(status = 'selected') AS can_generate,
          bool_or(status = 'ambiguous') AS requires_clarification, coalesce(string_agg(CAST(facet AS VARCHAR), ',' ORDER BY facet) FILTER (status <> 'selected'), '') AS unresolved,
          min(facet) FILTER (status = 'ambiguous') AS pending_facet_index FROM facets GROUP BY q"""),
)
def select_facets(spark, sf_dir):
    """Several facets of one question, each with its own table, and what is left to ask."""
    facets, candidates = _pool(spark, sf_dir)
    parted = lambda df: df.withColumn("facet_index", (F.col("query_id").cast("long") % 3).cast("int")).withColumn(
        "query_id", F.floor(F.col("query_id").cast("long") / 3).cast("string")
    )
    outcomes = tb.select_tables(parted(facets), tb.score_tables(parted(candidates)))
    return tb.plan_outcomes(outcomes).select(
        "query_id", "facet_count", "can_generate", "requires_clarification",
        F.array_join(F.col("unresolved_facet_indexes").cast("array<string>"), ",").alias("unresolved"), "pending_facet_index",
    )


@query(
    "mixed_evidence",
    with_(
        STORE_SQL,
        """pool AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY (c * 7 + chunk_index * 13) % 11, chunk_id) AS rank, (chunk_index + c) % 4 = 0 AS e, (chunk_index + c) % 5 = 0 AS o FROM store),
        strong AS (SELECT *, CASE WHEN e THEN 0 WHEN o THEN 1 ELSE 2 END AS strength FROM pool),
        ordered AS (SELECT c, list(struct_pack(id := chunk_id, f := coalesce(first, row), l := coalesce(last, row), parent := kind = 'table_group', chosen := CAST([] AS STRUCT(id VARCHAR, f BIGINT, l BIGINT, parent BOOLEAN)[])) ORDER BY strength, rank, chunk_id) AS xs
          FROM strong WHERE coalesce(first, row) IS NOT NULL GROUP BY c),
        folded AS (SELECT c, list_reduce(list_concat([struct_pack(id := '', f := 0::BIGINT, l := 0::BIGINT, parent := false, chosen := CAST([] AS STRUCT(id VARCHAR, f BIGINT, l BIGINT, parent BOOLEAN)[]))], xs),
          lambda a, b: CASE WHEN len(list_filter(a.chosen, lambda k: CASE WHEN k.parent = b.parent THEN k.f = b.f AND k.l = b.l ELSE (b.f <= k.f AND b.l >= k.l) OR (k.f <= b.f AND k.l >= b.l) END)) > 0 THEN a
            ELSE struct_pack(id := a.id, f := a.f, l := a.l, parent := a.parent, chosen := list_append(a.chosen, struct_pack(id := b.id, f := b.f, l := b.l, parent := b.parent))) END) AS state FROM ordered),
        survivors AS (SELECT s.* FROM strong s LEFT JOIN folded f USING (c) WHERE coalesce(s.first, s.row) IS NULL OR list_contains(list_transform(f.state.chosen, lambda k: k.id), s.chunk_id)),
        firsts AS (SELECT *, strength < 2 AND row_number() OVER (PARTITION BY c, strength ORDER BY rank) = 1 AS protected FROM survivors),
        needs AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN protected THEN strength ELSE 2 END, rank) AS need FROM firsts)""",
        body=f"""SELECT 'cust-' || c AS query_id, chunk_id, CASE WHEN protected THEN CASE strength WHEN 0 THEN 'protected_exact_identifier' ELSE 'protected_contained_identifier' END ELSE 'ranked_fill' END AS reason,
          CAST(row_number() OVER (PARTITION BY c ORDER BY rank) AS INTEGER) AS rank FROM needs WHERE need <= {TOP}""",
    ),
)
def mixed_evidence(spark, sf_dir):
    """Text, table parts and rows in one pool; overlapping parts dropped, then protected and filled."""
    place = (F.col("c") * 7 + F.col("chunk_index") * 13) % 11
    pool = store(spark, sf_dir).select(
        F.col("document_id").alias("query_id"), "document_id", "chunk_id", "meta",
        F.row_number().over(Window.partitionBy("c").orderBy(place, "chunk_id")).alias("rank"),
        ((F.col("chunk_index") + F.col("c")) % 4 == 0).cast("int").alias("exact_identifiers"),
        ((F.col("chunk_index") + F.col("c")) % 5 == 0).cast("int").alias("contained_identifiers"),
    )
    return evidence.select_evidence(durable(pool), TOP).select("query_id", "chunk_id", F.col("evidence_selection_reason").alias("reason"), "rank")


_MODES = ("vector", "keyword", "hybrid")
_WIDTH = 20


@query(
    "mixed_modes",
    with_(
        sqlbase.KEYWORD, sqlbase.VECTOR,
        f"""by_vector AS (SELECT * FROM vector_ranked WHERE rank <= {_WIDTH} AND CAST(query_id AS BIGINT) % 3 <> 1),
        by_keyword AS (SELECT * FROM keyword_ranked WHERE rank <= {_WIDTH} AND CAST(query_id AS BIGINT) % 3 <> 0)""",
        sqlbase.fused(_WIDTH).replace("FROM vector_ranked", "FROM by_vector").replace("FROM keyword_ranked", "FROM by_keyword"),
        f"""single AS (SELECT query_id, chunk_id, rank, vector_score, CAST(NULL AS DOUBLE) AS keyword_score FROM by_vector WHERE CAST(query_id AS BIGINT) % 3 = 0
          UNION ALL SELECT query_id, chunk_id, rank, NULL, keyword_score FROM by_keyword WHERE CAST(query_id AS BIGINT) % 3 = 1
          UNION ALL SELECT query_id, chunk_id, rank, vector_score, keyword_score FROM fused WHERE CAST(query_id AS BIGINT) % 3 = 2 AND rank <= {_WIDTH})""",
        body="SELECT query_id, chunk_id, rank, round(vector_score, 9) AS vector_score, keyword_score FROM single",
    ),
)
def mixed_modes(spark, sf_dir):
    """V7: vector, keyword and hybrid questions in one table of requests."""
    asked = base.queries(spark, sf_dir).withColumn(
        "mode", F.element_at(F.array(*map(F.lit, _MODES)), (F.col("item_id") % 3 + 1).cast("int"))
    )
    chunks = durable(base.embedded_chunks(spark, sf_dir))
    found = retrieval.retrieve(fusion.with_request_defaults(asked.withColumn("top_k", F.lit(_WIDTH))), chunks, max_limit=_WIDTH)
    return found.select("query_id", "chunk_id", "rank", F.round("vector_score", 9).alias("vector_score"), "keyword_score")
