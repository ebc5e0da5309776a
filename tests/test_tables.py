from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from support import questions, table_cells

from corpuslens import schema
from corpuslens.functions import intent
from corpuslens.operators import chunking, grids, logs, tables
from corpuslens.plans.retrieval import retrieve_full
from corpuslens.session import durable
from corpuslens.sources.sections import number_blocks


@pytest.mark.parametrize(
    "query, full, table",
    [
        ("列出所有行", True, True),
        ("列出所有行为", False, False),
        ("列出服务器", True, True),
        ("全部记录", True, True),
        ("有哪些", False, False),
        ("Show the full table", True, True),
        ("list servers", True, True),
        ("listing of hosts", False, False),
        ("what is the port", False, True),
        ("describe recovery", False, False),
    ],
)
def test_intent(spark, query, full, table):
    row = spark.createDataFrame([(query,)], "q string").select(
        intent.is_full_table(F.col("q")), intent.is_table(F.col("q"))
    ).first()
    assert tuple(row) == (full, table)


@pytest.mark.parametrize(
    "query, want",
    [
        (" list all rows and show table ", ["list all rows", "show table"]),
        ("list all rows, and tell a story", ["list all rows, and tell a story"]),
        ("列出表格和显示数据表", ["列出表格", "显示数据表"]),
        ("list rows and " * 4 + "list rows", ["list rows and " * 4 + "list rows"]),
    ],
)
def test_facets(spark, query, want):
    assert spark.createDataFrame([(query,)], "q string").select(intent.facets(F.col("q"))).first()[0] == want


@pytest.mark.parametrize(
    "query, header, want",
    [
        ("show the host name", "host name", 1.0), ("show servers", "my servers", 1.0), ("show server", "servers", 0.9),
        ("show the hosts", "主机", 0.8), ("主机", "server", 0.8), ("the user name", "用户", 0.8), ("node", "mail", 0.0), ("", "", 0.0),
    ],
)
def test_header_match_with_the_question_known(spark, query, header, want):
    """What is known of the question beforehand gives what each header would have worked out."""
    df = spark.createDataFrame([(query, header)], "q string, h string")
    known = df.withColumn("m", tables._long_tokens(F.col("q"))).withColumn("c", tables._asked_concepts(F.col("q")))
    plain = df.select(tables.header_match(F.col("q"), F.col("h"))).first()[0]
    assert plain == known.select(tables.header_match(*map(F.col, "qhmc"))).first()[0] == want


def items(spark, sizes, query="q", kind="table_row"):
    rows = [(query, f"c{i:03}", i, "w " * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, chunk_index int, text string")
    return df.withColumn("meta", schema.meta(table_chunk_type=F.lit(kind), data_row=F.col("chunk_index") + 1))


def greedy(sizes, budget):
    used, kept = 0, []
    for i, n in enumerate(sizes):
        if used + n <= budget:
            used, kept = used + n, kept + [i]
    return used, kept


def test_budget_skips_what_does_not_fit(spark):
    kept, summary = tables.apply_budget(items(spark, [6, 8, 2, 2]), ("query_id",), [F.col("chunk_index")], 12)
    assert [r.chunk_index for r in kept.orderBy("rank").collect()] == [0, 2, 3]
    assert tuple(summary.first()) == ("q", 10, 3, True)


def test_budget_matches_a_plain_loop_on_long_tables(spark):
    rng = random.Random(5)
    for budget in (37, 200):
        sizes = [rng.choice([1, 3, 3, 9, 20, 60]) for _ in range(900)]
        kept, summary = tables.apply_budget(items(spark, sizes), ("query_id",), [F.col("chunk_index")], budget)
        used, want = greedy(sizes, budget)
        assert [r.chunk_index for r in kept.orderBy("rank").collect()] == want
        assert summary.first().words_used == used


def test_shared_budget_matches_a_plain_loop(spark):
    rng = random.Random(11)
    cases = {f"q{i}": [[rng.randint(1, 30) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))] for i in range(25)}
    groups, rows = [], []
    for q, lists in cases.items():
        for f, sizes in enumerate(lists):
            groups.append((q, f"d{f}", 0, f, [f]))
            rows += [(q, f"d{f}", 0, f"d{f}-{i:03}", i, "w " * n) for i, n in enumerate(sizes)]
    group_df = spark.createDataFrame(groups, "query_id string, document_id string, table_index int, first_facet int, facet_indexes array<int>")
    row_df = spark.createDataFrame(rows, "query_id string, document_id string, table_index int, chunk_id string, chunk_index int, text string")
    row_df = row_df.withColumn("meta", schema.meta(table_chunk_type=F.lit("table_row"), data_row=F.col("chunk_index") + 1))
    kept, outcome = tables.apply_shared_budget(group_df, row_df, 60)
    got, ranks = {}, {}
    for r in kept.orderBy("query_id", "rank").collect():
        got.setdefault((r.query_id, r.document_id), []).append(r.chunk_index)
        ranks.setdefault(r.query_id, []).append(r.rank)
    partial = {(r.query_id, r.first_facet): r.is_partial for r in outcome.collect()}
    assert all(seen == list(range(1, len(seen) + 1)) for seen in ranks.values())
    for q, lists in cases.items():
        share = 60 // len(lists)
        fits = [greedy(sizes, share) for sizes in lists]
        left = max(60 - sum(used for used, _ in fits), 0)
        for f, sizes in enumerate(lists):
            used, chosen = fits[f]
            if len(chosen) < len(sizes) and left > 0:
                fits[f] = greedy(sizes, used + left)
                left = max(left - max(fits[f][0] - used, 0), 0)
        for f, sizes in enumerate(lists):
            assert got.get((q, f"d{f}"), []) == fits[f][1], (q, f)
            assert partial[(q, f)] == (len(fits[f][1]) < len(sizes) or not sizes)


def test_coverage_merges_ranges(spark):
    df = spark.createDataFrame([("d", 1, 4, 12), ("d", 5, 8, 12), ("d", 11, 11, 12)], "document_id string, a int, b int, n int")
    df = df.select("document_id", schema.meta(data_row_start=F.col("a"), data_row_end=F.col("b"), total_rows=F.col("n")).alias("meta"))
    row = tables.table_coverage(df, ("document_id",)).first()
    assert ([tuple(r) for r in row.row_ranges], row.total_rows) == ([(1, 8), (11, 11)], 12)


@pytest.fixture(scope="module")
def store(spark):
    header = (["Name", "Role"], True)
    cells = table_cells(
        spark,
        {
            "server_list": [[("Server list", 2, None, None)], header] + [[f"web{i}", "front end"] for i in range(8)],
            "account_list": [[("Account list", 2, None, None)], (["User", "Mail"], True), ["ann", "a@x"], ["bob", "b@x"]],
        },
    )
    chunks = chunking.as_store_rows(chunking.chunk_sections(number_blocks(grids.table_blocks(cells)), 16, 2))
    return durable(chunks.withColumn("embedding", F.lit(None).cast("array<float>")))


def ask(spark, store, *rows, **kwargs):
    asked = questions(spark, rows).withColumn("mode", F.lit("keyword"))
    return retrieve_full(asked, store, **kwargs)


def test_expansion_replaces_hits_by_the_whole_table(spark, store):
    found = ask(spark, store, ("one", "show the server list table"), ("row", "which role has ann"))
    rows = found.results.orderBy("query_id", "rank").collect()
    one = [r for r in rows if r.query_id == "one"]
    assert {r.document_id for r in one} == {"server_list"} and all(r.expanded for r in one)
    assert {r.meta.table_chunk_type for r in one} == {"table_group"}
    cover = found.coverage.where("query_id = 'one'").first()
    assert ([tuple(r) for r in cover.row_ranges], cover.total_rows, cover.is_partial) == ([(1, 8)], 8, False)
    assert any(r.query_id == "row" and not r.expanded for r in rows)


def test_logs_hold_choice_expansion_and_previews(spark, store, tmp_path):
    found = ask(spark, store, ("one", "show the server list table"), ("row", "which role has ann"))
    results = durable(found.results)
    logs.write_logs(found.queries, results, str(tmp_path), found.outcomes, found.coverage)
    rows = {r.retrieval_log_id: r.retrieval_metadata for r in spark.read.parquet(f"{tmp_path}/logs").collect()}
    assert rows["one"].full_table and not rows["row"].full_table and rows["row"].expansion is None
    assert json.loads(rows["one"].selection)[0]["document_id"] == "server_list"
    assert json.loads(rows["one"].expansion)[0]["total_rows"] == 8
    logged = logs.log_detail(spark.read.parquet(f"{tmp_path}/log_chunks"), store).collect()
    assert len(logged) == results.count() and all(r.text_preview for r in logged)
    assert "text" not in logs.result_view(results).columns


def test_compound_question_shares_the_budget(spark, store):
    found = ask(spark, store, ("two", "show the server list and show the account list"), budget=30)
    status = {r.facet_index: (r.status, r.selected.document_id) for r in found.outcomes.collect()}
    assert status == {0: ("selected", "server_list"), 1: ("selected", "account_list")}
    cover = {r.document_id: r.is_partial for r in found.coverage.collect()}
    assert cover == {"server_list": True, "account_list": False}


def test_confirmed_table_wins(spark, store):
    wanted = spark.createDataFrame([("q", 0, "account_list", 0), ("gone", 0, "nothing", 0)], "query_id string, facet_index int, document_id string, table_index int")
    found = ask(spark, store, ("q", "show the server list"), ("gone", "show the server list"), preferences=wanted)
    got = {r.query_id: (r.status, r.reason) for r in found.outcomes.collect()}
    assert got == {"q": ("selected", tables.CONFIRMED), "gone": ("insufficient_score", tables.GONE)}


def test_rows_inside_a_parent_are_dropped(spark, store):
    kinds = {r.table_chunk_type for r in tables.expand_tables(store, store.select("project_id", "document_id", F.lit(0).alias("table_index"))).select("meta.table_chunk_type").collect()}
    assert kinds <= {"table", "table_group"}


def test_header_match(spark):
    rows = [("list the user mail", "Mail", 1.0), ("show usernames", "Username", 1.0), ("list servernames", "server id", 0.9), ("列出服务器", "Server", 0.8), ("weather", "Server", 0.0)]
    df = spark.createDataFrame(rows, "q string, h string, want double")
    got = df.select(tables.header_match(tables.normalise_text(F.col("q")), tables.normalise_text(F.col("h"))).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_candidates_are_dealt_out_before_they_are_scored(spark):
    """A pool that comes from one task is not scored by one task: one exchange, below the matching of headers."""
    facets = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(0).alias("facet_index"), F.lit("list hosts").alias("facet_query"))
    pool = facets.crossJoin(spark.range(0, 50, 1, 1)).select(
        "query_id", "facet_index", "facet_query", F.col("id").cast("string").alias("document_id"),
        F.concat("id", F.lit(".docx")).alias("document_name"), F.lit("vector").alias("mode"), F.col("id").cast("int").alias("rank"),
        F.lit(0.5).alias("vector_score"), F.lit(None).cast("double").alias("keyword_score"), F.lit(None).cast("double").alias("fused_score"),
        schema.meta(table_index=F.lit(0), caption=F.lit("c"), headers=F.array(F.lit("host"))).alias("meta"),
    )
    scored = tables.score_tables(pool)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("Range")[0]
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression")
    assert scored.count() == 50 and scored.where("header_score = 1.0").count() == 50


def test_a_fit_is_folded_once_per_offer(spark):
    """Sharing a budget folds each list once for its share and once for what is left, not once per field it returns."""
    item = "array<struct<_at:int,words:int,chunk_id:string>>"
    groups = spark.createDataFrame([("q", d, 0, f, [f]) for f, d in enumerate("ab")], "query_id string, document_id string, table_index int, first_facet int, facet_indexes array<int>")
    lists = spark.createDataFrame(
        [("a", [(1, 2, "a1")], 1), ("b", [(1, 4, "b1"), (2, 4, "b2")], 2)], f"document_id string, items {item}, total int"
    )
    kept, outcome = tables.share_budget(groups, lists, ("document_id",), 10)
    assert sorted((r.document_id, r.words_used, r.is_partial) for r in outcome.collect()) == [("a", 2, False), ("b", 8, False)]
    assert outcome._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 16  # 29 when each field folded anew
    assert [r.chunk_id for r in kept.orderBy("rank").collect()] == ["a1", "b1", "b2"]
