from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from support import table_cells

from corpuslens.operators import chunking, grids
from corpuslens.operators.prompts import NO_ANSWER
from corpuslens.plans.chat import chat_turns
from corpuslens.session import durable
from corpuslens.sources.sections import number_blocks

MESSAGES = "project_id string, conversation_id string, message_id string, created_at int, role string, content string, metadata string"
TURNS = "query_id string, project_id string, conversation_id string, question string, embedding array<float>, mode string"


@pytest.fixture(scope="module")
def store(spark):
    def table(first):
        return [[("Server list", 2, None, None)], (["Name", "Role"], True), [f"{first}1", "front end"], [f"{first}2", "store"]]

    cells = table_cells(spark, {"server_list_east": table("web"), "server_list_west": table("app")})
    chunks = chunking.as_store_rows(chunking.chunk_sections(number_blocks(grids.table_blocks(cells)), 16, 2))
    return durable(chunks.withColumn("embedding", F.lit(None).cast("array<float>")))


def turn(spark, store, messages, **asked):
    rows = [(q, "p", q, text, None, "keyword") for q, text in asked.items()]
    answers = spark.createDataFrame([(q, "it is so", "m", 5) for q in asked], "query_id string, answer string, model string, latency_ms int")
    done = chat_turns(
        spark.createDataFrame(rows, TURNS), spark.createDataFrame(messages, MESSAGES), store, answers
    )
    return done, {r.query_id: r for r in done.answers.collect()}


def test_ask_back_then_resume(spark, store):
    hello = ("p", "c", "m0", 0, "user", "hello", None)
    done, got = turn(spark, store, [hello], c="show the server list", none="zebra")
    assert (got["none"].route, got["none"].answer) == ("refusal", NO_ANSWER)
    assert got["c"].route == "clarification" and "server_list_east" in got["c"].answer
    said = json.loads(got["c"].metadata)["table_selection"]
    assert said["status"] == "ambiguous" and len(said["candidates"]) == 2
    assert {r.request_id: (r.citation_count, r.latency_ms) for r in done.requests.collect()} == {"c": (0, 5), "none": (0, 5)}

    messages = [hello, ("p", "c", "m1", 1, "assistant", got["c"].answer, got["c"].metadata)]
    done, got = turn(spark, store, messages, c="second")
    assert got["c"].route == "generate" and got["c"].answer == "it is so"
    wanted = said["candidates"][1]["document_id"]
    assert {r.document_id for r in done.found.results.collect()} == {wanted}
    prompt = done.prompts.first().messages
    assert [m.role for m in prompt] == ["system", "user", "assistant", "user"] and prompt[1].content == "hello"
    cited = done.citations.collect()
    assert cited and {r.message_id for r in cited} == {"c"}
    assert done.requests.first().citation_count == len(cited) and done.violations.count() == 0


def test_compound_choice_keeps_earlier_ones(spark, store):
    plan = {
        "table_query_plan": {
            "status": "clarification_required", "original_query": "show the server list and list all rows of the server list",
            "pending_facet_index": 1, "preferred_tables_by_facet": {"0": {"document_id": "server_list_west", "table_index": 0}},
            "candidates": [{"document_id": "server_list_east", "document_name": "server_list_east.docx", "table_index": 0, "caption": "Server list"}],
        }
    }
    broken = json.loads(json.dumps(plan))
    broken["table_query_plan"]["pending_facet_index"] = 7
    messages = [("p", c, "m", 1, "assistant", "?", json.dumps(m)) for c, m in (("good", plan), ("bad", broken))]
    done, _ = turn(spark, store, messages, good="first", bad="first")
    picked = {(r.query_id, r.facet_index): r.selected.document_id for r in done.found.outcomes.collect() if r.selected}
    assert picked == {("good", 0): "server_list_west", ("good", 1): "server_list_east", ("bad", 0): "server_list_east"}
    assert {r.query_id: r.query for r in done.found.queries.collect()} == {"good": plan["table_query_plan"]["original_query"], "bad": "first"}


def test_invalid_requests_are_returned(spark, store):
    done, got = turn(spark, store, [("p", "x", "m", 0, "user", "a", None)], x="\t\n", y="show the server list")
    assert {r.query_id: r.reject_reason for r in done.found.rejected.collect()} == {"x": "query must not be empty"}
    assert set(got) == {"y"}


def test_chat_turns_equals_its_sql_where_no_row_group_fits(spark, tmp_path):
    """Project 0 has an eastern table whose row groups are all wider than the budget."""
    import __spark_entry__ as contract
    from check_oracles import compare, connect

    n = F.col("id")
    spark.range(30_400).select(
        n.alias("o_orderkey"), F.when(n < 30_000, 0).otherwise(1).cast("long").alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"), F.lit("5-LOW").alias("o_orderpriority"),
    ).coalesce(1).write.parquet(f"{tmp_path}/given")
    spark.createDataFrame([(c, 0, "user", "Hello there.") for c in (0, 1)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/said")
    for name, folder in (("orders", "given"), ("conversations", "said")):
        next((tmp_path / folder).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = contract.queries()["chat_turns"](spark, str(tmp_path))
    assert {(r.conversation_id, r.route) for r in got.collect() if r.step == 2} == {("0", "refusal"), ("1", "generate")}
    assert compare(got, connect(str(tmp_path)), contract.oracle_sql()["chat_turns"]) is None


def test_texts_are_gathered_only_for_turns_that_reach_the_model(spark, store, monkeypatch):
    """Twenty turns find the same chunks: no cut of the retrieval copies a text, and a turn that is asked back has no prompt."""
    from corpuslens.plans import chat, retrieval

    cuts = []
    for module in (chat, retrieval):
        monkeypatch.setattr(module, "durable", lambda df: cuts.append(df) or durable(df))
    asked = {f"c{i}": "show the server list" for i in range(20)} | {"row": "which role has web1", "none": "zebra"}
    done, got = turn(spark, store, [("p", "c0", "m0", 0, "user", "hello", None)], **asked)
    assert {got[f"c{i}"].route for i in range(20)} == {"clarification"}
    assert (got["row"].route, got["none"].route) == ("generate", "refusal")
    assert cuts and not any("text" in df.columns for df in cuts)
    prompts = {r.query_id: r for r in done.prompts.collect()}
    assert set(prompts) == {"row", "none"} and prompts["none"].should_refuse and not prompts["none"].messages
    system = prompts["row"].messages[0].content
    results = [r for r in done.found.results.collect() if r.query_id == "row"]
    assert results and all(r.text and r.text in system for r in results)
    assert "text" not in done.found.ranked.columns and done.found.ranked.count() == done.found.results.count()


def test_reranking_reads_texts_only_where_it_is_asked_for(spark, store):
    from corpuslens.plans.retrieval import retrieve_full

    rows = [(q, "p", "which role has web1 store", None, "keyword", q == "on") for q in ("on", "off")]
    found = retrieve_full(
        spark.createDataFrame(rows, "query_id string, project_id string, query string, embedding array<float>, mode string, reranker_enabled boolean"), store
    )
    got = {q: sorted(((r.rank, r.reranker_score, r.text) for r in found.results.collect() if r.query_id == q)) for q in ("on", "off")}
    assert got["on"] and all(score is not None for _, score, _ in got["on"]) and all(score is None for _, score, _ in got["off"])
    words = {"which", "role", "has", "web1", "store"}
    for _, score, text in got["on"]:
        have = set("".join(c if c.isalnum() else " " for c in text.lower()).split())
        assert score == pytest.approx(len(words & have) / len(words))
