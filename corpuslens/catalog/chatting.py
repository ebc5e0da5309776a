"""Chat turns of all conversations at once: a question that fits two tables, and the reply that chooses one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.catalog import base
from corpuslens.catalog.registry import query, with_
from corpuslens.operators.prompts import NO_ANSWER
from corpuslens.plans.chat import chat_turns as answer_turns
from corpuslens.session import durable, released_shuffles

PROJECTS, BUDGET = 20, 4000

_SQL = (
    f"""placed AS (SELECT o_custkey % {PROJECTS} AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'east' ELSE 'west' END AS side, o_orderkey,
      o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority AS line FROM orders),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY p, side ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY p, side) AS n FROM placed),
    parts AS (SELECT p, side, CAST((r - 1) * 10 // n AS INTEGER) AS i, string_agg(line, ' ' ORDER BY r) AS text, min(r) AS first FROM numbered GROUP BY ALL),
    listed AS (SELECT p, side, list(struct_pack(used := 0::BIGINT, kept := CAST([] AS VARCHAR[]), words := len(list_filter(regexp_split_to_array('order list ' || text, '\\s+'), lambda x: x <> ''))::BIGINT,
      id := 'order_list_' || side || '_' || p || ':' || i) ORDER BY first) AS xs FROM parts GROUP BY p, side),
    fitted AS (SELECT p, side, list_reduce(list_concat([struct_pack(used := 0::BIGINT, kept := CAST([] AS VARCHAR[]), words := 0::BIGINT, id := '')], xs),
      lambda a, b: CASE WHEN a.used + b.words <= {BUDGET} THEN struct_pack(used := a.used + b.words, kept := list_append(a.kept, b.id), words := 0::BIGINT, id := '') ELSE a END) AS f FROM listed)""",
)


def _store(spark, sf_dir):
    """Two tables of orders per project, ten row groups each."""
    p = F.col("o_custkey") % PROJECTS
    side = F.when(F.col("o_orderkey") % 2 == 0, "east").otherwise("west")
    rows = base.table(spark, sf_dir, "orders").select(
        p.alias("p"), side.alias("side"), "o_orderkey",
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("line"),
    )
    whole = Window.partitionBy("p", "side")
    numbered = rows.withColumn("r", F.row_number().over(whole.orderBy("o_orderkey"))).withColumn("n", F.count(F.lit(1)).over(whole))
    part = F.floor((F.col("r") - 1) * 10 / F.col("n")).cast("int")
    groups = numbered.groupBy("p", "side", part.alias("i"), "n").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("r", "line")))["line"], " ").alias("text"),
        F.min("r").alias("first"), F.max("r").alias("last"),
    )
    name = F.concat(F.lit("order_list_"), "side", F.lit("_"), F.col("p").cast("string"))
    return groups.select(
        F.col("p").cast("string").alias("project_id"), name.alias("document_id"), F.concat(name, F.lit(".docx")).alias("document_name"),
        F.col("i").alias("chunk_index"), F.concat_ws(":", name, F.col("i").cast("string")).alias("chunk_id"), F.concat(F.lit("order list "), "text").alias("text"),
        schema.meta(
            table_chunk_type=F.lit("table_group"), table_index=F.lit(0), caption=F.lit("order list"), headers=F.array(F.lit("order"), F.lit("status")),
            data_row_start=F.col("first"), data_row_end=F.col("last"), total_rows=F.col("n"),
        ).alias("meta"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("is_active"),
    )


@query(
    "chat_turns",
    with_(
        *_SQL,
        f"""convs AS (SELECT DISTINCT conv_id AS c FROM conversations),
        steps AS (
          SELECT c, 1 AS step, 'clarification' AS route, 'I found multiple relevant tables. Please choose one:' || chr(10) || '1. order_list_east_' || (c % 20) || '.docx - order list - table 1'
            || chr(10) || '2. order_list_west_' || (c % 20) || '.docx - order list - table 1' AS answer, '' AS citations, CAST(0 AS INTEGER) AS citation_count FROM convs
          UNION ALL SELECT c, 2, CASE WHEN len(f.kept) = 0 THEN 'refusal' ELSE 'generate' END, CASE WHEN len(f.kept) = 0 THEN '{NO_ANSWER}' ELSE 'answer to ' || c END,
            array_to_string(f.kept, ','), CAST(len(f.kept) AS INTEGER)
          FROM convs JOIN fitted ON p = c % 20 AND side = CASE WHEN c % 2 = 0 THEN 'east' ELSE 'west' END)""",
        body="SELECT CAST(c AS VARCHAR) AS conversation_id, step, route, answer, citations, citation_count FROM steps",
    ),
)
def chat_turns(spark, sf_dir):
    """M1-M9 in a chain: every conversation asks for a table that two documents hold, is asked back, chooses by
    ordinal, and is answered with the rows that fit, or refused where no row group does; citations and request
    metrics come with it."""
    given = base.table(spark, sf_dir, "conversations")
    project = (F.col("conv_id") % PROJECTS).cast("string")
    conversation = F.col("conv_id").cast("string")
    messages = given.select(
        project.alias("project_id"), conversation.alias("conversation_id"), F.col("turn").cast("string").alias("message_id"),
        F.col("turn").alias("created_at"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("metadata"),
    )
    latest = given.groupBy("conv_id").agg(F.max_by("text", "turn").alias("said"), F.max("turn").alias("turn"))
    turns = latest.select(
        conversation.alias("query_id"), project.alias("project_id"), conversation.alias("conversation_id"),
        F.concat(F.lit("list all the rows of the order list, "), "said").alias("question"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit("keyword").alias("mode"),
    )
    answers = latest.select(conversation.alias("query_id"), F.concat(F.lit("answer to "), conversation).alias("answer"), F.lit("m").alias("model"), F.lit(7).alias("latency_ms"))
    with released_shuffles(spark):
        store = durable(_store(spark, sf_dir))
        first = answer_turns(turns, messages, store, answers, budget=BUDGET)
        asked = durable(first.answers)
        reply = latest.select(conversation.alias("query_id"), F.when(F.col("conv_id") % 2 == 0, "first").otherwise("option 2").alias("question"))
        after = messages.unionByName(
            asked.join(latest.select(conversation.alias("query_id"), project.alias("project_id"), "turn"), "query_id").select(
                "project_id", F.col("query_id").alias("conversation_id"), F.lit("asked").alias("message_id"), (F.col("turn") + 1).alias("created_at"),
                F.lit("assistant").alias("role"), F.col("answer").alias("content"), "metadata",
            )
        )
        second = answer_turns(turns.drop("question").join(reply, "query_id"), after, store, answers, budget=BUDGET)

    def rows(done, step):
        cited = done.citations.groupBy(F.col("message_id").alias("query_id")).agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("citation_index", "chunk_id")))["chunk_id"], ",").alias("citations")
        )
        counted = done.requests.select(F.col("request_id").alias("query_id"), "citation_count")
        return done.answers.join(cited, "query_id", "left").join(counted, "query_id").select(
            F.col("query_id").alias("conversation_id"), F.lit(step).alias("step"), "route", "answer",
            F.coalesce("citations", F.lit("")).alias("citations"), "citation_count",
        )

    return rows(first, 1).unionByName(rows(second, 2))
