"""A turn of every conversation at once: history, pending choice, retrieval, prompt, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import conversations as cv
from corpuslens.operators import prompts as pr
from corpuslens.operators import tables as tb
from corpuslens.operators.postings import Index
from corpuslens.plans.retrieval import Retrieved, retrieve_full, with_texts
from corpuslens.session import durable

TIMES = ("latency_ms", "retrieval_latency_ms", "generation_latency_ms")


@dataclass(frozen=True)
class Answered:
    """answers: route, text, model and message metadata per turn; citations and violations of the
    answered ones; requests: one metrics row per turn; prompts: what the model was asked, of turns that
    are not asked back; found: the retrieval behind it."""

    answers: DataFrame
    citations: DataFrame
    violations: DataFrame
    requests: DataFrame
    prompts: DataFrame
    found: Retrieved


def confirmed_tables(resolved: DataFrame) -> DataFrame:
    """(query_id, facet_index, document_id, table_index): tables a compound plan had confirmed
    before, and the one this reply chooses for the waiting facet."""
    plan = resolved.where("pending_kind = 'compound' and is_valid and chosen is not null")
    before = (
        plan.select("query_id", "pending_facet_index", F.explode("preferred_tables_by_facet").alias("key", "table"))
        .withColumn("facet_index", F.col("key").cast("int"))
        .where("facet_index <> pending_facet_index")
        .select("query_id", "facet_index", "table.document_id", "table.table_index")
    )
    now = plan.select(
        "query_id", F.col("pending_facet_index").alias("facet_index"), "chosen.document_id", "chosen.table_index"
    )
    return before.unionByName(now)


def resolve_turns(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """Turns with what their conversation still asks and what the reply means by it."""
    pending = cv.validate_pending(cv.pending_clarification(messages))
    asked = turns.withColumn("message", F.col("question")).join(pending, list(cv.CONVERSATION), "left")
    return cv.resolve_confirmation(asked)


def _clarifications(outcomes: DataFrame) -> DataFrame:
    """Per question that has to be asked back: the text, and the waiting facet's candidates."""
    plans = tb.plan_outcomes(outcomes)
    waiting = outcomes.select("query_id", "facet_index", "facet_query", F.col("candidates").alias("_all")).withColumnRenamed(
        "facet_index", "pending_facet_index"
    )
    shown = F.transform(
        "_all",
        lambda c: F.struct(
            c["document_id"].alias("document_id"), c["document_name"].alias("document_name"),
            c["table_index"].alias("table_index"), c["caption"].alias("caption"),
        ),
    )
    joined = plans.join(waiting, ["query_id", "pending_facet_index"], "left").withColumn("candidates", shown)
    asked, listed = F.col("facet_query"), F.col("candidates")
    text = F.when(
        F.col("facet_count") > 1, cv.clarification_text(asked, listed, facet=True)
    ).otherwise(cv.clarification_text(asked, listed))
    return joined.withColumn("clarification", F.when(F.col("requires_clarification"), text)).drop("_all", "facet_query")


def _metadata(answers: DataFrame, plans: DataFrame, chosen: DataFrame) -> DataFrame:
    """The message metadata the next turn reads: the plan of a compound question or the choice of
    a single one, as JSON."""
    tables = chosen.groupBy("query_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.col("facet_index").cast("string"),
                    F.struct(F.col("selected.document_id").alias("document_id"), F.col("selected.table_index").alias("table_index")),
                )
            )
        ).alias("tables")
    )
    ask = F.col("route") == "clarification"
    compound = F.col("facet_count") > 1
    plan = F.struct(
        F.col("plan_status").alias("status"), F.col("query").alias("original_query"), "pending_facet_index",
        F.col("tables").alias("preferred_tables_by_facet"), F.when(ask, F.col("candidates")).alias("candidates"),
    )
    single = F.struct(
        F.when(ask, "ambiguous").when(F.col("can_generate"), "selected").otherwise("none").alias("status"),
        F.when(ask, F.col("candidates")).alias("candidates"),
    )
    body = F.to_json(
        F.struct(
            F.when(compound, plan).alias("table_query_plan"),
            F.when(~compound, single).alias("table_selection"),
        )
    )
    return (
        answers.join(plans, "query_id", "left").join(tables, "query_id", "left")
        .withColumn("metadata", F.when(F.col("facet_count").isNotNull(), body))
        .select(*answers.columns, "metadata")
    )


def chat_turns(
    turns: DataFrame,
    messages: DataFrame,
    chunks: DataFrame,
    answers: DataFrame,
    *,
    index: Index | None = None,
    facet_vectors: DataFrame | None = None,
    budget: int = tb.CONTEXT_BUDGET,
    history: int = cv.HISTORY,
) -> Answered:
    """Answer one turn per row of ``turns``: query_id, project_id, conversation_id, question,
    embedding and optional retrieval settings.

    ``messages``: the conversations so far; ``answers``: query_id, answer, model and optional
    latencies, as a model returned them.  A turn is asked back where a table is ambiguous, refused
    where nothing was found, and else answered; invalid requests are in ``found.rejected``."""
    resolved = durable(resolve_turns(turns, messages))
    single = F.col("chosen").isNotNull() & ~((F.col("pending_kind") == "compound") & F.col("is_valid"))
    settings = [c for c in turns.columns if c not in ("conversation_id", "question", "created_at")]
    queries = resolved.select(
        *settings,
        F.col("effective_question").alias("query"),
        F.when(single, F.col("chosen.document_id")).alias("preferred_document_id"),
        F.when(single, F.col("chosen.table_index")).alias("preferred_table_index"),
    )
    found = retrieve_full(queries, chunks, index, facet_vectors, confirmed_tables(resolved), budget)
    results = found.ranked  # without texts: a chunk is found by many turns
    plans = durable(_clarifications(found.outcomes))
    # A turn that is asked back never reaches the model: no texts are gathered for it.
    back = plans.where("requires_clarification").select("query_id")
    said = cv.recent_history(messages, history).join(
        turns.select("query_id", *cv.CONVERSATION), list(cv.CONVERSATION)
    ).select("query_id", "history")
    compound = found.queries.where("is_compound").select("query_id")
    sources = results.where("expanded and is_compound").select("query_id", "document_id", "rank").join(
        found.coverage.select("query_id", "document_id", "facet_indexes"), ["query_id", "document_id"]
    )
    notes = pr.facet_notes(
        found.outcomes.join(compound, "query_id", "left_semi"), sources,
        found.coverage.join(compound, "query_id", "left_semi"),
    ).unionByName(pr.partial_note(found.coverage.join(compound, "query_id", "left_anti")))
    shown = with_texts(results.join(back, "query_id", "left_anti"), chunks)
    prompts = durable(pr.build_prompts(found.queries.join(back, "query_id", "left_anti"), shown, said, notes))
    sourced = results.select("query_id").distinct().withColumn("_sourced", F.lit(True))
    states = found.queries.select("query_id").join(sourced, "query_id", "left").select(
        "query_id", F.col("_sourced").isNull().alias("should_refuse")
    )
    routed = pr.answer_route(states, plans, answers.select("query_id", "answer", "model"))
    asked = found.queries.select("query_id", "query")
    chosen = found.outcomes.where("selected is not null")
    answered = durable(_metadata(routed, plans.join(asked, "query_id"), chosen))

    cited = results.join(answered.where("route = 'generate'").select("query_id"), "query_id").select(
        "project_id", F.col("query_id").alias("message_id"), "rank", "chunk_id"
    )
    citations, violations = pr.citations(cited, chunks)
    counted = citations.groupBy(F.col("message_id").alias("query_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    timed = answers.select("query_id", *[c for c in TIMES if c in answers.columns])
    requests = (
        answered.join(turns.select("query_id", "project_id"), "query_id")
        .join(timed, "query_id", "left")
        .join(counted, "query_id", "left")
        .select(
            F.col("query_id").alias("request_id"), "project_id", "model",
            *[(F.col(c) if c in timed.columns else F.lit(None).cast("int")).alias(c) for c in TIMES],
            F.coalesce("n", F.lit(0)).alias("citation_count"),
        )
    )
    return Answered(answered, citations, violations, requests, prompts, found)
