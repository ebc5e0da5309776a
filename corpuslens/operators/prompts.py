"""Cited prompts, answer routing and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Instruction texts, model names of local answers and the quote length.
SYSTEM = (
    "You are a project-scoped RAG assistant. Answer only from the provided "
    "knowledge base context. If the context is insufficient, say you cannot "
    "answer from the selected knowledge base. Cite sources by referring to "
    "the provided source numbers.\n\n"
)
FACETS = (
    "Answer every resolved facet separately and cite its mapped source numbers. Keep facts "
    "attached to the facet and source group that supports them."
)
NOT_COMPLETE = "Do not state or imply that the compound answer is complete."
PARTIAL = (
    "IMPORTANT: The selected table context is partial because it exceeded "
    "the context budget. Do not state or imply that the answer lists all "
    "rows or is complete. Explicitly tell the user that only part of the "
    "table is covered."
)
NO_ANSWER = (
    "I cannot answer this from the selected knowledge base. The retrieved "
    "documents do not contain enough relevant information."
)
CLARIFY_MODEL = "local-table-clarification"
REFUSE_MODEL = "local-refusal"
QUOTE_LENGTH = 240


def source_block() -> Column:
    """One numbered source as the model sees it."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]")),
        F.concat(F.lit("chunk_id: "), F.col("chunk_id")),
        F.concat(F.lit("document: "), F.col("document_name")),
        F.concat(F.lit("metadata: "), F.to_json("meta")),
        F.concat(F.lit("content: "), F.col("text")),
    )


def range_text(ranges: Column) -> Column:
    return F.array_join(
        F.transform(
            ranges,
            lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(
                F.concat_ws("-", r["first"], r["last"])
            ),
        ),
        ", ",
    )


def coverage_note(ranges: Column, total: Column) -> Column:
    """What part of a table is in the context, as a sentence with a leading blank, or nothing."""
    text = range_text(ranges)
    return (
        F.when(
            (text != "") & (F.coalesce(total, F.lit(0)) > 0),
            F.concat(
                F.lit(" The provided context covers data rows "), text, F.lit(" of "), total, F.lit(".")
            ),
        )
        .when(text != "", F.concat(F.lit(" The provided context covers data rows "), text, F.lit(".")))
        .otherwise("")
    )


def partial_note(coverage: DataFrame) -> DataFrame:
    """Per question with a cut single table: the warning that goes before its sources."""
    return coverage.where("is_partial").groupBy("query_id").agg(
        F.min(
            F.concat(
                F.lit(PARTIAL), coverage_note(F.col("row_ranges"), F.col("total_rows")), F.lit("\n\n")
            )
        ).alias("note")
    )


def facet_notes(outcomes: DataFrame, results: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per compound question: facet to source numbers, and which facets are cut.

    ``results``: query_id, rank, facet_indexes of the table each source came from."""
    sources = results.select("query_id", "rank", F.explode("facet_indexes").alias("facet_index"))
    mapped = sources.groupBy("query_id", "facet_index").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list("rank")),
                lambda rank: F.concat(F.lit("[Source "), rank.cast("string"), F.lit("]")),
            ),
            ", ",
        ).alias("sources")
    )
    line = F.concat(
        F.lit("Facet "), F.col("facet_index") + 1, F.lit(": "), F.col("facet_query"),
        F.lit("; sources: "), F.coalesce("sources", F.lit("")),
    )
    lines = outcomes.join(mapped, ["query_id", "facet_index"], "left").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("facet_index", line.alias("line")))).alias("lines")
    )
    rows = range_text(F.col("row_ranges"))
    rows_text = (
        F.when(
            (rows != "") & (F.coalesce("total_rows", F.lit(0)) > 0),
            F.concat(F.lit("provided rows "), rows, F.lit(" of "), F.col("total_rows"), F.lit(".")),
        )
        .when(rows != "", F.concat(F.lit("provided rows "), rows, F.lit(".")))
        .otherwise("no rows were retained.")
    )
    cuts = (
        coverage.where("is_partial")
        .withColumn("_rows", rows_text)
        .select("query_id", "_rows", F.array_min("facet_indexes").alias("_first"), F.explode("facet_indexes").alias("facet"))
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "_first",
                        "facet",
                        F.concat(
                            F.lit("Facet "), F.col("facet") + 1, F.lit(" is partial; "), F.col("_rows")
                        ).alias("line"),
                    )
                )
            ).alias("cuts")
        )
    )
    return lines.join(cuts, "query_id", "left").select(
        "query_id",
        F.concat(
            F.concat_ws(
                "\n",
                F.lit(FACETS),
                F.transform("lines", lambda l: l["line"]),
                F.transform("cuts", lambda c: c["line"]),
                F.when(F.col("cuts").isNotNull(), F.lit(NOT_COMPLETE)),
            ),
            F.lit("\n\n"),
        ).alias("note"),
    )


def build_prompts(
    questions: DataFrame,
    results: DataFrame,
    history: DataFrame | None = None,
    notes: DataFrame | None = None,
) -> DataFrame:
    """Chat messages per question: system text with numbered sources, history, question; a
    question without sources is to be refused.

    A question has at most its top-k or one context budget of sources, so its list is small."""
    blocks = results.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", source_block().alias("block")))),
                lambda b: b["block"],
            ),
            "\n\n",
        ).alias("_sources")
    )
    joined = questions.select("query_id", F.col("query").alias("_question")).join(
        blocks, "query_id", "left"
    )
    turns = F.array().cast("array<struct<role:string,content:string>>")
    note = F.lit("")
    if history is not None:
        joined = joined.join(history.select("query_id", "history"), "query_id", "left")
        turns = F.coalesce(F.col("history"), turns)
    if notes is not None:
        joined = joined.join(notes.select("query_id", "note"), "query_id", "left")
        note = F.coalesce(F.col("note"), F.lit(""))
    message = lambda role, content: F.struct(
        F.lit(role).alias("role"), content.alias("content")
    )
    system = F.concat(F.lit(SYSTEM), note, F.col("_sources"))
    messages = F.concat(
        F.array(message("system", system)), turns, F.array(message("user", F.col("_question")))
    )
    refuse = F.col("_sources").isNull()
    return joined.select(
        "query_id",
        refuse.alias("should_refuse"),
        F.when(refuse, F.slice(messages, 1, 0)).otherwise(messages).alias("messages"),
    )


def answer_route(prompts: DataFrame, plans: DataFrame, answers: DataFrame) -> DataFrame:
    """Where the answer of each question comes from, and what its message records.

    ``prompts``: query_id, should_refuse, the only columns that are read;
    ``plans``: query_id, facet_count, can_generate, requires_clarification, clarification (text);
    ``answers``: query_id, answer, model as returned by a model."""
    joined = prompts.join(plans, "query_id", "left").join(answers, "query_id", "left")
    compound = F.coalesce(F.col("facet_count"), F.lit(0)) > 1
    ask = F.coalesce("requires_clarification", F.lit(False))
    route = F.when(ask, "clarification").when(F.col("should_refuse"), "refusal").otherwise("generate")
    status = F.when(
        compound,
        F.when(ask, "clarification_required").when(F.col("can_generate"), "ready").otherwise("unresolved"),
    )
    return joined.withColumn("route", route).select(
        "query_id",
        "route",
        status.alias("plan_status"),
        F.when(F.col("route") == "clarification", F.col("clarification"))
        .when(F.col("route") == "refusal", F.lit(NO_ANSWER))
        .otherwise(F.col("answer"))
        .alias("answer"),
        F.when(F.col("route") == "clarification", F.lit(CLARIFY_MODEL))
        .when(F.col("route") == "refusal", F.lit(REFUSE_MODEL))
        .otherwise(F.col("model"))
        .alias("model"),
    )


def citations(cited: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations, violations).  ``cited``: project_id, message_id, rank, chunk_id; a chunk of
    another project is a violation."""
    stored = chunks.select("project_id", "chunk_id", F.substring("text", 1, QUOTE_LENGTH).alias("quote"), "meta")
    rows = cited.join(stored, ["project_id", "chunk_id"]).select(
        "project_id",
        "message_id",
        "chunk_id",
        F.col("rank").alias("citation_index"),
        "quote",
        F.col("meta").alias("citation_metadata"),
    )
    wrong = cited.join(stored, ["project_id", "chunk_id"], "left_anti").withColumn(
        "error_message", F.lit("Citation chunk must belong to the same project")
    )
    return rows, wrong
