"""An evaluation run: all questions of a dataset in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import evaluation as ev
from corpuslens.operators.postings import Index
from corpuslens.operators.prompts import NO_ANSWER
from corpuslens.plans.retrieval import retrieve_full
from corpuslens.session import durable

NO_QUESTIONS = "Eval dataset has no questions"


@dataclass(frozen=True)
class Evaluated:
    """results: one row per question; runs: status, error and metrics per run."""

    results: DataFrame
    runs: DataFrame


def score_run(
    questions: DataFrame,
    results: DataFrame,
    answers: DataFrame,
    run_id: str = "run",
    aliases: DataFrame | None = None,
    judge_enabled: bool = False,
) -> DataFrame:
    """One evaluated row per question, from retrieved chunks and given answers.

    ``questions``: question_id, question, expected_*, should_answer; ``answers``: question_id,
    answer, optional judge_raw_response and latencies.  A question without sources is refused
    locally, and every source of an answered one is cited."""
    sources = results.select("question_id", "chunk_id", "document_id")
    judged = ev.hits_and_citations(questions, sources, sources)
    given = answers
    for name, kind in (
        ("judge_raw_response", "string"),
        ("retrieval_latency_ms", "int"),
        ("generation_latency_ms", "int"),
    ):
        if name not in given.columns:
            given = given.withColumn(name, F.lit(None).cast(kind))
    answered = sources.select("question_id").distinct().withColumn("_found", F.lit(True))
    rows = (
        judged.join(given, "question_id", "left")
        .join(answered, "question_id", "left")
        .withColumn(
            "answer", F.when(F.col("_found").isNull(), F.lit(NO_ANSWER)).otherwise(F.col("answer"))
        )
        .withColumn("refused", ev.is_refusal(F.col("answer")))
        .withColumn("judge_enabled", F.lit(judge_enabled))
        .withColumn("expected_notes", F.col("expected_answer_notes"))
    )
    if not judge_enabled:
        rows = rows.withColumn("judge_raw_response", F.lit(None).cast("string"))
    matched = ev.match_answers(ev.parse_verdicts(rows), "question_id", aliases)
    return (
        ev.question_scores(matched)
        .withColumn("run_id", F.lit(run_id))
        .drop("_found", "expected_notes", "notes_matched")
    )


def run_eval(
    questions: DataFrame,
    chunks: DataFrame,
    answers: DataFrame,
    run_id: str = "run",
    index: Index | None = None,
    aliases: DataFrame | None = None,
    judge_enabled: bool = False,
) -> Evaluated:
    """Retrieve for every question, then score its given answer.

    ``questions`` carry retrieval settings and embedding beside the expectations.  A question
    that has sources but no answer means the model failed, and with it the run."""
    if questions.limit(1).count() == 0:
        raise ValueError(NO_QUESTIONS)
    asked = questions.withColumnRenamed("question_id", "query_id").withColumnRenamed("question", "query")
    found = durable(
        retrieve_full(asked, chunks, index).ranked.select(
            F.col("query_id").alias("question_id"), "chunk_id", "document_id", "rank"
        )
    )
    results = durable(score_run(questions, found, answers, run_id, aliases, judge_enabled))
    unanswered = F.count_if(F.col("answer").isNull())
    state = results.groupBy("run_id").agg(
        F.when(unanswered > 0, "failed").otherwise("completed").alias("status"),
        F.when(unanswered > 0, "Chat model returned no answer").alias("error_message"),
    )
    rates = ev.run_metrics(results)
    failed = F.col("status") == "failed"  # a failed run has no metrics
    metrics = [
        F.col(n) if n == "question_count" else F.when(~failed, F.col(n)).alias(n)
        for n in rates.columns
        if n != "run_id"
    ]
    return Evaluated(results, state.join(rates, "run_id").select(*state.columns, *metrics))
