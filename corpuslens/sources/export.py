"""Exports of evaluation runs and comparisons, as tables and as CSV or JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exported metrics, result columns and row labels.
RUN_METRICS = (
    "hit_rate", "citation_coverage_rate", "answer_match_rate", "judge_match_rate",
    "avg_retrieval_latency_ms",
)
RESULT_COLUMNS = (
    "question_id", "question", "answer", "score", "hit", "citation_covered", "answer_matched",
    "refused", "retrieval_latency_ms", "generation_latency_ms", "retrieval_log_id",
    "judge_enabled", "judge_passed", "judge_score", "judge_reason", "judge_error",
)
COMPARE_METRICS = {
    "hit_rate": "Hit rate",
    "citation_coverage_rate": "Citation",
    "answer_match_rate": "Answer match",
    "judge_match_rate": "Judge",
    "avg_retrieval_latency_ms": "Avg retrieval",
    "avg_generation_latency_ms": "Avg generation",
}
QUESTION_ROWS = ("outcome", "score", "hit", "citation")


def export_run_metrics(runs: DataFrame) -> DataFrame:
    """Run metrics as long rows."""
    pairs = ", ".join(f"'{name}', {name}" for name in RUN_METRICS)
    return runs.selectExpr(
        "'run' as section", "run_id", "retrieval_mode", "top_k", "status", "created_at",
        f"stack({len(RUN_METRICS)}, {pairs}) as (metric, value)",
    )


def export_results(results: DataFrame) -> DataFrame:
    """One row per result with judge fields; columns a run does not have are empty."""
    return results.select(
        "run_id",
        *[
            F.col(name) if name in results.columns else F.lit(None).cast("string").alias(name)
            for name in RESULT_COLUMNS
        ],
    )


def export_run_json(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One JSON line per run and per result; a result line names its run, so no run is ever
    gathered into a single value."""
    head = runs.select("run_id", F.lit(0).alias("part"), F.to_json(F.struct(F.struct(*runs.columns).alias("run"))).alias("json"))
    body = results.select(
        "run_id", F.lit(1).alias("part"), F.to_json(F.struct(F.struct(*results.columns).alias("result"))).alias("json")
    )
    return head.unionByName(body)


def export_compare_metrics(compared: DataFrame, run_ids: list[str]) -> DataFrame:
    """Metric rows against run columns."""
    pairs = ", ".join(f"'{label}', {name}" for name, label in COMPARE_METRICS.items())
    long = compared.selectExpr(
        "run_id", f"stack({len(COMPARE_METRICS)}, {pairs}) as (metric, value)"
    )
    return long.groupBy("metric").pivot("run_id", run_ids).agg(F.first("value"))


def export_compare_questions(matrix: DataFrame, run_ids: list[str]) -> DataFrame:
    """Four rows per question (outcome, score, hit, citation) against run columns."""
    text = {
        "outcome": F.col("outcome"),
        "score": F.col("score").cast("string"),
        "hit": F.col("hit").cast("string"),
        "citation": F.col("citation_covered").cast("string"),
    }
    rows = F.array(
        *[
            F.struct(F.lit(at).alias("at"), F.lit(name).alias("row"), text[name].alias("value"))
            for at, name in enumerate(QUESTION_ROWS)
        ]
    )
    long = matrix.select(
        "question_id", "question", "seen_run", "seen_position", "run_id", F.explode(rows).alias("r")
    ).select("question_id", "question", "seen_run", "seen_position", "run_id", "r.*")
    wide = long.groupBy("seen_run", "seen_position", "question_id", "question", "at", "row").pivot(
        "run_id", run_ids
    ).agg(F.first("value"))
    outcome = F.col("row") == "outcome"
    return wide.withColumn(
        "question_id",
        F.when(outcome, F.col("question_id")).otherwise(F.concat_ws(":", "question_id", "row")),
    ).withColumn("question", F.when(outcome, F.col("question")).otherwise(F.col("row"))).drop("row")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes; empty cells for nulls."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).option("nullValue", "").option("emptyValue", "").csv(path)
