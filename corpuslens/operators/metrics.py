"""Request and corpus metrics; listings of projects and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.functions.ordered import top_per_key

MAX_RECENT = 200
PENDING = ("uploaded", "processing")
NAME_COLLATION = "UNICODE_CI_AI"


def summary_columns() -> list[Column]:
    """Count and means; nulls are skipped."""
    return [
        F.count(F.lit(1)).alias("request_count"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg("retrieval_latency_ms").alias("avg_retrieval_latency_ms"),
        F.avg("generation_latency_ms").alias("avg_generation_latency_ms"),
        F.avg("citation_count").alias("avg_citation_count"),
    ]


def chat_summary(requests: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Per project; projects without requests appear with a zero count and null means."""
    summary = requests.groupBy("project_id").agg(*summary_columns())
    if projects is None:
        return summary
    return projects.select("project_id").join(summary, "project_id", "left").fillna(
        0, ["request_count"]
    )


def recent_requests(requests: DataFrame, limit: int = 50) -> DataFrame:
    """Newest requests per project, ``limit`` clamped to 1..200."""
    kept = min(max(limit, 1), MAX_RECENT)
    newest = [F.col("created_at").desc(), F.col("request_id")]
    return top_per_key(requests, ["project_id"], newest, kept, "position")


def duplicate_names(documents: DataFrame) -> DataFrame:
    """File names that occur more than once in a project."""
    return (
        documents.groupBy("project_id", "filename")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def corpus_summary(documents: DataFrame) -> DataFrame:
    """Per project counts.  Counting per name first leaves one row per name to sum, so neither
    distinct names nor duplicates need a second pass."""
    status = F.col("status")
    by_name = documents.groupBy("project_id", "filename").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(status == "indexed").alias("indexed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status.isin(*PENDING)).alias("pending"),
    )
    return by_name.groupBy("project_id").agg(
        F.sum("n").alias("total_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.sum("indexed").alias("indexed_count"),
        F.sum(F.col("n") - 1).alias("duplicate_count"),
        F.sum("failed").alias("failed_count"),
        F.sum("pending").alias("pending_count"),
    )


def natural_key(name: Column) -> Column:
    """Sort key: letters compared without case and accents, in the root order of Unicode, and runs of
    digits as numbers, which is their length and then their digits."""
    runs = tx.find_all(name, r"\d+|\D+")
    padded = F.transform(
        runs,
        lambda run: F.when(
            run.rlike(r"^\d"),
            F.concat(
                F.lpad(F.char_length(F.regexp_replace(run, "^0+(?=.)", "")).cast("string"), 6, "0"),
                F.regexp_replace(run, "^0+(?=.)", ""),
            ),
        ).otherwise(run),
    )
    return F.collate(F.array_join(padded, ""), NAME_COLLATION)


def natural_order(documents: DataFrame) -> DataFrame:
    """Documents as a person would list them: by natural name, then by age."""
    return documents.orderBy("project_id", natural_key(F.col("filename")), "created_at")


def list_documents(
    documents: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page per project, newest first; filter ``documents`` for the page of one project."""
    listed = documents if status is None else documents.where(F.col("status") == status)
    newest = [F.col("created_at").desc(), F.col("document_id")]
    return top_per_key(listed, ["project_id"], newest, offset + limit, "position").where(
        F.col("position") > offset
    )


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.col("updated_at").desc(), "project_id")


def check_project_names(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Added projects with a ``reject_reason`` where the name is taken, by an existing project or
    by an earlier one of the batch.

    ``added``: project_id, name, created_at."""
    taken = existing.select("name").distinct().withColumn("_taken", F.lit(True))
    first = added.groupBy("name").agg(
        F.min_by("project_id", F.struct("created_at", "project_id")).alias("_first")
    )
    clash = F.col("_taken").isNotNull() | (F.col("_first") != F.col("project_id"))
    return (
        added.join(taken, "name", "left")
        .join(first, "name")
        .withColumn("reject_reason", F.when(clash, F.lit("Project name already exists")))
        .drop("_taken", "_first")
    )
