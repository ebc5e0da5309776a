"""Retrieval logs: one row per query, one per ranked chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.joins import join_small

RESULT_PREVIEW = 300
DETAIL_PREVIEW = 500
LOGGED_SCORES = ("vector_score", "keyword_score", "fused_score")


EVIDENCE_POLICY = "protected_identifiers_then_rank"


def log_rows(
    queries: DataFrame, outcomes: DataFrame | None = None, coverage: DataFrame | None = None
) -> DataFrame:
    """One log row per query; the log takes the id of its query.

    ``queries``: settings, with the intent flags of ``retrieve_full`` and ``latency_ms`` where they
    are known; ``outcomes`` and ``coverage``: the table choices and expansions to record."""
    known = lambda name, kind: (F.col(name) if name in queries.columns else F.lit(None)).cast(kind)
    logged = queries
    for name, found, key in (("_selection", outcomes, "facet_index"), ("_expansion", coverage, "document_id")):
        if found is None:
            logged = logged.withColumn(name, F.lit(None).cast("string"))
            continue
        if key == "facet_index":
            item = F.struct(
                "facet_index", "status", "reason", F.col("selected.document_id").alias("document_id"),
                F.col("selected.table_index").alias("table_index"),
            )
        else:
            item = F.struct("document_id", "table_index", "row_ranges", "total_rows", "is_partial")
        listed = found.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias(name))
        logged = logged.join(listed, "query_id", "left")
    return logged.select(
        F.col("query_id").alias("retrieval_log_id"),
        "project_id",
        "query",
        "mode",
        "top_k",
        known("latency_ms", "int").alias("latency_ms"),
        F.struct(
            "vector_weight", "keyword_weight", "similarity_threshold", "reranker_enabled",
            F.when(F.col("reranker_enabled"), F.lit("keyword_overlap")).alias("reranker"),
            known("table_intent", "boolean").alias("table_intent"),
            known("is_full_table", "boolean").alias("full_table"),
            known("is_compound", "boolean").alias("compound"),
            F.col("_selection").alias("selection"),
            F.col("_expansion").alias("expansion"),
            F.lit(EVIDENCE_POLICY).alias("evidence_policy"),
        ).alias("retrieval_metadata"),
    )


def log_chunk_rows(results: DataFrame) -> DataFrame:
    return results.select(
        "project_id",
        F.col("query_id").alias("retrieval_log_id"),
        "chunk_id",
        "rank",
        *LOGGED_SCORES,
    )


def write_logs(
    queries: DataFrame, results: DataFrame, path: str, outcomes: DataFrame | None = None, coverage: DataFrame | None = None
) -> None:
    """Append both log tables."""
    rows = log_rows(queries, outcomes, coverage)
    rows.write.mode("append").partitionBy("project_id").parquet(f"{path}/logs")
    log_chunk_rows(results).write.mode("append").partitionBy("project_id").parquet(
        f"{path}/log_chunks"
    )


def result_view(results: DataFrame) -> DataFrame:
    """What a caller sees of a result: the text cut to a preview."""
    return results.withColumn("text_preview", F.substring("text", 1, RESULT_PREVIEW)).drop("text")


def log_detail(log_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Logged chunks with their document and a preview, inactive versions included.

    ``log_chunks`` is a stored table: it is measured, and texts are moved only where it is large."""
    stored = chunks.select(
        "project_id", "chunk_id", "document_id", "document_name", "chunk_index",
        F.substring("text", 1, DETAIL_PREVIEW).alias("text_preview"),
    )
    return join_small(stored, log_chunks, ["project_id", "chunk_id"]).orderBy("retrieval_log_id", "rank")
