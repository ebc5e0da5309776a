"""Weighted reciprocal-rank fusion, query validation and candidate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.functions.ordered import top_per_key
from corpuslens.operators.keyword import EVIDENCE
from corpuslens.operators.postings import CHUNK_KEYS
from corpuslens.schema import MODES, stable_order

# Defaults and accepted ranges of a request.
RRF_K = 60
VECTOR_WEIGHT = 0.65
KEYWORD_WEIGHT = 0.35
MAX_TOP_K = 50
MAX_RERANK = 200
# The widest pool any accepted request can ask for (hybrid, whole table): 3 * 5 * top_k.
MAX_POOL = 3 * 5 * MAX_TOP_K


def fuse_rrf(
    vector: DataFrame,
    keyword: DataFrame,
    top_k: int,
    vector_weight: float | Column = VECTOR_WEIGHT,
    keyword_weight: float | Column = KEYWORD_WEIGHT,
    k: int = RRF_K,
    queries: DataFrame | None = None,
    limit: Column | None = None,
) -> DataFrame:
    """Merge two routes by chunk: each contributes ``weight * (k + 1) / (k + rank)``.

    Weights and ``limit`` may be columns of ``queries``.  Route ranks are shared on equal scores;
    a chunk missing from a route has rank 0 there and contributes nothing.  Where ``queries``
    have a ``mode``, only hybrid ones are fused."""
    if k < 0:
        raise ValueError("rrf_k must be non-negative")
    keys = ["query_id", *CHUNK_KEYS]
    merged = vector.select(*keys, "vector_score").join(
        keyword.select(*keys, "keyword_score", *EVIDENCE), keys, "full_outer"
    )
    if queries is not None:
        given = {"_vw": vector_weight, "_kw": keyword_weight, "_cut": limit}
        columns = [
            (value if isinstance(value, Column) else F.lit(value)).alias(name)
            for name, value in given.items()
            if value is not None
        ]
        route = ["mode"] if "mode" in queries.columns else []
        merged = merged.join(queries.select("query_id", *route, *columns), "query_id")
        vw, kw = F.col("_vw"), F.col("_kw")
    else:
        vw, kw = F.lit(vector_weight), F.lit(keyword_weight)

    def route_rank(score: str) -> Column:
        order = Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last())
        return F.when(F.col(score).isNotNull(), F.rank().over(order)).otherwise(0)

    def share(weight: Column, rank: str) -> Column:
        scaled = weight * F.lit(k + 1) / (F.lit(k) + F.col(rank))
        return F.when(F.col(rank) > 0, scaled).otherwise(F.lit(0.0))

    fused = (
        merged.withColumn("vector_rank", route_rank("vector_score"))
        .withColumn("keyword_rank", route_rank("keyword_score"))
        .withColumn("vector_rrf_score", share(vw, "vector_rank"))
        .withColumn("keyword_rrf_score", share(kw, "keyword_rank"))
        .withColumn("fused_score", F.col("vector_rrf_score") + F.col("keyword_rrf_score"))
    )
    if "mode" in fused.columns:
        # A query with a single route is scored by that route alone.
        fused = fused.withColumn(
            "fused_score",
            F.when(F.col("mode") == "hybrid", F.col("fused_score")).otherwise(
                F.coalesce("vector_score", "keyword_score")
            ),
        )
    details = score_details(k, F.col("mode") if "mode" in fused.columns else None)
    ranked = top_per_key(
        fused, ["query_id"], [F.col("fused_score").desc(), *stable_order()], top_k, "rank"
    )
    if queries is not None and limit is not None:
        ranked = ranked.where(F.col("rank") <= F.col("_cut"))
    return ranked.withColumns(details).drop("_vw", "_kw", "_cut")


def score_details(k: int, mode: Column | None = None) -> dict[str, Column]:
    """Keyword evidence with zeros where the keyword route has nothing, and how it was fused."""
    details = {name: F.coalesce(F.col(name), F.lit(0)) for name in EVIDENCE}
    details["fusion_method"] = F.lit("weighted_rrf") if mode is None else F.when(mode == "hybrid", "weighted_rrf").otherwise(mode)
    details["fusion_rrf_k"] = F.lit(k)
    return details


def pool_limit(mode: Column, top_k: Column, full_table: Column, initial: Column) -> Column:
    """How many candidates a route keeps before selection."""
    wide = F.when(full_table, F.greatest(top_k * 5, F.lit(40))).otherwise(initial)
    floor = F.greatest(top_k * 3, F.lit(20))
    return (
        F.when(mode == "keyword", F.greatest(wide, floor))
        .when(mode == "vector", wide)
        .when(full_table, F.greatest(wide * 3, F.lit(60)))
        .otherwise(F.greatest(floor, wide))
    ).cast("int")


def initial_limit(top_k: Column, rerank: Column, rerank_limit: Column) -> Column:
    return F.when(rerank, F.greatest(top_k, rerank_limit)).otherwise(top_k)


REQUEST_DEFAULTS = {
    "mode": "hybrid",
    "top_k": 8,
    "vector_weight": VECTOR_WEIGHT,
    "keyword_weight": KEYWORD_WEIGHT,
    "similarity_threshold": 0.0,
    "reranker_enabled": False,
    "reranker_candidate_limit": 40,
}


def with_request_defaults(queries: DataFrame) -> DataFrame:
    """Add every missing request setting."""
    for name, value in REQUEST_DEFAULTS.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(value))
    return queries


def validate_queries(queries: DataFrame) -> DataFrame:
    """Trim the query and add ``reject_reason`` (null when accepted)."""
    full = with_request_defaults(queries).withColumn("query", tx.strip(F.col("query")))
    between = lambda name, low, high: F.col(name).between(low, high)
    reason = (
        F.when(F.coalesce(F.col("query"), F.lit("")) == "", "query must not be empty")
        .when(F.coalesce(~F.col("mode").isin(*MODES), F.lit(True)), "mode is unknown")
        .when(~between("top_k", 1, MAX_TOP_K), "top_k is out of range")
        .when(~between("vector_weight", 0, 1), "vector_weight is out of range")
        .when(~between("keyword_weight", 0, 1), "keyword_weight is out of range")
        .when(~between("similarity_threshold", -1, 1), "similarity_threshold is out of range")
        .when(
            ~between("reranker_candidate_limit", 1, MAX_RERANK),
            "reranker_candidate_limit is out of range",
        )
        .when(
            (F.col("mode") == "hybrid")
            & (F.col("vector_weight") + F.col("keyword_weight") <= 0),
            "hybrid weights must not both be zero",
        )
    )
    return full.withColumn("reject_reason", reason)
