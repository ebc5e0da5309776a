"""Reranking of candidate pools by a score expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx

NAME = "keyword_overlap"


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text contains."""
    wanted = F.array_distinct(tx.find_all(F.lower(query), "[a-zA-Z0-9]+"))
    present = tx.find_all(F.lower(text), "[a-zA-Z0-9]+")
    shared = F.size(F.array_intersect(wanted, present)).cast("double")
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(shared / F.size(wanted))


def rerank(
    candidates: DataFrame,
    limit: int | Column | None = None,
    score_fn: Callable[[Column, Column], Column] = overlap_score,
    name: str = NAME,
    enabled: Column | None = None,
) -> DataFrame:
    """Reorder each query's pool by (score, fused score, earlier rank).

    ``candidates`` carry ``query`` and ``text``; ``score_fn`` is any column expression.  Pools
    for which ``enabled`` is false keep their order."""
    on = F.lit(True) if enabled is None else enabled
    scored = (
        candidates.withColumn("reranker", F.when(on, F.lit(name)))
        .withColumn("reranker_score", F.when(on, score_fn(F.col("query"), F.col("text"))))
        .withColumn("pre_rerank_rank", F.when(on, F.col("rank")))
        .withColumn("pre_rerank_fused_score", F.when(on, F.col("fused_score")))
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("reranker_score").desc_nulls_last(),
        F.col("pre_rerank_fused_score").desc_nulls_last(),
        F.col("rank"),
    )
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
