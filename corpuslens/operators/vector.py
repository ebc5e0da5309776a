"""Vector retrieval: exact cosine top-k per query within its project.

Chunks and queries are packed into blocks that meet in an equi join on the project; each pair of
blocks is one matrix product from which only the best rows per query leave the task.  So a join
row stands for tens of thousands of comparisons, the vectors of a large project spread over as
many tasks as it has blocks, and nothing but per-block winners is shuffled for the final cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.joins import join_small, of_asked_projects
from corpuslens.functions.ordered import top_per_key
from corpuslens.functions.vectors import best_rows, unit_rows
from corpuslens.operators.keyword import with_scope
from corpuslens.schema import STABLE_KEYS, stable_order

CHUNK_BLOCK = 512
QUERY_BLOCK = 64
MAX_BROADCAST_BLOCKS = 256

_HITS = (
    "query_id string, project_id string, document_id string, document_name string, "
    "chunk_index int, chunk_id string, vector_score double"
)


def pack_queries(queries: DataFrame, limit: Column, threshold: Column) -> DataFrame:
    """Blocks of about ``QUERY_BLOCK`` queries per project and vector width."""
    base = queries.where(F.col("embedding").isNotNull()).select(
        "query_id",
        "project_id",
        "scope",
        F.col("embedding").cast("array<double>").alias("embedding"),
        limit.cast("int").alias("limit"),
        threshold.cast("double").alias("threshold"),
    )
    sizes = base.groupBy("project_id").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).alias("_blocks")
    )
    return (
        base.join(sizes, "project_id")
        .withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")))
        .groupBy("project_id", "_block")
        .agg(
            F.collect_list(
                F.struct("query_id", "scope", "embedding", "limit", "threshold")
            ).alias("asked")
        )
        .drop("_block")
    )


def pack_chunks(chunks: DataFrame) -> DataFrame:
    """Blocks of at most ``CHUNK_BLOCK`` embedded active chunks of one project, cut inside each
    task: no shuffle."""
    embedded = chunks.where(F.col("is_active") & F.col("embedding").isNotNull()).select(
        "project_id",
        *STABLE_KEYS,
        F.col("embedding").cast("array<float>").alias("embedding"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, rows in batch.groupby("project_id", sort=False):
                for at in range(0, len(rows), CHUNK_BLOCK):
                    part = rows.iloc[at : at + CHUNK_BLOCK]
                    yield pd.DataFrame(
                        {
                            "project_id": [project],
                            **{f"{key}s": [part[key].tolist()] for key in STABLE_KEYS},
                            "widths": [[len(v) for v in part["embedding"]]],
                            "vectors": [np.concatenate(part["embedding"].tolist())],
                        }
                    )

    return embedded.mapInPandas(
        pack,
        "project_id string, document_names array<string>, chunk_indexs array<int>, "
        "document_ids array<string>, chunk_ids array<string>, widths array<int>, "
        "vectors array<float>",
    )


def _score_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            keys = pd.DataFrame(
                {
                    "document_name": list(row.document_names),
                    "chunk_index": list(row.chunk_indexs),
                    "document_id": list(row.document_ids),
                    "chunk_id": list(row.chunk_ids),
                }
            )
            asked = list(row.asked)
            width = len(asked[0]["embedding"])
            if set(row.widths) != {width} or any(len(a["embedding"]) != width for a in asked):
                raise ValueError("vectors differ in length")
            # Rows in stable order, so that equal scores come out in stable order.
            order = keys.sort_values(list(STABLE_KEYS), kind="stable").index.to_numpy()
            keys = keys.iloc[order].reset_index(drop=True)
            block = np.asarray(row.vectors, dtype=np.float64).reshape(-1, width)[order]
            queries = np.array([a["embedding"] for a in asked], dtype=np.float64)
            scores = unit_rows(queries) @ unit_rows(block).T
            found = []
            for at, ask in enumerate(asked):
                mine = np.arange(len(keys))
                if ask["scope"]:
                    mine = np.flatnonzero((keys["document_id"] == ask["scope"]).to_numpy())
                    if not len(mine):
                        continue
                rows, exact = best_rows(
                    block[mine], queries[at], scores[at][mine], ask["threshold"], ask["limit"]
                )
                hit = keys.iloc[mine[rows]].copy()
                hit["query_id"], hit["project_id"] = ask["query_id"], row.project_id
                hit["vector_score"] = exact
                found.append(hit)
            if found:
                yield pd.concat(found)[
                    [
                        "query_id", "project_id", "document_id", "document_name", "chunk_index",
                        "chunk_id", "vector_score",
                    ]
                ]


def retrieve_vector(
    queries: DataFrame,
    chunks: DataFrame,
    top_k: int,
    threshold: float | Column = 0.0,
    limit: Column | None = None,
) -> DataFrame:
    """Top chunks per query by cosine at or above ``threshold``.

    ``queries``: query_id, project_id, embedding, optional document_id.  ``limit`` narrows the
    cut per query, up to ``top_k``."""
    cut = F.lit(top_k) if limit is None else F.least(limit, F.lit(top_k))
    floor = threshold if isinstance(threshold, Column) else F.lit(threshold)
    asked = pack_queries(with_scope(queries), cut, floor)
    packed = pack_chunks(of_asked_projects(chunks, queries))
    pairs = join_small(packed, asked, ["project_id"], max_rows=MAX_BROADCAST_BLOCKS)
    hits = pairs.mapInPandas(_score_blocks, _HITS)
    ranked = top_per_key(
        hits, ["query_id"], [F.col("vector_score").desc(), *stable_order()], top_k, "rank"
    )
    if limit is not None:
        limits = queries.select("query_id", limit.alias("_limit"))
        ranked = ranked.join(limits, "query_id").where(F.col("rank") <= F.col("_limit")).drop("_limit")
    return ranked


def check_embeddings(chunks: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """Left join vectors to chunks and mark, per document, whether every chunk got one of the
    right width.  ``vectors``: project_id, document_id, chunk_index, embedding."""
    joined = chunks.join(vectors, ["project_id", "document_id", "chunk_index"], "left")
    right = F.coalesce(F.size("embedding") == dimensions, F.lit(False))
    verdict = joined.groupBy("project_id", "document_id").agg(F.every(right).alias("embedded"))
    return joined.join(verdict, ["project_id", "document_id"])
