"""Bounded evidence selection over candidate pools.

A pool holds at most ``fusion.MAX_POOL`` candidates per query, so per-query arrays are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.schema import PARENT_KINDS

EXACT_KIND, CONTAINED_KIND = "exact_identifier", "contained_identifier"


def evidence_kind() -> Column:
    return (
        F.when(F.coalesce(F.col("exact_identifiers"), F.lit(0)) > 0, EXACT_KIND)
        .when(F.coalesce(F.col("contained_identifiers"), F.lit(0)) > 0, CONTAINED_KIND)
    )


def _strength(kind: Column) -> Column:
    return F.when(kind == EXACT_KIND, 0).when(kind == CONTAINED_KIND, 1).otherwise(2)


def row_interval() -> Column:
    """(row, row) for a row chunk, the covered range for a parent, else null."""
    kind = F.col("meta.table_chunk_type")
    row, first, last = F.col("meta.data_row"), F.col("meta.data_row_start"), F.col("meta.data_row_end")
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    return F.when((kind == "table_row") & row.isNotNull(), pair(row, row)).when(
        kind.isin(*PARENT_KINDS) & first.isNotNull() & last.isNotNull(), pair(first, last)
    )


def structurally_overlaps(left: Column, right: Column) -> Column:
    """Two intervals of one table, each with ``is_parent``: equal rows, equal parents, or a
    parent around (or inside) the other."""
    same = (left["first"] == right["first"]) & (left["last"] == right["last"])
    around = (left["first"] <= right["first"]) & (left["last"] >= right["last"])
    inside = (right["first"] <= left["first"]) & (right["last"] >= left["last"])
    return F.when(left["is_parent"] == right["is_parent"], same).otherwise(around | inside)


def structural_dedup(candidates: DataFrame) -> DataFrame:
    """Keep, in (exact, contained, rank) order, each candidate that overlaps none kept before."""
    keyed = candidates.withColumn("_interval", row_interval())
    tabular = F.col("_interval").isNotNull() & F.col("meta.table_index").isNotNull()
    entries = (
        keyed.where(tabular)
        .groupBy("query_id", "document_id", F.col("meta.table_index").alias("table_index"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        _strength(evidence_kind()).alias("strength"),
                        F.col("rank"),
                        F.col("chunk_id"),
                        F.col("_interval.first").alias("first"),
                        F.col("_interval.last").alias("last"),
                        F.col("meta.table_chunk_type").isin(*PARENT_KINDS).alias("is_parent"),
                    )
                )
            ).alias("items")
        )
    )
    kept = entries.select(
        "query_id",
        F.explode(
            F.aggregate(
                "items",
                F.slice("items", 1, 0),
                lambda chosen, item: F.when(
                    F.exists(chosen, lambda other: structurally_overlaps(item, other)), chosen
                ).otherwise(F.concat(chosen, F.array(item))),
            )
        ).alias("item"),
    ).select("query_id", F.col("item.chunk_id").alias("chunk_id"), F.lit(True).alias("_kept"))
    return (
        keyed.join(kept, ["query_id", "chunk_id"], "left")
        .where(F.coalesce(~tabular, F.lit(True)) | F.col("_kept"))
        .drop("_interval", "_kept")
    )


def select_evidence(candidates: DataFrame, top_k: int | Column) -> DataFrame:
    """Protect the first candidate per document and identifier kind, fill by rank to ``top_k``,
    keep the original order."""
    limit = F.lit(top_k) if isinstance(top_k, int) else top_k
    pool = structural_dedup(candidates).withColumn("_kind", evidence_kind())
    per_group = Window.partitionBy("query_id", "document_id", "_kind").orderBy("rank")
    pool = pool.withColumn(
        "_first", F.col("_kind").isNotNull() & (F.row_number().over(per_group) == 1)
    )
    by_need = Window.partitionBy("query_id").orderBy(
        F.when(F.col("_first"), _strength(F.col("_kind"))).otherwise(2), F.col("rank")
    )
    chosen = pool.withColumn("_need", F.row_number().over(by_need)).where(F.col("_need") <= limit)
    final = Window.partitionBy("query_id").orderBy("rank")
    reason = F.when(F.col("_first"), F.concat(F.lit("protected_"), F.col("_kind")))
    return (
        chosen.withColumn("evidence_selection_reason", F.coalesce(reason, F.lit("ranked_fill")))
        .withColumn("rank", F.row_number().over(final))
        .drop("_kind", "_first", "_need")
    )
