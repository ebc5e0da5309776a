"""The given tables in the shape the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import chunking
from corpuslens.sources import sections as sc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by project (source)."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"),
        "text",
        "lang",
        "n_chars",
        "doc_id",
    )


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, as store rows."""
    found, _ = sc.text_sections(documents(spark, sf_dir))
    return chunking.as_store_rows(
        chunking.chunk_sections(found, single_section=True, tables=False)
    )


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their vectors; one in eleven has none.  Cut again by every pass that reads them."""
    return with_vectors(spark, sf_dir, text_chunks(spark, sf_dir))


def with_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Every chunk takes a vector by its document and number, but for one in eleven."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    document, number = F.col("document_id").cast("long"), F.col("chunk_index")
    wanted = F.when((document + 3 * number) % 11 > 0, (document + 7 * number) % F.lit(vectors.count()))
    return chunks.withColumn("vec_id", wanted).join(vectors, "vec_id", "left").drop("vec_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item: its whole text, asked of one of the projects."""
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding"
    )
    return items.join(vectors, "item_id", "left").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("project_id"),
        F.col("text").alias("query"),
        "embedding",
        "item_id",
    )
