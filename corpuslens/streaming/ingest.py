"""Ingestion as documents arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpuslens.plans.ingest import ingest, write_chunks
from corpuslens.sources.sections import text_sections


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of documents as they land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def latest_copies(batch: DataFrame) -> DataFrame:
    """One row per document of a batch: the last by ``arrived``."""
    return (
        batch.groupBy("project_id", "document_id")
        .agg(F.max_by(F.struct("document_name", "text"), "arrived").alias("_last"))
        .select("project_id", "document_id", "_last.document_name", "_last.text")
    )


def stream_ingest(
    documents: DataFrame,
    store: str,
    checkpoint: str,
    outcomes: str,
    available_now: bool = True,
    writer: str | None = None,
) -> StreamingQuery:
    """Chunk every arriving batch into its own store version.

    A version is named by the stream and the batch, so a batch that is replayed after a failure
    replaces its own rows and no other writer's; older versions of a document turn inactive when
    the store is read.  The stream's name is ``writer``, by default one for each checkpoint folder
    (a folder that was emptied needs a new name).  ``documents``: project_id, document_id,
    document_name, text, arrived."""
    name = writer or "stream-" + hashlib.md5(checkpoint.encode()).hexdigest()

    def absorb(batch: DataFrame, batch_id: int) -> None:
        latest = latest_copies(batch)
        sections, _ = text_sections(latest)
        done = ingest(
            latest, sections, version=batch_id + 1, single_section=True, tables=False
        )
        write_chunks(done.chunks.drop("embedding"), store, writer=name, version=batch_id + 1)
        (
            done.outcomes.withColumns({"writer": F.lit(name), "version": F.lit(batch_id + 1)})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("writer", "version")
            .parquet(outcomes)
        )

    writer = documents.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
