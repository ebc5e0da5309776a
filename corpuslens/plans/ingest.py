"""Documents to a chunk store: all or nothing per document, re-indexing, deletion, job state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.joins import join_small
from corpuslens.operators import chunking
from corpuslens.operators.vector import check_embeddings
from corpuslens.sources.sections import NO_TEXT

# Failure messages.
NO_CHUNKS = "Document contains no usable text chunks"
BAD_VECTORS = "Embedding response does not match the chunks"
WRONG_PAIR = "Document not found for project"

DOC = ("project_id", "document_id")


@dataclass(frozen=True)
class Ingested:
    """chunks: store rows of documents that succeeded; sections: their sections; outcomes: one
    row per document with ``status`` completed or failed and the reason."""

    chunks: DataFrame
    sections: DataFrame
    outcomes: DataFrame


def reject_empty_documents(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document, error_message): documents without sections, and sections without chunks."""
    with_sections = sections.select(*DOC).distinct()
    with_chunks = chunks.select(*DOC).distinct()
    silent = documents.select(*DOC).join(with_sections, [*DOC], "left_anti")
    blank = with_sections.join(with_chunks, [*DOC], "left_anti")
    return silent.withColumn("error_message", F.lit(NO_TEXT)).unionByName(
        blank.withColumn("error_message", F.lit(NO_CHUNKS))
    )


def attach_embeddings(
    chunks: DataFrame, vectors: DataFrame, dimensions: int
) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, failures): a document takes part only if every chunk of it has a
    vector of the right width."""
    checked = check_embeddings(chunks, vectors, dimensions)
    failed = checked.where(~F.col("embedded")).select(*DOC).distinct()
    return (
        checked.where("embedded").drop("embedded"),
        failed.withColumn("error_message", F.lit(BAD_VECTORS)),
    )


def link_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Add the id of the section each chunk came from."""
    ids = sections.select(*DOC, "section_index", section_id())
    return chunks.join(ids, [*DOC, "section_index"])


def section_id() -> Column:
    return F.concat_ws(":", "document_id", F.lit("s"), "section_index").alias("section_id")


def ingest(
    documents: DataFrame,
    sections: DataFrame,
    vectors: DataFrame | None = None,
    dimensions: int = 0,
    size: int = chunking.CHUNK_SIZE,
    overlap: int = chunking.CHUNK_OVERLAP,
    version: Column | int = 1,
    single_section: bool = False,
    tables: bool = True,
) -> Ingested:
    """Chunk, embed and judge every document of a batch.

    ``documents``: project_id, document_id; ``vectors``: project_id, document_id, chunk_index,
    embedding (omit to ingest without vectors)."""
    chunks = chunking.as_store_rows(
        chunking.chunk_sections(sections, size, overlap, single_section, tables), version
    )
    failures = reject_empty_documents(documents, sections, chunks)
    if vectors is None:
        stored = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    else:
        stored, unembedded = attach_embeddings(chunks, vectors, dimensions)
        failures = failures.unionByName(unembedded)
    outcomes = documents.select(*DOC).join(failures, [*DOC], "left").withColumn(
        "status", F.when(F.col("error_message").isNull(), "completed").otherwise("failed")
    )
    kept = sections.join(failures.select(*DOC), [*DOC], "left_anti")
    return Ingested(stored, kept, outcomes)


def reindex(existing: DataFrame, fresh: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Chunks after a batch: earlier chunks of documents that succeeded stay for old logs and
    citations but turn inactive; those of failed ones stay as they are; new ones are added."""
    done = outcomes.where("status = 'completed'").select(*DOC).withColumn("_done", F.lit(True))
    aged = existing.join(done, [*DOC], "left").withColumn(
        "is_active", F.col("is_active") & F.col("_done").isNull()
    ).drop("_done")
    return aged.unionByName(fresh, allowMissingColumns=True)


def document_status(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Document status after a batch: a failed re-index leaves an indexed document indexed."""
    result = outcomes.select(
        *DOC, F.col("status").alias("_result"), F.col("error_message").alias("_error")
    )
    status = (
        F.when(F.col("_result") == "completed", "indexed")
        .when((F.col("_result") == "failed") & (F.col("status") == "indexed"), "indexed")
        .when(F.col("_result") == "failed", "failed")
        .otherwise(F.col("status"))
    )
    return (
        documents.join(result, [*DOC], "left")
        .withColumn(
            "error_message",
            F.when((F.col("_result") == "failed") & (F.col("status") != "indexed"), F.col("_error")),
        )
        .withColumn("status", status)
        .drop("_result", "_error")
    )


def job_outcomes(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Latest state per job; jobs naming a document their project does not hold fail.

    ``events``: job_id, project_id, document_id, status, ts, error_message; ``documents``:
    project_id, document_id, status (before the jobs)."""
    latest = events.groupBy("job_id").agg(
        F.max_by(
            F.struct("project_id", "document_id", "status", "error_message"),
            F.struct("ts", F.array_position(F.array(*map(F.lit, _ORDER)), F.col("status"))),
        ).alias("last")
    )
    known = documents.select(*DOC, F.col("status").alias("document_status"))
    joined = latest.select("job_id", "last.*").join(known, [*DOC], "left")
    held = F.col("document_status").isNotNull()
    return joined.select(
        "job_id",
        *DOC,
        F.when(held, F.col("status")).otherwise("failed").alias("status"),
        F.when(held, F.col("error_message")).otherwise(F.lit(WRONG_PAIR)).alias("error_message"),
        F.when(~held, F.lit(None))
        .when(F.col("status") == "completed", "indexed")
        .when(F.col("status") == "running", "processing")
        .when((F.col("status") == "failed") & (F.col("document_status") != "indexed"), "failed")
        .otherwise(F.col("document_status"))
        .alias("document_status"),
    )


_ORDER = ("queued", "running", "completed", "failed")


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove documents everywhere: rows that name the document, rows that name its chunks, and
    expectations of evaluation questions, which become null."""
    doomed = gone.select(*DOC).distinct()
    out = {}
    chunks = tables.get("chunks")
    lost = None
    if chunks is not None:
        lost = chunks.join(doomed, [*DOC], "left_semi").select("project_id", "chunk_id")
    for name, df in tables.items():
        if "expected_document_id" in df.columns:
            marks = doomed.select(
                "project_id", F.col("document_id").alias("expected_document_id"), F.lit(True).alias("_d")
            )
            df = df.join(marks, ["project_id", "expected_document_id"], "left").withColumn(
                "expected_document_id", F.when(F.col("_d").isNull(), F.col("expected_document_id"))
            ).drop("_d")
            if lost is not None and "expected_chunk_id" in df.columns:
                holes = lost.select(
                    "project_id", F.col("chunk_id").alias("expected_chunk_id"), F.lit(True).alias("_c")
                )
                df = df.join(holes, ["project_id", "expected_chunk_id"], "left").withColumn(
                    "expected_chunk_id", F.when(F.col("_c").isNull(), F.col("expected_chunk_id"))
                ).drop("_c")
            out[name] = df
        elif "document_id" in df.columns:
            out[name] = df.join(doomed, [*DOC], "left_anti")
        elif "chunk_id" in df.columns and lost is not None:
            out[name] = df.join(lost, ["project_id", "chunk_id"], "left_anti")
        else:
            out[name] = df
    return out


def delete_projects(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove every row of the given projects from every table."""
    doomed = gone.select("project_id").distinct()
    return {name: df.join(doomed, "project_id", "left_anti") for name, df in tables.items()}


_LOG = "project_id string, document_id string, sequence long, writer string, version long"


def _log(spark: SparkSession, path: str) -> DataFrame:
    """Which version of which writer holds a document, and when in the store's own order it came."""
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _LOG)


def write_chunks(chunks: DataFrame, path: str, *, writer: str, version: int) -> None:
    """Write one version of a writer; writing it again replaces just that version.

    Writers never touch each other's versions, so a batch load and streams share a store.  The
    version's documents go to a small log after its chunks: a version counts from then on, as a whole,
    and newer by the log's sequence, whatever the clocks of the writers say.  A version that is written
    again keeps its place; two writers at the same moment may share a number, and the later name wins."""
    spark = chunks.sparkSession
    mine = (F.col("writer") == writer) & (F.col("version") == version)
    known = _log(spark, path).agg(F.max(F.when(mine, F.col("sequence"))).alias("own"), F.max("sequence").alias("last")).first()
    sequence = known["own"] if known["own"] is not None else (known["last"] or 0) + 1
    (
        chunks.drop("is_active")
        .withColumn("writer", F.lit(writer))
        .withColumn("version", F.lit(version))
        .hint("rebalance", "project_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("writer", "version", "project_id")
        .parquet(f"{path}/chunks")
    )
    written = _stored(spark, path).where(mine).select(*DOC).distinct()
    (
        written.withColumns({"sequence": F.lit(sequence), "writer": F.lit(writer), "version": F.lit(version)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sequence", "writer", "version")
        .parquet(f"{path}/log")
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks").withColumns({name: F.col(name).cast("string") for name in ("project_id", "writer")})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The store: a chunk is active when its document was not written again later.

    All that is grouped is the log, one row per document and version.  Versions that are not in it
    are not read; only documents with several versions are looked up, so texts and vectors are not
    shuffled while these are few."""
    log = _log(spark, path)
    turn = F.struct("sequence", "writer", "version")
    again = (
        log.groupBy(*DOC)
        .agg(F.max(turn).alias("_newest"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(*DOC, F.col("_newest.writer").alias("_writer"), F.col("_newest.version").alias("_version"))
    )
    whole = log.select("writer", F.col("version").cast("int").alias("version")).distinct()
    stored = join_small(_stored(spark, path), whole, ["writer", "version"], "left_semi")
    newest = (F.col("writer") == F.col("_writer")) & (F.col("version") == F.col("_version"))
    return (
        join_small(stored, again, DOC, "left")
        .withColumn("is_active", F.coalesce(newest, F.lit(True)))
        .drop("_writer", "_version")
    )


def compact_chunks(spark: SparkSession, path: str, into: str, *, writer: str = "compacted", version: int = 1) -> None:
    """Write the active chunks of a store as one version of another one."""
    active = read_chunks(spark, path).where("is_active").drop("writer", "version")
    write_chunks(active, into, writer=writer, version=version)
