"""Sections from text, sheet rows, pages and paragraphs; upload routing and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.functions import text as tx
from corpuslens.functions.ordered import dense_index
from corpuslens.session import durable

# Accepted extensions, the size limit and the messages of a rejection.
EXTENSIONS = (".pdf", ".docx", ".md", ".txt", ".xlsx")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
NO_TEXT = "Document contains no usable text"
EMPTY_UPLOAD = "Uploaded file is empty"
LARGE_UPLOAD = "Uploaded file is too large"
FALLBACK_NAME = "upload.bin"

SECTION_COLUMNS = ("project_id", "document_id", "document_name", "section_index", "text", "meta")


def _trimmed_lines(content: Column) -> Column:
    """Right-trimmed lines, any line ending, without a byte order mark."""
    plain = F.replace(
        F.replace(F.ltrim(content, F.lit("\ufeff")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")
    )
    return F.transform(F.split(plain, "\n"), tx.rstrip)


def text_sections(
    documents: DataFrame, content: str = "text", markdown: bool = False
) -> tuple[DataFrame, DataFrame]:
    """One section per text document, and the documents without any text."""
    filled = tx.has_text(F.col(content))
    lines = documents.where(filled).withColumn("_lines", _trimmed_lines(F.col(content)))
    numbers = F.filter(
        F.transform("_lines", lambda line, at: F.when(line != "", at + 1)),
        lambda number: number.isNotNull(),
    )
    details = {"line_start": F.array_min(numbers), "line_end": F.array_max(numbers)}
    if markdown:
        details["format"] = F.lit("markdown")
    sections = lines.select(
        "project_id",
        "document_id",
        "document_name",
        F.lit(0).alias("section_index"),
        tx.strip(F.array_join(F.filter("_lines", lambda line: line != ""), "\n")).alias("text"),
        schema.meta(**details).alias("meta"),
    )
    rejected = documents.where(~F.coalesce(filled, F.lit(False))).select(
        "project_id", "document_id", "document_name", F.lit(NO_TEXT).alias("error_message")
    )
    return sections, rejected


def read_text_files(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """Whole text files as documents: id is the path, name its last part."""
    files = spark.read.text(path, wholetext=True)
    source = F.col("_metadata.file_path")
    return files.select(
        F.lit(project_id).alias("project_id"),
        source.alias("document_id"),
        F.col("_metadata.file_name").alias("document_name"),
        F.col("value").alias("text"),
    )


def read_text_sections(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    return text_sections(read_text_files(spark, path, project_id))[0]


def read_markdown_sections(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    return text_sections(read_text_files(spark, path, project_id), markdown=True)[0]


def sheet_row_sections(rows: DataFrame) -> DataFrame:
    """Non-empty rows of visible sheets, values joined by a bar.

    ``rows``: project_id, document_id, document_name, sheet_index, sheet_name, sheet_state,
    row_index (1-based), values array<string>."""
    values = F.filter(
        F.transform("values", tx.strip), lambda value: value.isNotNull() & (value != "")
    )
    kept = (
        rows.where(F.col("sheet_state") == "visible")
        .withColumn("_values", values)
        .where(F.size("_values") > 0)
    )
    ranked = dense_index(
        kept,
        ["project_id", "document_id"],
        F.struct("sheet_index", F.floor(F.col("row_index") / 4096)),
        [F.col("sheet_index"), F.col("row_index")],
        "section_index",
    )
    return ranked.select(
        "project_id",
        "document_id",
        "document_name",
        "section_index",
        F.array_join("_values", " | ").alias("text"),
        schema.meta(
            sheet_name=F.col("sheet_name"), row_start=F.col("row_index"), row_end=F.col("row_index")
        ).alias("meta"),
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """Pages with text.  ``pages``: project_id, document_id, document_name, page_number, text."""
    kept = pages.withColumn("text", tx.strip(F.col("text"))).where(F.col("text") != "")
    ranked = dense_index(
        kept,
        ["project_id", "document_id"],
        F.floor(F.col("page_number") / 4096),
        [F.col("page_number")],
        "section_index",
    )
    return ranked.select(
        "project_id",
        "document_id",
        "document_name",
        "section_index",
        "text",
        schema.meta(page_number=F.col("page_number")).alias("meta"),
    )


def paragraph_blocks(paragraphs: DataFrame) -> DataFrame:
    """Non-blank paragraphs as unnumbered blocks.

    ``paragraphs``: project_id, document_id, document_name, block_index, paragraph_index, text."""
    number = F.col("paragraph_index") + 1
    return (
        paragraphs.withColumn("text", tx.strip(F.col("text")))
        .where(F.col("text") != "")
        .select(
            "project_id",
            "document_id",
            "document_name",
            "block_index",
            F.lit(0).alias("part"),
            F.lit(0).alias("part_row"),
            "text",
            schema.meta(
                type=F.lit("paragraph"),
                paragraph_start=number,
                paragraph_end=number,
                block_index=F.col("block_index"),
            ).alias("meta"),
        )
    )


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Number blocks 0..n-1 per document in (block, part, row) order.

    Numbering reads the blocks twice, so they are cut first."""
    ranked = dense_index(
        durable(blocks),
        ["project_id", "document_id"],
        F.struct("block_index", "part", F.floor(F.col("part_row") / 4096)),
        [F.col("block_index"), F.col("part"), F.col("part_row")],
        "section_index",
    )
    return ranked.select(*SECTION_COLUMNS)


def paragraph_sections(paragraphs: DataFrame, table_blocks: DataFrame | None = None) -> DataFrame:
    """Paragraphs and tables of a document as sections in document order."""
    blocks = paragraph_blocks(paragraphs)
    if table_blocks is not None:
        blocks = blocks.unionByName(table_blocks)
    return number_blocks(blocks)


def extension(filename: Column) -> Column:
    """Lower-case suffix of the last path part; none for dot-files and trailing dots."""
    base = F.regexp_extract(filename, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(base, r"[^.].*?(\.[^.]+)$", 1))


def safe_name(filename: Column) -> Column:
    base = F.regexp_extract(tx.strip(filename), r"([^/]*)/*$", 1)
    cleaned = F.regexp_replace(
        F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", ""
    )
    return F.when(cleaned == "", F.lit(FALLBACK_NAME)).otherwise(cleaned)


def route_by_format(files: DataFrame, filename: str = "filename") -> DataFrame:
    """Add ``extension`` and, where the format is not accepted, ``reject_reason``."""
    ext = extension(F.col(filename))
    shown = F.when(ext == "", F.lit("none")).otherwise(ext)
    return files.withColumn("extension", ext).withColumn(
        "reject_reason",
        F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("Unsupported parser extension: "), shown)),
    )


def validate_uploads(
    files: DataFrame, root: str = "uploads", max_bytes: int = MAX_UPLOAD_BYTES
) -> DataFrame:
    """Add safe name, storage path and reject reason.

    ``files``: project_id, document_id, filename, size_bytes."""
    name = F.col("safe_filename")
    ext = extension(name)
    shown = F.when(ext == "", F.lit("none")).otherwise(ext)
    reason = (
        F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("Unsupported file type: "), shown))
        .when(F.col("size_bytes") == 0, F.lit(EMPTY_UPLOAD))
        .when(F.col("size_bytes") > max_bytes, F.lit(LARGE_UPLOAD))
    )
    return (
        files.withColumn("safe_filename", safe_name(F.col("filename")))
        .withColumn("reject_reason", reason)
        .withColumn(
            "storage_path",
            F.when(
                F.col("reject_reason").isNull(),
                F.concat_ws("/", F.lit(root), "project_id", "document_id", name),
            ),
        )
    )


def read_upload_files(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """Name and size of stored files; file content is never read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.lit(project_id).alias("project_id"),
        F.col("path").alias("document_id"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"),
    )
