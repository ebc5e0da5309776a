"""Column contracts shared by the operators.

Every table carries ``project_id``; ids are strings.  ``meta`` is one wide struct: every key a
section or chunk may carry, null where it does not apply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META_FIELDS: dict[str, str] = {
    "format": "string",
    "type": "string",
    "table_chunk_type": "string",
    "page_number": "int",
    "line_start": "int",
    "line_end": "int",
    "sheet_name": "string",
    "row_start": "int",
    "row_end": "int",
    "paragraph_start": "int",
    "paragraph_end": "int",
    "block_index": "int",
    "table_index": "int",
    "caption": "string",
    "headers": "array<string>",
    "column_count": "int",
    "row_count": "int",
    "header_confidence": "double",
    "header_source": "string",
    "nested_table_fallback": "boolean",
    "nested_rows": "array<int>",
    "row": "int",
    "data_row": "int",
    "section_index": "int",
    "chunk_index": "int",
    "chunker_version": "string",
    "data_row_start": "int",
    "data_row_end": "int",
    "total_rows": "int",
}

META_DDL = "struct<" + ",".join(f"{name}:{kind}" for name, kind in META_FIELDS.items()) + ">"

CHUNKER_VERSION = "spark-table-aware-1"

DOCUMENT_STATUSES = ("uploaded", "processing", "indexed", "failed")
JOB_STATUSES = ("queued", "running", "completed", "failed")
MODES = ("vector", "keyword", "hybrid")
PARENT_KINDS = ("table", "table_group")
TABLE_KINDS = ("table", "table_group", "table_row", "table_header")

# Candidate identity: the order in which equal scores are ranked.
STABLE_KEYS = ("document_name", "chunk_index", "document_id", "chunk_id")


def meta(base: Column | None = None, **given: Column) -> Column:
    """The metadata struct: fields from ``given``, else from ``base``, else null."""
    unknown = set(given) - set(META_FIELDS)
    if unknown:
        raise ValueError(f"unknown metadata fields: {sorted(unknown)}")
    if base is not None:
        for name, value in given.items():
            base = base.withField(name, value.cast(META_FIELDS[name]))
        return base
    return F.struct(
        *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in META_FIELDS.items()]
    )


def stable_order(prefix: str = "") -> list[Column]:
    return [F.col(prefix + key).asc_nulls_first() for key in STABLE_KEYS]
