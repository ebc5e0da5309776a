"""Lexical postings of chunks and terms of queries.

Kinds: ``w`` whole or normalised identifier, ``d`` identifier found inside another, ``a`` plain
term, ``c`` ideograph term.

The index of a corpus has three tables: packs of a few thousand chunks of one project with the posting
lists of their terms, so that a pack is searched where it lies; the distinct identifiers of each project
with their trigrams, rare ones first; and how many identifiers hold each trigram, which is what rare
means.  It is built once, stored by project, and read by any number of searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.functions.joins import join_small
from corpuslens.schema import STABLE_KEYS
from corpuslens.session import durable

CHUNK_KEYS = ("project_id", "document_id", "document_name", "chunk_index", "chunk_id")
_TERMS = "array<struct<kind:string,surface:string>>"
#: Chunks of a pack.
PACK = 2048
_KEY_LISTS = {"document_name": "string", "chunk_index": "int", "document_id": "string", "chunk_id": "string"}
_PACK = (
    "project_id string, " + ", ".join(f"{key}s array<{kind}>" for key, kind in _KEY_LISTS.items())
    + ", surfaces array<string>, starts array<int>, entries array<int>"
)


def _tagged(surfaces: Column, kind: str) -> Column:
    return F.transform(
        surfaces, lambda surface: F.struct(F.lit(kind).alias("kind"), surface.alias("surface"))
    )


def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``terms``: the distinct lexical terms of a text, one pass per pattern."""
    mixes = F.col("_folded").rlike("[a-z][0-9]|[0-9][a-z]")
    none = F.array().cast("array<string>")
    ascii_only = F.octet_length(text) == F.char_length(text)
    staged = (
        df.withColumn("_folded", tx.casefold(F.col(text)))
        .withColumn("_marked", F.array_distinct(tx.separator_identifiers(F.col("_folded"))))
        .withColumn(
            "_whole",
            F.array_distinct(
                F.concat(
                    "_marked",
                    F.transform("_marked", tx.normalized_identifier),
                    # Most texts have no letter beside a digit and need no second look.
                    F.when(
                        mixes,
                        tx.mixed_words(tx.without_separator_identifiers(F.col("_folded"))),
                    ).otherwise(none),
                )
            ),
        )
        .withColumn(
            "_inner",
            F.when(
                mixes, F.array_distinct(tx.mixed_words(F.array_join("_marked", " ")))
            ).otherwise(none),
        )
        .withColumn(
            "_plain",
            F.array_except(
                tx.find_all(F.col("_folded"), tx.ASCII_TERM), F.concat("_whole", "_inner")
            ),
        )
    )
    return staged.withColumn(
        "terms",
        F.concat(
            _tagged(F.col("_whole"), "w"),
            _tagged(F.col("_inner"), "d"),
            _tagged(F.col("_plain"), "a"),
            _tagged(F.when(ascii_only, none).otherwise(tx.cjk_terms(F.col(text))), "c"),
        ).cast(_TERMS),
    ).drop("_folded", "_marked", "_whole", "_inner", "_plain")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per active chunk with its terms: the compact form to keep between passes."""
    return with_terms(chunks.where("is_active").select(*CHUNK_KEYS, "text")).select(
        *CHUNK_KEYS, "terms"
    )


def build_postings(chunks: DataFrame) -> DataFrame:
    """(chunk, kind, surface), each once, for active chunks: an inverted index as a table."""
    return explode_terms(chunk_terms(chunks))


def explode_terms(terms: DataFrame) -> DataFrame:
    """One row per term.  The outer form keeps the planner from testing the size of the array below
    the projection that makes it, which would cut every text twice."""
    return (
        terms.select(*CHUNK_KEYS, F.explode_outer("terms").alias("term"))
        .where("term is not null")
        .select(*CHUNK_KEYS, "term.kind", "term.surface")
    )


def _pack(project: str, rows: pa.Table) -> pa.RecordBatch:
    """Chunks in stable order; per distinct term, in order, the chunks that hold it."""
    rows = rows.take(pc.sort_indices(rows, [(key, "ascending") for key in STABLE_KEYS], null_placement="at_start")).combine_chunks()
    lists = rows.column("keys").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    chunks = np.repeat(np.arange(len(rows), dtype=np.int32), lists.value_lengths().to_numpy())
    entries = chunks[np.argsort(terms, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(order)))]).astype(np.int32)

    def whole(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [whole(rows.column(key).combine_chunks()) for key in STABLE_KEYS]
    columns += [whole(coded.dictionary.take(pa.array(order))), whole(pa.array(starts)), whole(pa.array(entries))]
    return pa.RecordBatch.from_arrays(
        [pa.array([project], pa.string()), *columns],
        names=["project_id", *(f"{key}s" for key in STABLE_KEYS), "surfaces", "starts", "entries"],
    )


def pack_postings(terms: DataFrame, size: int = PACK) -> DataFrame:
    """Packs of at most ``size`` chunks of one project, cut inside each task: no shuffle.

    ``terms``: as from ``chunk_terms``.  A task holds at most eight packs' worth of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        count: dict[str, int] = {}
        for batch in batches:
            given = pa.Table.from_batches([batch])
            for project in pc.unique(batch.column("project_id")).to_pylist():
                mine = given.filter(pc.equal(given.column("project_id"), project) if project is not None else pc.is_null(given.column("project_id")))
                held.setdefault(project, []).append(mine)
                count[project] = count.get(project, 0) + len(mine)
            while held and (max(count.values()) >= size or sum(count.values()) >= 8 * size):
                project = max(count, key=count.get)
                rows = pa.concat_tables(held.pop(project))
                del count[project]
                yield _pack(project, rows.slice(0, size))
                if len(rows) > size:
                    held[project], count[project] = [rows.slice(size)], len(rows) - size
        for project, tables in held.items():
            yield _pack(project, pa.concat_tables(tables))

    keyed = terms.select(
        *CHUNK_KEYS, F.transform("terms", lambda t: F.concat(t["kind"], t["surface"])).alias("keys")
    )
    return keyed.mapInArrow(run, _PACK)


def explode_packs(packs: DataFrame) -> DataFrame:
    """(chunk, kind, surface) from the posting lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                starts, entries = batch.column("starts")[at].values.to_numpy(), batch.column("entries")[at].values
                terms = batch.column("surfaces")[at].values.take(pa.array(np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                columns = [batch.column(f"{key}s")[at].values.take(entries) for key in STABLE_KEYS]
                project = pa.array([batch.column("project_id")[at].as_py()] * len(entries), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [project, *columns, pc.utf8_slice_codeunits(terms, 0, 1), pc.utf8_slice_codeunits(terms, 1)],
                    names=["project_id", *STABLE_KEYS, "kind", "surface"],
                )

    kinds = ", ".join(f"{key} {kind}" for key, kind in _KEY_LISTS.items())
    return packs.mapInArrow(run, f"project_id string, {kinds}, kind string, surface string")


def project_identifiers(packs: DataFrame) -> DataFrame:
    """(project, kind, surface): the distinct identifiers, read off the packs' term lists."""
    named = F.filter("surfaces", lambda s: s.startswith("w") | s.startswith("d"))
    return (
        packs.select("project_id", F.explode(named).alias("_key"))
        .distinct()
        .select("project_id", F.substring("_key", 1, 1).alias("kind"), F.expr("substring(_key, 2)").alias("surface"))
    )


def document_identifiers(packs: DataFrame, documents: DataFrame) -> DataFrame:
    """(project, scope, kind, surface) of single documents.  ``documents``: project_id, scope."""
    wanted = durable(documents.groupBy("project_id").agg(F.collect_set("scope").alias("scopes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                owners = batch.column("document_ids")[at].values
                terms = batch.column("surfaces")[at].values
                lengths = np.diff(batch.column("starts")[at].values.to_numpy())
                entries = batch.column("entries")[at].values.to_numpy()
                rows = np.repeat(np.arange(len(terms)), lengths)
                for scope in batch.column("scopes")[at].as_py():
                    mine = pc.equal(owners, scope).to_numpy(zero_copy_only=False)
                    found = [t for t in terms.take(pa.array(np.unique(rows[mine[entries]]))).to_pylist() if t[0] in "wd"]
                    project = batch.column("project_id")[at].as_py()
                    columns = ([project] * len(found), [scope] * len(found), [t[0] for t in found], [t[1:] for t in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string()) for c in columns], names=["project_id", "scope", "kind", "surface"]
                    )

    met = join_small(packs.select("project_id", "document_ids", "surfaces", "starts", "entries"), wanted, ["project_id"])
    # A pack without any of the documents never reaches Python.
    met = met.withColumn("scopes", F.array_intersect("scopes", "document_ids")).where(F.size("scopes") > 0)
    return met.mapInArrow(run, "project_id string, scope string, kind string, surface string").distinct()


def gram_counts(vocabulary: DataFrame) -> DataFrame:
    """(gram, holders): in how many identifiers a trigram occurs."""
    surfaces = vocabulary.select("project_id", "surface").distinct()
    return surfaces.select(F.explode(tx.trigrams(F.col("surface"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("holders"))


def with_grams(surfaces: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``grams``: the trigrams of ``surface``, those in few identifiers first."""
    distinct = surfaces.select("surface").where(F.char_length("surface") >= tx.MIN_SIMILAR_LENGTH).distinct()
    singles = distinct.select("surface", F.explode(tx.trigrams(F.col("surface"))).alias("gram"))
    counted = join_small(singles, counts, ["gram"], "left")
    sorted_grams = counted.groupBy("surface").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("holders", F.lit(0)).alias("n"), "gram")))["gram"].alias("grams")
    )
    return surfaces.join(sorted_grams, "surface", "left")


@dataclass(frozen=True)
class Index:
    """packs of postings; vocabulary: project_id, kind, surface, grams; counts: gram, holders."""

    packs: DataFrame
    vocabulary: DataFrame
    counts: DataFrame


def _project_packs(chunks: DataFrame) -> DataFrame:
    """Packs of whole projects: a project of any size is spread over tasks and small ones share them.

    Texts are cut into terms where they lie and the terms are moved, about as large as the texts: the
    few tasks that adaptive execution leaves behind the move only pack."""
    return pack_postings(chunk_terms(chunks).hint("rebalance", "project_id"))


def build_index(chunks: DataFrame) -> Index:
    """The index of the active chunks; their texts are cut into terms once."""
    packs = durable(_project_packs(chunks))
    identifiers = durable(project_identifiers(packs))
    counts = durable(gram_counts(identifiers))
    return Index(packs, durable(with_grams(identifiers, counts)), counts)


def write_index(chunks: DataFrame, path: str) -> None:
    """Store the index of the active chunks by project."""
    _project_packs(chunks).write.mode("overwrite").partitionBy("project_id").parquet(f"{path}/packs")
    spark = chunks.sparkSession
    identifiers = durable(project_identifiers(_by_project(spark, f"{path}/packs")))
    gram_counts(identifiers).write.mode("overwrite").parquet(f"{path}/grams")
    vocabulary = with_grams(identifiers, spark.read.parquet(f"{path}/grams"))
    vocabulary.write.mode("overwrite").partitionBy("project_id").parquet(f"{path}/vocabulary")


def _by_project(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("project_id", F.col("project_id").cast("string"))


def read_index(spark: SparkSession, path: str) -> Index:
    """Searches read the asked projects only."""
    return Index(_by_project(spark, f"{path}/packs"), _by_project(spark, f"{path}/vocabulary"), spark.read.parquet(f"{path}/grams"))


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query, kind, surface, gid, weight): identifier variants by group, terms with repeats.

    Every occurrence of a separator identifier opens a group, shared with its normalised form;
    an identifier inside it joins the group of the first record with the same surface; mixed
    words outside open their own groups."""
    record = "array<struct<kind:string,surface:string,gid:int>>"
    staged = (
        queries.withColumn("_folded", tx.casefold(F.col(text)))
        .withColumn("_marked", tx.separator_identifiers(F.col("_folded")))
        .withColumn(
            "_variants",
            F.flatten(
                F.transform(
                    "_marked",
                    lambda token, at: F.array_distinct(
                        F.array(
                            F.struct(
                                F.lit("w").alias("kind"), token.alias("surface"), at.alias("gid")
                            ),
                            F.struct(
                                F.lit("w").alias("kind"),
                                tx.normalized_identifier(token).alias("surface"),
                                at.alias("gid"),
                            ),
                        )
                    ),
                )
            ).cast(record),
        )
        .withColumn(
            "_inner",
            F.flatten(
                F.transform(
                    "_marked",
                    lambda token: F.transform(
                        tx.mixed_words(token),
                        lambda word: F.struct(
                            F.lit("d").alias("kind"),
                            word.alias("surface"),
                            F.array_min(
                                F.transform(
                                    F.filter("_variants", lambda v: v["surface"] == token),
                                    lambda v: v["gid"],
                                )
                            ).alias("gid"),
                        ),
                    ),
                )
            ).cast(record),
        )
        .withColumn(
            "_outer",
            F.transform(
                tx.mixed_words(tx.without_separator_identifiers(F.col("_folded"))),
                lambda word, at: F.struct(
                    F.lit("w").alias("kind"),
                    word.alias("surface"),
                    (at + F.size("_marked")).alias("gid"),
                ),
            ).cast(record),
        )
        .withColumn("_identifiers", F.concat("_variants", "_inner", "_outer"))
        .withColumn(
            "_plain",
            F.filter(
                tx.find_all(F.col("_folded"), tx.ASCII_TERM),
                lambda word: ~F.exists("_identifiers", lambda i: i["surface"] == word),
            ),
        )
    )
    loose = lambda surfaces, kind: F.transform(
        surfaces,
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s.alias("surface"), F.lit(-1).alias("gid")
        ),
    )
    everything = F.concat(
        F.array_distinct("_identifiers"),
        loose(F.col("_plain"), "a").cast(record),
        loose(tx.cjk_terms(F.col(text)), "c").cast(record),
    )
    return (
        staged.select("query_id", "project_id", "scope", F.explode_outer(everything).alias("term"))
        .where("term is not null")
        .groupBy("query_id", "project_id", "scope", "term.kind", "term.surface", "term.gid")
        .agg(F.count(F.lit(1)).cast("int").alias("weight"))
    )
