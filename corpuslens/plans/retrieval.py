"""Retrieval end to end, for a table of queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import intent
from corpuslens.functions.joins import join_small
from corpuslens.functions.text import word_count
from corpuslens.operators import tables as tb
from corpuslens.operators.evidence import select_evidence
from corpuslens.operators.fusion import (
    MAX_POOL,
    fuse_rrf,
    initial_limit,
    pool_limit,
    validate_queries,
    with_request_defaults,
)
from corpuslens.operators.keyword import retrieve_keyword, with_scope
from corpuslens.operators.postings import Index
from corpuslens.operators.rerank import overlap_score, rerank
from corpuslens.operators.vector import retrieve_vector
from corpuslens.session import durable

SETTINGS = (
    "project_id", "scope", "mode", "top_k", "vector_weight", "keyword_weight",
    "similarity_threshold", "reranker_enabled", "reranker_candidate_limit",
)


@dataclass(frozen=True)
class Retrieved:
    """What one retrieval run produces.

    ranked: ranked chunks per query without their texts, as a cut; outcomes: table choice per facet of
    whole-table questions; coverage: rows of each expanded table in the context; queries: settings with
    intent flags; rejected: requests that are not valid, with the reason; they take part in nothing
    else; chunks: what was searched."""

    ranked: DataFrame
    outcomes: DataFrame
    coverage: DataFrame
    queries: DataFrame
    rejected: DataFrame
    chunks: DataFrame

    @cached_property
    def results(self) -> DataFrame:
        """The ranked chunks with their texts."""
        return with_texts(self.ranked, self.chunks)


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    index: Index | None = None,
    limit: Column | None = None,
    max_limit: int = MAX_POOL,
) -> DataFrame:
    """Candidates per query by its mode: vector, keyword, or both fused.

    Both routes meet in one full join; a query takes part only in the routes of its mode."""
    asked = with_request_defaults(queries)
    cut = F.col("top_k") if limit is None else limit
    by_vector = asked.where(F.col("mode").isin("vector", "hybrid"))
    by_keyword = asked.where(F.col("mode").isin("keyword", "hybrid"))
    vector = retrieve_vector(
        by_vector, chunks, max_limit, threshold=F.col("similarity_threshold"), limit=cut
    )
    keyword = retrieve_keyword(by_keyword, chunks, max_limit, index=index, limit=cut)
    return fuse_rrf(
        vector,
        keyword,
        max_limit,
        F.col("vector_weight"),
        F.col("keyword_weight"),
        queries=asked,
        limit=cut,
    )


def plan_facets(queries: DataFrame) -> DataFrame:
    """One row per (query, facet) with intent flags and the width of its candidate pool."""
    full = with_scope(with_request_defaults(queries))
    for name, kind in (("preferred_document_id", "string"), ("preferred_table_index", "int")):
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    preferred = F.col("preferred_document_id").isNotNull() & F.col(
        "preferred_table_index"
    ).isNotNull()
    compound = F.size("_facets") > 1
    flagged = (
        full.withColumn("_facets", intent.facets(F.col("query")))
        .withColumn("is_compound", compound)
        .withColumn("is_full_table", preferred | compound | intent.is_full_table(F.col("query")))
        .withColumn("table_intent", F.col("is_full_table") | intent.is_table(F.col("query")))
    )
    return flagged.select(
        "query_id",
        "query",
        *SETTINGS,
        "preferred_document_id",
        "preferred_table_index",
        "is_compound",
        "is_full_table",
        "table_intent",
        "embedding",
        F.posexplode("_facets").alias("facet_index", "facet_query"),
    ).withColumn(
        "candidate_limit",
        pool_limit(
            F.col("mode"),
            F.col("top_k"),
            F.col("is_full_table"),
            initial_limit(
                F.col("top_k"), F.col("reranker_enabled"), F.col("reranker_candidate_limit")
            ),
        ),
    )


def facet_candidates(
    facets: DataFrame,
    chunks: DataFrame,
    index: Index | None = None,
    facet_vectors: DataFrame | None = None,
) -> DataFrame:
    """Candidate pools per facet, with metadata, and the words of plain texts, looked up for the candidates only.

    A chunk is a candidate of many questions, so its text is not copied into their pools."""
    asked = facets
    if facet_vectors is not None:
        own = facet_vectors.withColumnRenamed("embedding", "_own")
        asked = asked.join(own, ["query_id", "facet_index"], "left").withColumn(
            "embedding", F.coalesce("_own", "embedding")
        ).drop("_own")
    keyed = asked.select(
        F.concat_ws("\x1f", "query_id", "facet_index").alias("query_id"),
        F.col("facet_query").alias("query"),
        F.when(F.col("scope") != "", F.col("scope")).alias("document_id"),
        *[name for name in SETTINGS if name != "scope"],
        "candidate_limit",
        "embedding",
    )
    pool = retrieve(keyed, chunks, index, limit=F.col("candidate_limit"))
    parts = F.split("query_id", "\x1f")
    pool = durable(
        pool.drop("mode")
        .withColumn("facet_index", F.element_at(parts, -1).cast("int"))
        .withColumn("query_id", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "\x1f"))
    )
    contents = chunks.select("project_id", "chunk_id", "text", "meta")
    wanted = pool.select("project_id", "chunk_id").distinct()
    known = join_small(contents, wanted, ["project_id", "chunk_id"]).select(
        "project_id", "chunk_id", "meta", F.when(tb.not_tabular(), word_count(F.col("text"))).alias("words")
    )
    named = facets.select(
        "query_id", "facet_index", "facet_query", "query", "mode", "top_k", "reranker_enabled",
        "is_compound", "is_full_table",
    )
    return pool.join(known, ["project_id", "chunk_id"]).join(named, ["query_id", "facet_index"])


def with_texts(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked chunks with their texts, an expanded table's from active chunks.  ``ranked`` must be cheap to read."""
    keys = ["project_id", "chunk_id"]
    stored = chunks.select(*keys, "text", F.col("is_active").alias("_active"))
    texts = join_small(stored, ranked.select(*keys).distinct(), keys)
    return ranked.join(texts, keys).where(F.col("_active") | ~F.col("expanded")).drop("_active")


def _reranked(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates, a cut, reranked where their question asks for it; only for these the texts are read."""
    on = F.coalesce("reranker_enabled", F.lit(False))
    scored = candidates.where(~on).withColumn("_overlap", F.lit(None).cast("double"))
    asked = candidates.where(on)
    if not asked.isEmpty():
        shown = asked if "expanded" in asked.columns else asked.withColumn("expanded", F.lit(False))
        read = with_texts(shown, chunks).withColumn("_overlap", overlap_score(F.col("query"), F.col("text")))
        scored = scored.unionByName(read.select(*scored.columns))
    return rerank(scored, score_fn=lambda query, text: F.col("_overlap"), enabled=F.col("reranker_enabled")).drop("_overlap")


def retrieve_full(
    queries: DataFrame,
    chunks: DataFrame,
    index: Index | None = None,
    facet_vectors: DataFrame | None = None,
    preferences: DataFrame | None = None,
    budget: int = tb.CONTEXT_BUDGET,
) -> Retrieved:
    """Intent, candidate pools, table choice and expansion under a word budget, rerank, evidence.

    ``queries``: query_id, project_id, query, embedding, optional settings, optional document_id
    and preferred_document_id / preferred_table_index; ``preferences``: confirmed tables per
    facet (query_id, facet_index, document_id, table_index)."""
    checked = validate_queries(queries)
    rejected = checked.where("reject_reason is not null").select("query_id", "reject_reason")
    queries = checked.where("reject_reason is null").drop("reject_reason")
    facets = durable(plan_facets(queries))
    pool = durable(facet_candidates(facets, chunks, index, facet_vectors))
    whole = facets.where("is_full_table")
    outcomes = tb.select_tables(whole, tb.score_tables(pool.where("is_full_table")))
    single = whole.where(~F.col("is_compound") & F.col("preferred_document_id").isNotNull()).select(
        "query_id",
        "facet_index",
        F.col("preferred_document_id").alias("document_id"),
        F.col("preferred_table_index").alias("table_index"),
    )
    confirmed = single
    if preferences is not None:
        confirmed = single.unionByName(
            preferences.select("query_id", "facet_index", "document_id", "table_index")
        )
    scopes = facets.select("query_id", "project_id", "scope").distinct()
    outcomes = durable(tb.prefer_tables(outcomes, confirmed, chunks, scopes))

    # A question is expanded once all its facets have a table.
    ready = tb.plan_outcomes(outcomes).where("can_generate").select("query_id")
    groups = durable(
        tb.facet_groups(outcomes.join(ready, "query_id", "left_semi")).join(
            facets.where("facet_index = 0").select("query_id", "project_id", "is_compound"),
            "query_id",
        )
    )
    # What a table can give to a context is listed once per table, without texts; the questions that
    # chose it share the list, and texts are looked up for what is kept.
    identity = ("project_id", "document_id", "table_index")
    tables = groups.select(*identity).distinct()
    lists = durable(tb.budget_lists(tb.expand_tables(chunks, tables), identity, budget))
    alone, shared = groups.where(~F.col("is_compound")), groups.where("is_compound")
    companions = (
        pool.where(tb.not_tabular() & ~F.col("is_compound"))
        .join(alone.select("query_id", "document_id"), ["query_id", "document_id"])
        .select("query_id", "chunk_id", "words", "rank", "vector_score", "keyword_score", "fused_score")
    )
    kept_single, single_fit = tb.companion_budget(alone, lists, companions, identity, budget)
    kept_shared, shared_fit = tb.share_budget(shared, lists, identity, budget)
    single_fit = durable(single_fit)
    shared_fit = durable(shared_fit)
    scores = ("vector_score", "keyword_score", "fused_score")
    kept = durable(
        kept_single.withColumn("facet_indexes", F.lit(None).cast("array<int>")).unionByName(
            kept_shared.drop("first_facet").withColumn("companion", F.lit(False))
        ).join(groups.select("query_id", "project_id").distinct(), "query_id")
        .join(companions.select("query_id", "chunk_id", *scores).withColumn("companion", F.lit(True)), ["query_id", "chunk_id", "companion"], "left")
        .drop("companion")
    )
    wanted = kept.select("project_id", "chunk_id").distinct()
    contents = chunks.where("is_active").select("project_id", "document_name", "chunk_index", "chunk_id", "meta")
    context = kept.join(join_small(contents, wanted, ["project_id", "chunk_id"]), ["project_id", "chunk_id"])
    settings = facets.where("facet_index = 0").select(
        "query_id", "query", "top_k", "reranker_enabled", "is_compound"
    )
    context = durable(context.join(settings, "query_id").withColumn("expanded", F.lit(True)))
    from_tables = _reranked(context, chunks)

    # Everything else takes the ordinary way; an unresolved compound question has no context.
    ordinary = pool.where(~F.col("is_compound")).join(
        groups.select("query_id").distinct(), "query_id", "left_anti"
    )
    chosen = select_evidence(_reranked(ordinary, chunks), F.col("top_k")).withColumn("expanded", F.lit(False))
    ranked = durable(
        chosen.unionByName(from_tables, allowMissingColumns=True).drop(
            "facet_index", "facet_query", "is_full_table", "table_index", "mode", "words"
        )
    )

    cover_keys = ("query_id", "document_id", "table_index")
    covered = tb.table_coverage(
        context.where(F.col("meta.table_index") == F.col("table_index")), cover_keys
    )
    partial = single_fit.select("query_id", "is_partial").join(
        groups.select("query_id", "document_id", "table_index", "facet_indexes"), "query_id"
    ).unionByName(shared_fit.select("query_id", "is_partial", "document_id", "table_index", "facet_indexes"))
    coverage = partial.join(covered, [*cover_keys], "left")
    return Retrieved(ranked, outcomes, coverage, facets.where("facet_index = 0"), rejected, chunks)
