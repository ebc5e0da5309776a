"""Lexical, vector and hybrid retrieval over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.catalog import base, sqlbase
from corpuslens.catalog.registry import query, with_
from corpuslens.functions.joins import join_small
from corpuslens.functions.text import trigrams
from corpuslens.functions.vectors import cosine
from corpuslens.operators import evidence, fusion, keyword, logs, postings, rerank, vector
from corpuslens.session import durable, shared_folder

POOL = 24
TOP = 8

@query(
    "postings_by_surface",
    with_(
        sqlbase.CHUNKS,
        sqlbase.terms("chunks", "chunk_id", "text", "chunk"),
        body="""SELECT kind, surface, count(DISTINCT chunk_id) AS chunks FROM (
          SELECT chunk_id, kind, surface FROM chunk_idents
          UNION ALL SELECT chunk_id, 'a', word FROM chunk_ascii
          UNION ALL SELECT chunk_id, 'c', term FROM chunk_cjk) GROUP BY ALL""",
    ),
)
def postings_by_surface(spark, sf_dir):
    """How many chunks hold each surface of each kind."""
    index = postings.build_postings(base.text_chunks(spark, sf_dir))
    return index.groupBy("kind", "surface").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "identifier_trigrams",
    with_(
        sqlbase.CHUNKS,
        sqlbase.terms("chunks", "chunk_id", "text", "chunk"),
        body=f"""SELECT gram, count(*) AS surfaces FROM (
          SELECT unnest({sqlbase.grams("surface")}) AS gram FROM (
            SELECT DISTINCT surface FROM chunk_idents WHERE length(surface) >= 5)) GROUP BY gram""",
    ),
)
def identifier_trigrams(spark, sf_dir):
    """Trigrams of the identifier vocabulary."""
    surfaces = (
        postings.build_postings(base.text_chunks(spark, sf_dir))
        .where(F.col("kind").isin("w", "d"))
        .select("surface")
        .distinct()
    )
    return surfaces.select(F.explode(trigrams(F.col("surface"))).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("surfaces")
    )


@query(
    "query_term_groups",
    with_(
        sqlbase.QUERIES,
        sqlbase.terms("queries", "query_id", "query", "query"),
        body="""SELECT query_id, kind, surface, CAST(count(DISTINCT gid) AS BIGINT) AS groups,
                       CAST(sum(weight) AS BIGINT) AS weight FROM (
          SELECT DISTINCT query_id, kind, surface, gid, 1 AS weight FROM query_idents
          UNION ALL SELECT query_id, 'a', word, -1, count(*) FROM query_ascii GROUP BY ALL
          UNION ALL SELECT query_id, 'c', term, -1, 1 FROM query_cjk) GROUP BY query_id, kind, surface""",
    ),
)
def query_term_groups(spark, sf_dir):
    """Query-side terms: occurrence groups of identifiers, repeats of plain terms."""
    terms = postings.query_terms(keyword.with_scope(base.queries(spark, sf_dir)))
    return terms.groupBy("query_id", "kind", "surface").agg(
        F.count_distinct("gid").alias("groups"), F.sum("weight").alias("weight")
    )


def _keyword(spark, sf_dir, top_k, chunks=None):
    if chunks is None:
        chunks = base.text_chunks(spark, sf_dir)
    return keyword.retrieve_keyword(base.queries(spark, sf_dir), chunks, top_k)


@query(
    "keyword_search",
    with_(
        sqlbase.KEYWORD,
        body=f"""SELECT query_id, project_id, document_id, document_name, chunk_index, chunk_id,
          exact_identifiers, exact_ascii_terms, exact_cjk_terms, contained_identifiers,
          ngram_matches, keyword_score, rank FROM keyword_ranked WHERE rank <= {TOP}""",
    ),
)
def keyword_search(spark, sf_dir):
    """Top chunks per query by lexical score."""
    return _keyword(spark, sf_dir, TOP)


@query(
    "stored_keyword_search",
    with_(
        sqlbase.KEYWORD,
        body=f"SELECT query_id, chunk_id, keyword_score, exact_identifiers, rank FROM keyword_ranked WHERE rank <= {TOP}",
    ),
)
def stored_keyword_search(spark, sf_dir):
    """L7-L14 from a stored index: postings, vocabulary and gram counts are written, then read for the
    asked projects; no text of the corpus is cut again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    postings.write_index(base.text_chunks(spark, sf_dir), path)
    found = keyword.retrieve_keyword(base.queries(spark, sf_dir), None, TOP, index=postings.read_index(spark, path))
    return found.select("query_id", "chunk_id", "keyword_score", "exact_identifiers", "rank")


@query(
    "keyword_search_in_document",
    with_(
        sqlbase.KEYWORD.replace(
            "JOIN chunks c ON c.project_id = q.project_id\n",
            "JOIN chunks c ON c.project_id = q.project_id AND c.document_id = CAST(q.item_id AS VARCHAR)\n",
        ),
        body=f"SELECT query_id, chunk_id, keyword_score, rank FROM keyword_ranked WHERE rank <= {TOP}",
    ),
)
def keyword_search_in_document(spark, sf_dir):
    """L14 limited to one document per query."""
    asked = base.queries(spark, sf_dir).withColumn("document_id", F.col("query_id"))
    found = keyword.retrieve_keyword(asked, base.text_chunks(spark, sf_dir), TOP)
    return found.select("query_id", "chunk_id", "keyword_score", "rank")


@query(
    "identifier_evidence",
    with_(
        sqlbase.KEYWORD,
        body="""SELECT query_id, gid_rank, tier, count(*) AS chunks FROM (
          SELECT query_id, chunk_id, tier, dense_rank() OVER (PARTITION BY query_id ORDER BY gid) AS gid_rank FROM kept)
          GROUP BY ALL""",
    ),
)
def identifier_evidence(spark, sf_dir):
    """Chunks per query identifier group and tier, after suppression."""
    index = postings.build_index(base.text_chunks(spark, sf_dir))
    terms = postings.query_terms(keyword.with_scope(base.queries(spark, sf_dir)))
    tiers = keyword.identifier_tiers(terms, keyword.scope_vocabulary(index, terms, scoped=False), index.counts)
    hits = join_small(postings.explode_packs(index.packs), tiers, ["project_id", "kind", "surface"])
    best = hits.groupBy("query_id", "gid", "chunk_id").agg(F.max("tier").alias("tier"))
    counted = best.groupBy("query_id", "gid", "tier").agg(F.count(F.lit(1)).alias("chunks"))
    order = Window.partitionBy("query_id").orderBy("gid")
    return counted.withColumn("gid_rank", F.dense_rank().over(order)).drop("gid")


@query(
    "cosine_similarity",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_similarity(spark, sf_dir):
    """V1: cosine of each vector with the next one."""
    left = base.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return left.join(right, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 9).alias("cosine")
    )


def _vector(spark, sf_dir, top_k, chunks=None):
    if chunks is None:
        chunks = base.text_chunks(spark, sf_dir)
    return vector.retrieve_vector(
        base.queries(spark, sf_dir), base.with_vectors(spark, sf_dir, chunks), top_k
    )


@query(
    "vector_search",
    with_(
        sqlbase.CHUNKS, sqlbase.QUERIES, sqlbase.VECTOR,
        body=f"""SELECT query_id, project_id, document_id, document_name, chunk_index, chunk_id,
          round(vector_score, 9) AS vector_score, rank FROM vector_ranked WHERE rank <= {TOP}""",
    ),
)
def vector_search(spark, sf_dir):
    """V2: top chunks per query by cosine."""
    return _vector(spark, sf_dir, TOP).withColumn("vector_score", F.round("vector_score", 9))


def _chunks(spark, sf_dir):
    """Chunks cut once for all that read them: both routes, and texts looked up for what they find."""
    return durable(base.text_chunks(spark, sf_dir))


def _fused(spark, sf_dir, top_k, chunks=None):
    if chunks is None:
        chunks = _chunks(spark, sf_dir)
    return fusion.fuse_rrf(
        _vector(spark, sf_dir, POOL, chunks), _keyword(spark, sf_dir, POOL, chunks), top_k
    )


@query(
    "hybrid_search",
    with_(
        sqlbase.KEYWORD, sqlbase.VECTOR, sqlbase.fused(POOL),
        body=f"""SELECT query_id, document_id, chunk_id, CAST(vector_rank AS INTEGER) AS vector_rank,
          CAST(keyword_rank AS INTEGER) AS keyword_rank, round(vector_rrf_score, 9) AS vector_rrf_score,
          round(keyword_rrf_score, 9) AS keyword_rrf_score, round(fused_score, 9) AS fused_score,
          exact_identifiers, contained_identifiers, ngram_matches, rank,
          'weighted_rrf' AS fusion_method, CAST(60 AS INTEGER) AS fusion_rrf_k
          FROM fused WHERE rank <= {TOP}""",
    ),
)
def hybrid_search(spark, sf_dir):
    """V3-V5: both routes fused by weighted reciprocal rank."""
    rounded = {
        name: F.round(name, 9) for name in ("vector_rrf_score", "keyword_rrf_score", "fused_score")
    }
    return _fused(spark, sf_dir, TOP).withColumns(rounded).select(
        "query_id", "document_id", "chunk_id", "vector_rank", "keyword_rank", "vector_rrf_score",
        "keyword_rrf_score", "fused_score", "exact_identifiers", "contained_identifiers",
        "ngram_matches", "rank", "fusion_method", "fusion_rrf_k",
    )


_SETTINGS_SQL = """settings AS (
  SELECT CAST(event_id AS VARCHAR) AS query_id, trim(CASE WHEN value < 1 THEN ' ' ELSE event_type END) AS query,
         CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'keyword' WHEN 2 THEN 'hybrid' ELSE 'hybrid' END AS mode,
         CAST(event_id % 60 AS INTEGER) AS top_k, (event_id % 3) / 2.0::DOUBLE AS vector_weight,
         (event_id % 5) / 4.0::DOUBLE AS keyword_weight, event_id % 7 = 0 AS reranker_enabled,
         CAST(event_id % 250 AS INTEGER) AS reranker_candidate_limit, event_id % 11 = 0 AS full_table
  FROM events)"""


def _settings(spark, sf_dir):
    """Request settings of every shape, one per event."""
    events = base.table(spark, sf_dir, "events")
    turn = F.col("event_id")
    return events.select(
        turn.cast("string").alias("query_id"),
        F.trim(F.when(F.col("value") < 1, " ").otherwise(F.col("event_type"))).alias("query"),
        F.element_at(
            F.array(*map(F.lit, ("vector", "keyword", "hybrid", "hybrid"))),
            (F.floor("value") % 4 + 1).cast("int"),
        ).alias("mode"),
        (turn % 60).cast("int").alias("top_k"),
        (turn % 3 / F.lit(2.0)).alias("vector_weight"),
        (turn % 5 / F.lit(4.0)).alias("keyword_weight"),
        (turn % 7 == 0).alias("reranker_enabled"),
        (turn % 250).cast("int").alias("reranker_candidate_limit"),
        (turn % 11 == 0).alias("full_table"),
    )


@query(
    "candidate_limits",
    with_(
        _SETTINGS_SQL,
        """wide AS (SELECT *, CASE WHEN full_table THEN greatest(top_k * 5, 40)
            WHEN reranker_enabled THEN greatest(top_k, reranker_candidate_limit) ELSE top_k END AS w FROM settings)""",
        body="""SELECT query_id, CAST(CASE WHEN mode = 'keyword' THEN greatest(w, top_k * 3, 20)
          WHEN mode = 'vector' THEN w WHEN full_table THEN greatest(w * 3, 60)
          ELSE greatest(top_k * 3, 20, w) END AS INTEGER) AS candidate_limit FROM wide""",
    ),
)
def candidate_limits(spark, sf_dir):
    """V6: pool width per request."""
    initial = fusion.initial_limit(
        F.col("top_k"), F.col("reranker_enabled"), F.col("reranker_candidate_limit")
    )
    return _settings(spark, sf_dir).select(
        "query_id",
        fusion.pool_limit(F.col("mode"), F.col("top_k"), F.col("full_table"), initial).alias(
            "candidate_limit"
        ),
    )


@query(
    "validate_queries",
    with_(
        _SETTINGS_SQL,
        body="""SELECT query_id, CASE WHEN query = '' THEN 'query must not be empty'
          WHEN NOT top_k BETWEEN 1 AND 50 THEN 'top_k is out of range'
          WHEN NOT reranker_candidate_limit BETWEEN 1 AND 200 THEN 'reranker_candidate_limit is out of range'
          WHEN mode = 'hybrid' AND vector_weight + keyword_weight <= 0 THEN 'hybrid weights must not both be zero'
          END AS reject_reason FROM settings""",
    ),
)
def validate_queries(spark, sf_dir):
    """V8: accepted and rejected requests with the reason."""
    return fusion.validate_queries(_settings(spark, sf_dir)).select("query_id", "reject_reason")


_RERANKED = """scored AS (
  SELECT f.*, c.text, q.query FROM (SELECT * FROM fused WHERE rank <= {pool}) f
  JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id)),
overlapped AS (
  SELECT *, CASE WHEN len(qt) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(qt, tt)) / CAST(len(qt) AS DOUBLE) END AS reranker_score
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-zA-Z0-9]+')) AS qt,
               list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9]+')) AS tt FROM scored)),
reranked AS (
  SELECT * EXCLUDE (rank), rank AS pre_rerank_rank,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, fused_score DESC, rank) AS INTEGER) AS rank
  FROM overlapped)""".format(pool=POOL)


def _with_text(spark, sf_dir, candidates, chunks=None):
    if chunks is None:
        chunks = base.text_chunks(spark, sf_dir)
    contents = chunks.select("chunk_id", "text", "meta")
    asked = base.queries(spark, sf_dir).select("query_id", "query")
    return join_small(contents, durable(candidates), ["chunk_id"]).join(asked, "query_id")


@query(
    "rerank_overlap",
    with_(
        sqlbase.KEYWORD, sqlbase.VECTOR, sqlbase.fused(POOL), _RERANKED,
        body=f"""SELECT query_id, chunk_id, round(reranker_score, 9) AS reranker_score, pre_rerank_rank,
          round(fused_score, 9) AS pre_rerank_fused_score, rank FROM reranked WHERE rank <= {TOP}""",
    ),
)
def rerank_overlap(spark, sf_dir):
    """V9: pools reordered by word overlap."""
    chunks = _chunks(spark, sf_dir)
    pool = _with_text(spark, sf_dir, _fused(spark, sf_dir, POOL, chunks), chunks)
    return rerank.rerank(pool, TOP).select(
        "query_id", "chunk_id", F.round("reranker_score", 9).alias("reranker_score"),
        "pre_rerank_rank", F.round("pre_rerank_fused_score", 9).alias("pre_rerank_fused_score"), "rank",
    )


EVIDENCE_SQL = f"""kinds AS (SELECT *, CASE WHEN exact_identifiers > 0 THEN 'exact_identifier'
              WHEN contained_identifiers > 0 THEN 'contained_identifier' END AS kind FROM fused WHERE rank <= {POOL}),
        firsts AS (SELECT *, kind IS NOT NULL AND row_number() OVER (PARTITION BY query_id, document_id, kind ORDER BY rank) = 1 AS first FROM kinds),
        needs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first AND kind = 'exact_identifier' THEN 0
              WHEN first THEN 1 ELSE 2 END, rank) AS need FROM firsts)"""


@query(
    "select_evidence",
    with_(
        sqlbase.KEYWORD, sqlbase.VECTOR, sqlbase.fused(POOL), EVIDENCE_SQL,
        body=f"""SELECT query_id, chunk_id, CASE WHEN first THEN 'protected_' || kind ELSE 'ranked_fill' END AS evidence_selection_reason,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM needs WHERE need <= {TOP}""",
    ),
)
def select_evidence(spark, sf_dir):
    """Protected identifier evidence, then rank fill."""
    chunks = _chunks(spark, sf_dir)
    pool = _with_text(spark, sf_dir, _fused(spark, sf_dir, POOL, chunks), chunks)
    return evidence.select_evidence(pool, TOP).select(
        "query_id", "chunk_id", "evidence_selection_reason", "rank"
    )


@query(
    "retrieval_log_chunks",
    with_(
        sqlbase.KEYWORD, sqlbase.VECTOR, sqlbase.fused(POOL),
        body=f"""SELECT f.query_id AS retrieval_log_id, chunk_id, f.rank, f.document_id, f.document_name,
          f.chunk_index, substring(c.text, 1, 500) AS text_preview, round(fused_score, 9) AS fused_score
          FROM fused f JOIN chunks c USING (chunk_id) WHERE rank <= {TOP}""",
    ),
)
def retrieval_log_chunks(spark, sf_dir):
    """Logged chunks of every query with preview."""
    chunks = _chunks(spark, sf_dir)
    logged = durable(logs.log_chunk_rows(_fused(spark, sf_dir, TOP, chunks)))
    return logs.log_detail(logged, chunks).select(
        "retrieval_log_id", "chunk_id", "rank", "document_id", "document_name", "chunk_index",
        "text_preview", F.round("fused_score", 9).alias("fused_score"),
    )
