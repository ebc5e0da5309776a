"""What a query reads often is made once, and only what can matter is handed to Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from support import chunk_rows, questions

from corpuslens.catalog import load, mixed, quality, search
from corpuslens.operators import chunking, keyword, postings
from corpuslens.sources import sections as sc

SF_DIR = "/root/testdata/sf0.001"


class _Seen(Exception):
    pass


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["evaluation_run", "retrieval_log_chunks", "rerank_overlap", "select_evidence", "eval_hits", "hybrid_search", "mixed_modes"],
)
def test_chunks_are_cut_once(spark, monkeypatch, name):
    """What the routes get is a stored table, not the cutting of all documents."""
    given = []

    def seen(_, chunks, *args, **kwargs):
        given.append(chunks)
        raise _Seen

    monkeypatch.setattr(search.vector, "retrieve_vector", seen)
    monkeypatch.setattr(mixed.retrieval, "retrieve", seen)
    monkeypatch.setattr(quality, "run_eval", seen)
    with pytest.raises(_Seen):
        load()[0][name](spark, SF_DIR)
    assert given and "Generate" not in _plan(given[0]) and given[0].where("is_active").limit(1).count() == 1


def test_sections_are_cut_without_a_second_look(spark):
    docs = spark.createDataFrame(
        [("p", "a", "a", "one two\nthree"), ("p", "b", "b", " \n\t"), ("p", "c", "c", None)],
        "project_id string, document_id string, document_name string, text string",
    )
    pieces = chunking.chunk_text(sc.text_sections(docs)[0], 2, 0).select("document_id", "local_index", "text")
    assert [tuple(r) for r in pieces.orderBy("local_index").collect()] == [("a", 0, "one two"), ("a", 1, "three")]
    assert _plan(pieces).count("rtrim(") == 1
    blank = docs.withColumn("section_index", F.lit(0)).withColumn("meta", chunking.schema.meta())
    assert {r.document_id for r in chunking.chunk_text(blank).collect()} == {"a"}


def test_texts_are_cut_into_terms_before_they_are_moved(spark):
    plan = _plan(postings._project_packs(chunk_rows(spark, [("a", 0, "red node01-x")])))
    assert 0 <= plan.index("RebalancePartitions") < plan.index("regexp_extract_all")


def test_packs_without_the_document_never_reach_python(spark):
    """A pack of other documents has lists that no task could read."""
    chunks = chunk_rows(spark, [("a", 0, "node01-east red"), ("b", 0, "node01-west blue")])
    own = postings.build_index(chunks)
    broken = own.packs.select(
        "project_id", "document_names", "chunk_indexs", F.array(F.lit("z")).alias("document_ids"), "chunk_ids", "surfaces",
        F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("entries"),
    )
    index = postings.Index(own.packs.unionByName(broken), own.vocabulary, own.counts)
    asked = questions(spark, [("q", "node01-east red"), ("r", "blue")]).withColumn("document_id", F.when(F.col("query_id") == "q", "a").otherwise("b"))
    found = keyword.retrieve_keyword(asked, None, 5, index=index).collect()
    assert sorted(found) == sorted(keyword.retrieve_keyword(asked, chunks, 5).collect())
    assert {(r.query_id, r.document_id) for r in found} == {("q", "a"), ("r", "b")}


def test_the_table_store_is_cut_with_what_retrieval_reads(spark, monkeypatch):
    """No hashes are stored with the tables that questions are asked of, and shuffles go with the query that made them."""
    from corpuslens.catalog import tableqa
    from corpuslens.session import SHUFFLE_CLEANUP

    def seen(asked, store):
        raise _Seen(store.columns, spark.conf.get(SHUFFLE_CLEANUP), store.where("is_active").limit(1).count())

    monkeypatch.setattr(tableqa.retrieval, "retrieve_full", seen)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    for name in ("retrieve_tables", "table_prompts"):
        with pytest.raises(_Seen) as found:
            load()[0][name](spark, SF_DIR)
        columns, cleanup, rows = found.value.args
        assert cleanup == "true" and rows == 1
        assert set(columns) == {"project_id", "document_id", "document_name", "chunk_index", "chunk_id", "text", "meta", "is_active", "embedding"}
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
