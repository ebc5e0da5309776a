from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from corpuslens.operators import metrics as mt
from corpuslens.plans import ingest as ing
from corpuslens.session import shared_folder
from corpuslens.sources import export as ex
from corpuslens.sources import sections as sc
from corpuslens.streaming import ingest as si
from corpuslens.streaming import metrics as sm

DOCS = "project_id string, document_id string, document_name string, text string"


def fresh(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def docs(spark, **texts):
    return spark.createDataFrame([("p", d, d + ".txt", t) for d, t in texts.items()], DOCS)


def vectors(spark, *rows):
    return spark.createDataFrame(
        [("p", d, i, v) for d, i, v in rows],
        "project_id string, document_id string, chunk_index int, embedding array<float>",
    )


def run(spark, documents, given, version=1):
    found, _ = sc.text_sections(documents)
    return ing.ingest(documents, found, given, 2, 3, 1, version, single_section=True, tables=False)


def test_a_document_succeeds_or_fails_as_a_whole(spark):
    documents = docs(spark, ok="a b c", part="a b c d e", wide="x", blank=" ")
    given = vectors(spark, ("ok", 0, [1.0, 0.0]), ("part", 0, [1.0, 0.0]), ("wide", 0, [1.0]))
    done = run(spark, documents, given)
    got = {r.document_id: (r.status, r.error_message) for r in done.outcomes.collect()}
    assert got == {
        "ok": ("completed", None), "part": ("failed", ing.BAD_VECTORS),
        "wide": ("failed", ing.BAD_VECTORS), "blank": ("failed", sc.NO_TEXT),
    }
    assert [r.chunk_id for r in done.chunks.collect()] == ["ok:1:0"]


def test_failed_reindex_keeps_chunks_and_status(spark):
    first = run(spark, docs(spark, a="one", b="two"), vectors(spark, ("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0])))
    again = run(spark, docs(spark, a="new", b="worse"), vectors(spark, ("a", 0, [1.0, 0.0])), 2)
    after = ing.reindex(first.chunks, again.chunks, again.outcomes)
    assert {(r.chunk_id, r.is_active) for r in after.collect()} == {("a:1:0", False), ("a:2:0", True), ("b:1:0", True)}
    before = docs(spark, a="", b="", c="").withColumn("status", F.lit("indexed"))
    status = {r.document_id: (r.status, r.error_message) for r in ing.document_status(before, again.outcomes).collect()}
    assert status == {"a": ("indexed", None), "b": ("indexed", None), "c": ("indexed", None)}
    new = before.withColumn("status", F.lit("uploaded"))
    assert {r.document_id: r.status for r in ing.document_status(new, again.outcomes).collect()}["b"] == "failed"


def test_job_of_a_wrong_project_fails(spark):
    at = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [("j1", "p", "a", "queued", at, None), ("j1", "p", "a", "completed", at, None), ("j2", "q", "a", "running", at, None)],
        "job_id string, project_id string, document_id string, status string, ts timestamp, error_message string",
    )
    known = spark.createDataFrame([("p", "a", "uploaded")], "project_id string, document_id string, status string")
    got = {r.job_id: (r.status, r.document_status) for r in ing.job_outcomes(events, known).collect()}
    assert got == {"j1": ("completed", "indexed"), "j2": ("failed", None)}


def test_documents_stream_into_versions(spark):
    root = fresh(spark)
    schema = DOCS + ", arrived int"

    def arrive(**texts):
        docs(spark, **texts).withColumn("arrived", F.lit(1)).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def absorb():
        stream = si.document_stream(spark, f"{root}/in", schema)
        si.stream_ingest(stream, f"{root}/store", f"{root}/ckpt", f"{root}/out").awaitTermination()

    arrive(a="first text", b="other text")
    absorb()
    arrive(a="second text", c=" ")
    absorb()
    absorb()
    stored = ing.read_chunks(spark, f"{root}/store")
    assert {(r.document_id, r.text, r.is_active) for r in stored.collect()} == {
        ("a", "first text", False), ("a", "second text", True), ("b", "other text", True)
    }
    failed = spark.read.parquet(f"{root}/out").where("status = 'failed'").collect()
    assert [(r.document_id, r.error_message) for r in failed] == [("c", sc.NO_TEXT)]


def test_rewriting_a_version_replaces_it(spark):
    path = fresh(spark)
    done = run(spark, docs(spark, a="one"), vectors(spark, ("a", 0, [1.0, 0.0])))
    ing.write_chunks(done.chunks.drop("meta"), path, writer="w", version=1)
    ing.write_chunks(done.chunks.drop("meta"), path, writer="w", version=1)
    assert ing.read_chunks(spark, path).count() == 1


def test_writers_keep_their_own_versions(spark):
    path = fresh(spark)
    for name, text, writer in (("a", "one", "load"), ("b", "two", "stream"), ("a", "three", "stream-2")):
        done = run(spark, docs(spark, **{name: text}), vectors(spark, (name, 0, [1.0, 0.0])))
        ing.write_chunks(done.chunks.drop("meta"), path, writer=writer, version=1)
    got = {(r.document_id, r.text, r.is_active) for r in ing.read_chunks(spark, path).collect()}
    assert got == {("a", "one", False), ("b", "two", True), ("a", "three", True)}
    ing.compact_chunks(spark, path, path + "-2")
    assert {r.text for r in ing.read_chunks(spark, path + "-2").collect()} == {"two", "three"}


def test_a_version_counts_once_it_is_logged(spark):
    """Chunks without a log entry, as a writer that died leaves them, are not read; a replay keeps its place."""
    path = fresh(spark)
    first = run(spark, docs(spark, a="one"), vectors(spark, ("a", 0, [1.0, 0.0]))).chunks.drop("meta")
    second = run(spark, docs(spark, a="two"), vectors(spark, ("a", 0, [1.0, 0.0]))).chunks.drop("meta")
    ing.write_chunks(first, path, writer="z", version=1)
    half = second.drop("is_active").withColumns({"writer": F.lit("dead"), "version": F.lit(1)})
    half.write.mode("append").partitionBy("writer", "version", "project_id").parquet(f"{path}/chunks")
    assert [r.text for r in ing.read_chunks(spark, path).collect()] == ["one"]
    ing.write_chunks(second, path, writer="a", version=1)
    ing.write_chunks(first, path, writer="z", version=1)
    assert {(r.text, r.is_active) for r in ing.read_chunks(spark, path).collect()} == {("one", False), ("two", True)}


def test_kept_summary_counts_late_requests(spark):
    root = fresh(spark)
    rows = requests(spark)
    for part in (rows.where("request_id <> '1'"), rows.where("request_id = '1'")):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        sm.keep_chat_summary(stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    got = sm.read_chat_summary(spark, f"{root}/out").orderBy("start").collect()
    assert [(r.request_count, r.avg_latency_ms) for r in got] == [(2, 150.0), (3, 400.0), (2, 650.0)]
    assert got[0].avg_retrieval_latency_ms == 20.0 and got[0].avg_generation_latency_ms is None


def requests(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(str(i), "p", at + dt.timedelta(hours=8 * i), 100 * i, None if i == 1 else 10 * i, None, i) for i in range(1, 8)]
    return spark.createDataFrame(rows, "request_id string, project_id string, created_at timestamp, latency_ms int, retrieval_latency_ms int, generation_latency_ms int, citation_count int")


def test_recorded_requests_take_a_bounded_number_of_folders(spark):
    root = fresh(spark)
    rows = requests(spark).drop("project_id").crossJoin(spark.range(200).select(F.concat(F.lit("0"), "id").alias("project_id")))
    rows.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    sm.record_requests(stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    stored = sm.read_requests(spark, f"{root}/out")
    assert sorted(stored.columns) == sorted(rows.columns)
    assert stored.select(*rows.columns).exceptAll(rows).isEmpty() and stored.count() == 1400
    assert stored.select(F.input_file_name()).distinct().count() <= sm.PROJECT_BUCKETS
    assert [r.project_id for r in sm.read_requests(spark, f"{root}/out", "07").collect()] == ["07"] * 7


def test_chat_summary_skips_nulls_and_keeps_idle_projects(spark):
    projects = spark.createDataFrame([("p",), ("idle",)], "project_id string")
    got = {r.project_id: r for r in mt.chat_summary(requests(spark), projects).collect()}
    assert (got["p"].request_count, got["p"].avg_retrieval_latency_ms, got["p"].avg_generation_latency_ms) == (7, 45.0, None)
    assert (got["idle"].request_count, got["idle"].avg_latency_ms) == (0, None)
    assert [r.request_id for r in mt.recent_requests(requests(spark), 0).collect()] == ["7"]


def test_streamed_summary_closes_windows(spark):
    root = fresh(spark)
    requests(spark).coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(requests(spark).schema).parquet(f"{root}/in")
    sm.stream_chat_summary(stream).writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/ckpt"
    ).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{root}/out").orderBy("start").collect()
    assert [(r.request_count, r.avg_latency_ms) for r in got] == [(2, 150.0), (3, 400.0)]


def test_natural_order_without_case_and_accents(spark):
    names = ["Über 2.txt", "uber 10.txt", "UBER 2.txt", "zebra.txt", "Éclair.txt", "eclair.txt", "écran 1.txt", "a-b.txt", "ab.txt", "007.txt", "7.txt", "12345678901234567890123.txt"]
    df = spark.createDataFrame([("p", n, i) for i, n in enumerate(names)], "project_id string, filename string, created_at int")
    assert [r.filename for r in mt.natural_order(df).collect()] == [
        "007.txt", "7.txt", "12345678901234567890123.txt", "a-b.txt", "ab.txt", "Éclair.txt", "eclair.txt",
        "écran 1.txt", "Über 2.txt", "UBER 2.txt", "uber 10.txt", "zebra.txt",
    ]


def test_corpus_summary_and_natural_order(spark):
    rows = [("p", "a10.txt", "indexed", 1), ("p", "A2.txt", "indexed", 2), ("p", "a2.txt", "failed", 1), ("p", "a10.txt", "uploaded", 2)]
    df = spark.createDataFrame(rows, "project_id string, filename string, status string, created_at int")
    row = mt.corpus_summary(df).first()
    assert tuple(row)[1:] == (4, 3, 2, 1, 1, 1)
    assert [(r.filename, r.created_at) for r in mt.natural_order(df).collect()] == [("a2.txt", 1), ("A2.txt", 2), ("a10.txt", 1), ("a10.txt", 2)]


def test_csv_quotes(spark):
    path = fresh(spark)
    spark.createDataFrame([('say "hi", ok', None)], "a string, b string").coalesce(1).createOrReplaceTempView("t")
    ex.write_csv(spark.table("t"), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["a,b", '"say ""hi"", ok",']


def test_text_files_are_read_whole(spark, tmp_path):
    (tmp_path / "n.md").write_text("# a\r\n\r\nb ", encoding="utf-8")
    row = sc.read_markdown_sections(spark, str(tmp_path), "p").first()
    assert (row.document_name, row.text, row.meta.format, row.meta.line_end) == ("n.md", "# a\nb", "markdown", 3)
    up = sc.validate_uploads(sc.read_upload_files(spark, str(tmp_path), "p")).first()
    assert (up.safe_filename, up.size_bytes, up.reject_reason) == ("n.md", 9, None)
