"""Sections, chunks, uploads and ingestion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.catalog import base, sqlbase
from corpuslens.catalog.registry import query, with_
from corpuslens.operators import chunking
from corpuslens.plans import ingest as ing
from corpuslens.session import durable, shared_folder
from corpuslens.sources import sections as sc

_LINE_RANGE = """
  CAST(list_min(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN ls[i] <> '' THEN i END), lambda x: x IS NOT NULL)) AS INTEGER) AS line_start,
  CAST(list_max(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN ls[i] <> '' THEN i END), lambda x: x IS NOT NULL)) AS INTEGER) AS line_end"""


@query(
    "text_sections",
    with_(sqlbase.DOCS, sqlbase.LINES, sqlbase.SECTIONS,
          body=f"SELECT project_id, document_id, CAST(0 AS INTEGER) AS section_index, text, {_LINE_RANGE} FROM sections"),
)
def text_sections(spark, sf_dir):
    """One cleaned section per document."""
    found, _ = sc.text_sections(base.documents(spark, sf_dir))
    return found.select(
        "project_id", "document_id", "section_index", "text", "meta.line_start", "meta.line_end"
    )


@query(
    "markdown_sections",
    with_(sqlbase.DOCS, sqlbase.LINES, sqlbase.SECTIONS,
          body=f"SELECT document_id, text, 'markdown' AS format, {_LINE_RANGE} FROM sections"),
)
def markdown_sections(spark, sf_dir):
    """The same with its format recorded."""
    found, _ = sc.text_sections(base.documents(spark, sf_dir), markdown=True)
    return found.select("document_id", "text", "meta.format", "meta.line_start", "meta.line_end")


_SHEETS_SQL = f"""sheet_rows AS (
  SELECT p_brand AS document_id, p_type AS sheet_name, p_partkey + 1 AS row_index,
         CASE WHEN p_size % 10 = 0 THEN 'hidden' ELSE 'visible' END AS sheet_state,
         list_filter([trim(p_name), trim('  ' || p_type || ' '), CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END], lambda v: v <> '') AS vs
  FROM part)"""


@query(
    "sheet_row_sections",
    with_(_SHEETS_SQL, body="""SELECT document_id,
          CAST(row_number() OVER (PARTITION BY document_id ORDER BY row_index) - 1 AS INTEGER) AS section_index,
          array_to_string(vs, ' | ') AS text, sheet_name, CAST(row_index AS INTEGER) AS row_start
          FROM sheet_rows WHERE sheet_state = 'visible' AND len(vs) > 0"""),
)
def sheet_row_sections(spark, sf_dir):
    """S3: rows of visible sheets; one workbook per brand."""
    part = base.table(spark, sf_dir, "part")
    rows = part.select(
        F.lit("parts").alias("project_id"),
        F.col("p_brand").alias("document_id"),
        F.col("p_brand").alias("document_name"),
        F.lit(0).alias("sheet_index"),
        F.col("p_type").alias("sheet_name"),
        F.when(F.col("p_size") % 10 == 0, "hidden").otherwise("visible").alias("sheet_state"),
        (F.col("p_partkey") + 1).cast("int").alias("row_index"),
        F.array(
            "p_name",
            F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")),
            F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_size").cast("string")),
        ).alias("values"),
    )
    return sc.sheet_row_sections(rows).select(
        "document_id", "section_index", "text", "meta.sheet_name", "meta.row_start"
    )


@query(
    "page_sections",
    f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS INTEGER) AS section_index,
          page_number, text FROM (
        SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS document_id, CAST(page_id + 1 AS INTEGER) AS page_number,
               trim(regexp_replace(html, '<[^>]*>', ' ', 'g'), {sqlbase.WS}) AS text FROM pages)
        WHERE text <> ''""",
)
def page_sections(spark, sf_dir):
    """Pages with text, numbered per host."""
    pages = base.table(spark, sf_dir, "pages").select(
        F.lit("web").alias("project_id"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("document_id"),
        F.lit("").alias("document_name"),
        (F.col("page_id") + 1).cast("int").alias("page_number"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("text"),
    )
    return sc.page_sections(pages).select(
        "document_id", "section_index", "meta.page_number", "text"
    )


@query(
    "paragraph_sections",
    with_(sqlbase.DOCS, f"""paragraphs AS (
          SELECT document_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS block_index
          FROM (SELECT document_id, string_split(text, chr(10)) AS ls FROM docs))""",
          body=f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY block_index) - 1 AS INTEGER) AS section_index,
          trim(raw, {sqlbase.WS}) AS text, CAST(block_index + 1 AS INTEGER) AS paragraph_start, CAST(block_index AS INTEGER) AS block_index
          FROM paragraphs WHERE trim(raw, {sqlbase.WS}) <> ''"""),
)
def paragraph_sections(spark, sf_dir):
    """The lines of each document as paragraphs."""
    lines = base.documents(spark, sf_dir).select(
        "project_id", "document_id", "document_name",
        F.posexplode(F.split("text", "\n")).alias("block_index", "text"),
    ).withColumn("paragraph_index", F.col("block_index"))
    return sc.paragraph_sections(lines).select(
        "document_id", "section_index", "text", "meta.paragraph_start", "meta.block_index"
    )


_FILES_SQL = """files AS (
  SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS document_id, n_chars,
         (CASE doc_id % 7 WHEN 0 THEN ' in/../_report ' WHEN 1 THEN 'Größe ' ELSE 'doc-' END) || doc_id ||
         (CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' WHEN 4 THEN '.xlsx' ELSE
            CASE WHEN doc_id % 4 = 1 THEN '' ELSE '.tar.gz' END END) AS filename
  FROM documents)"""


def _files(spark, sf_dir):
    turn = F.col("doc_id")
    stem = F.when(turn % 7 == 0, " in/../_report ").when(turn % 7 == 1, "Größe ").otherwise("doc-")
    suffix = (
        F.when(turn % 6 == 0, ".pdf").when(turn % 6 == 1, ".DOCX").when(turn % 6 == 2, ".md")
        .when(turn % 6 == 3, ".txt").when(turn % 6 == 4, ".xlsx")
        .when(turn % 4 == 1, "").otherwise(".tar.gz")
    )
    return base.table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        turn.cast("string").alias("document_id"),
        "n_chars",
        F.concat(stem, turn.cast("string"), suffix).alias("filename"),
    )


_EXT = "lower(regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1))"


@query(
    "route_by_format",
    with_(_FILES_SQL, body=f"""SELECT document_id, extension, CASE WHEN extension NOT IN ('.pdf', '.docx', '.md', '.txt', '.xlsx')
          THEN 'Unsupported parser extension: ' || CASE WHEN extension = '' THEN 'none' ELSE extension END END AS reject_reason
          FROM (SELECT document_id, {_EXT.format("filename")} AS extension FROM files)"""),
)
def route_by_format(spark, sf_dir):
    """Extension and rejection per file."""
    return sc.route_by_format(_files(spark, sf_dir)).select(
        "document_id", "extension", "reject_reason"
    )


@query(
    "validate_uploads",
    with_(_FILES_SQL, f"""named AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(
            regexp_extract(trim(filename, {sqlbase.WS}), '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g'), '^[._]+', ''), '[._]+$', '') AS n,
            CASE WHEN n_chars < 60 THEN 0 ELSE n_chars * 5000 END AS size_bytes FROM files),
          safe AS (SELECT *, CASE WHEN n = '' THEN 'upload.bin' ELSE n END AS safe_filename FROM named),
          judged AS (SELECT *, {_EXT.format("safe_filename")} AS extension FROM safe),
          reasons AS (SELECT *, CASE
            WHEN extension NOT IN ('.pdf', '.docx', '.md', '.txt', '.xlsx') THEN 'Unsupported file type: ' || CASE WHEN extension = '' THEN 'none' ELSE extension END
            WHEN size_bytes = 0 THEN 'Uploaded file is empty' WHEN size_bytes > 52428800 THEN 'Uploaded file is too large' END AS reject_reason FROM judged)""",
          body="""SELECT document_id, safe_filename, reject_reason, CASE WHEN reject_reason IS NULL
            THEN 'uploads/' || project_id || '/' || document_id || '/' || safe_filename END AS storage_path FROM reasons"""),
)
def validate_uploads(spark, sf_dir):
    """Safe name, storage path, rejection."""
    size = F.when(F.col("n_chars") < 60, 0).otherwise(F.col("n_chars") * 5000)
    return sc.validate_uploads(_files(spark, sf_dir).withColumn("size_bytes", size)).select(
        "document_id", "safe_filename", "reject_reason", "storage_path"
    )


_HASH_SQL = """sha256(concat_ws(chr(31), project_id, document_id, '0', '', '', '', '', '', '',
    CAST(line_start AS VARCHAR), CAST(line_end AS VARCHAR), '', '', '', '', 'spark-table-aware-1', '', text))"""


@query(
    "text_chunks",
    with_(sqlbase.CHUNKS, body=f"""SELECT project_id, document_id, chunk_index, chunk_id, text, token_count,
          {_HASH_SQL} AS content_hash FROM chunks"""),
)
def text_chunks(spark, sf_dir):
    """Chunks of every document with number and hash."""
    return base.text_chunks(spark, sf_dir).select(
        "project_id", "document_id", "chunk_index", "chunk_id", "text", "token_count", "content_hash"
    )


@query(
    "overlapping_chunks",
    with_(sqlbase.DOCS, sqlbase.LINES, sqlbase.SECTIONS, sqlbase.chunks(60, 12),
          body="SELECT document_id, chunk_index, text, token_count FROM chunks"),
)
def overlapping_chunks(spark, sf_dir):
    """C1 with short windows, so that most documents have many."""
    found, _ = sc.text_sections(base.documents(spark, sf_dir))
    chunks = chunking.chunk_sections(found, 60, 12, single_section=True, tables=False)
    return chunks.select("document_id", "chunk_index", "text", "token_count")


@query(
    "chunks_across_sections",
    with_(sqlbase.DOCS, f"""paragraphs AS (
          SELECT document_id, trim(unnest(ls), {sqlbase.WS}) AS text, generate_subscripts(ls, 1) AS block_index
          FROM (SELECT document_id, string_split(text, chr(10)) AS ls FROM docs)),
        kept AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block_index) - 1 AS section_index FROM paragraphs WHERE text <> ''),
        worded AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM kept),
        windows AS (SELECT *, unnest(range(CASE WHEN len(w) <= 20 THEN 1 ELSE CAST(ceil((len(w) - 20) / 15.0::DOUBLE) AS BIGINT) + 1 END)) AS i FROM worded)""",
          body="""SELECT document_id, CAST(section_index AS INTEGER) AS section_index,
          CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_index, i) - 1 AS INTEGER) AS chunk_index,
          array_to_string(w[i * 15 + 1 : i * 15 + 20], ' ') AS text FROM windows"""),
)
def chunks_across_sections(spark, sf_dir):
    """C4: numbering over all sections of a document."""
    lines = base.documents(spark, sf_dir).select(
        "project_id", "document_id", "document_name",
        F.posexplode(F.split("text", "\n")).alias("block_index", "text"),
    ).withColumn("paragraph_index", F.col("block_index"))
    chunks = chunking.chunk_sections(durable(sc.paragraph_sections(lines)), 20, 5, tables=False)
    return chunks.select("document_id", "section_index", "chunk_index", "text")


@query(
    "chunk_store",
    with_(sqlbase.CHUNKS, body="""SELECT project_id, document_id, chunk_id, chunk_index, token_count, md5(text) AS text_md5, true AS is_active FROM chunks"""),
)
def chunk_store(spark, sf_dir):
    """The store written by project and read back."""
    import uuid

    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    ing.write_chunks(base.text_chunks(spark, sf_dir).drop("meta"), path, writer="load", version=1)
    return ing.read_chunks(spark, path).select(
        "project_id", "document_id", "chunk_id", "chunk_index", "token_count", F.md5("text").alias("text_md5"), "is_active"
    )


@query(
    "compacted_store",
    with_(sqlbase.CHUNKS, body="""SELECT document_id, chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'second ' ELSE '' END || md5(chunks.text) AS content,
          doc_id % 3 = 0 AS rewritten FROM chunks JOIN docs USING (document_id)"""),
)
def compacted_store(spark, sf_dir):
    """Every third document written again by another writer, the first version replayed after that (it
    keeps its place), and the active chunks compacted into a new store."""
    import uuid

    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    chunks = durable(base.text_chunks(spark, sf_dir).drop("meta"))
    plain = chunks.withColumn("text", F.md5("text"))
    third = plain.where("cast(document_id as long) % 3 = 0").withColumn("text", F.concat(F.lit("second "), "text"))
    ing.write_chunks(plain, path, writer="load", version=1)
    ing.write_chunks(third, path, writer="again", version=1)
    ing.write_chunks(plain, path, writer="load", version=1)
    ing.compact_chunks(spark, path, f"{path}-compact")
    return ing.read_chunks(spark, f"{path}-compact").where("is_active").select(
        "document_id", "chunk_index", F.col("text").alias("content"), F.startswith("text", F.lit("second")).alias("rewritten")
    )


_ARRIVALS_SQL = """docs AS (
  SELECT source AS project_id, doc_id || '#' || v AS document_id, 'doc-' || doc_id || '.txt' AS document_name,
         text || CASE v WHEN 0 THEN '' WHEN 1 THEN ' once more' ELSE ' and again' END AS text, doc_id, v
  FROM documents, (SELECT unnest([0, 1, 2]) AS v) WHERE v = 0 OR (v = 1 AND doc_id % 2 = 0) OR (v = 2 AND doc_id % 4 = 0))"""


@query(
    "streamed_ingest",
    with_(_ARRIVALS_SQL, sqlbase.LINES, sqlbase.SECTIONS, sqlbase.chunks(), body="""SELECT d.project_id, CAST(d.doc_id AS VARCHAR) AS document_id,
          c.text LIKE '% once more' AS once, c.chunk_index, c.token_count, md5(c.text) AS text_md5,
          d.v = CASE WHEN d.doc_id % 4 = 0 THEN 2 WHEN d.doc_id % 2 = 0 THEN 1 ELSE 0 END AS is_active
          FROM chunks c JOIN docs d USING (document_id)"""),
)
def streamed_ingest(spark, sf_dir):
    """A batch load, then two arrivals of changed documents by a stream, which is started once
    more without any."""
    import uuid

    from corpuslens.streaming import ingest as si

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    given = base.documents(spark, sf_dir).select("project_id", "document_id", "document_name", "text")
    found, _ = sc.text_sections(given)
    load = ing.ingest(given, found, version=1, single_section=True, tables=False)
    ing.write_chunks(load.chunks.drop("embedding", "meta"), f"{root}/store", writer="load", version=1)
    number = F.col("document_id").cast("long")
    changed = (
        given.where(number % 2 == 0).withColumn("text", F.concat("text", F.lit(" once more"))),
        given.where(number % 4 == 0).withColumn("text", F.concat("text", F.lit(" and again"))),
        given.limit(0),
    )
    for part in changed:
        part = part.withColumn("arrived", F.lit(1))
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        si.stream_ingest(stream, f"{root}/store", f"{root}/ckpt", f"{root}/outcomes").awaitTermination()
    return ing.read_chunks(spark, f"{root}/store").select(
        "project_id", "document_id", F.col("text").endswith(" once more").alias("once"), "chunk_index",
        "token_count", F.md5("text").alias("text_md5"), "is_active",
    )


def _vectors(spark, sf_dir):
    """The vectors at hand, by chunk."""
    have = base.embedded_chunks(spark, sf_dir).where("embedding is not null")
    return have.select("project_id", "document_id", "chunk_index", "embedding")


def _ingested(spark, sf_dir):
    """Documents with a vector on every chunk succeed, the rest fail."""
    docs = base.documents(spark, sf_dir)
    found, _ = sc.text_sections(docs)
    vectors = _vectors(spark, sf_dir)
    return docs, ing.ingest(docs, found, vectors, 64, single_section=True, tables=False)


_OUTCOME_SQL = """outcomes AS (
  SELECT d.project_id, d.document_id, CASE
      WHEN c.n IS NULL THEN 'Document contains no usable text'
      WHEN c.bare > 0 THEN 'Embedding response does not match the chunks' END AS error_message
  FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n,
      count(*) FILTER ((CAST(document_id AS BIGINT) + 3 * chunk_index) % 11 = 0) AS bare FROM chunks GROUP BY document_id) c USING (document_id))"""


@query(
    "ingest_outcomes",
    with_(sqlbase.CHUNKS, _OUTCOME_SQL, body="""SELECT project_id, document_id, error_message,
          CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS status FROM outcomes"""),
)
def ingest_outcomes(spark, sf_dir):
    """Each document succeeds or fails as a whole."""
    return _ingested(spark, sf_dir)[1].outcomes.select(
        "project_id", "document_id", "error_message", "status"
    )


@query(
    "ingested_chunks",
    with_(sqlbase.CHUNKS, _OUTCOME_SQL, body="""SELECT c.document_id, c.chunk_id, c.token_count, CAST(len(e.embedding) AS INTEGER) AS width,
          c.document_id || ':s:0' AS section_id
          FROM chunks c JOIN outcomes o USING (document_id)
          JOIN embeddings e ON e.vec_id = (CAST(c.document_id AS BIGINT) + 7 * c.chunk_index) % (SELECT count(*) FROM embeddings)
          WHERE o.error_message IS NULL"""),
)
def ingested_chunks(spark, sf_dir):
    """Stored chunks with vector and section."""
    done = _ingested(spark, sf_dir)[1]
    return ing.link_sections(done.chunks, done.sections).select(
        "document_id", "chunk_id", "token_count", F.size("embedding").alias("width"), "section_id"
    )


@query(
    "reindexed_store",
    with_(sqlbase.CHUNKS, _OUTCOME_SQL, body="""SELECT c.project_id, c.chunk_id, CAST(1 AS INTEGER) AS version, o.error_message IS NOT NULL AS is_active FROM chunks c JOIN outcomes o USING (document_id)
          UNION ALL
          SELECT c.project_id, c.document_id || ':2:' || c.chunk_index, 2, true FROM chunks c JOIN outcomes o USING (document_id) WHERE o.error_message IS NULL"""),
)
def reindexed_store(spark, sf_dir):
    """A second pass replaces only the documents that succeed in it."""
    docs = base.documents(spark, sf_dir)
    found, _ = sc.text_sections(docs)
    before = base.text_chunks(spark, sf_dir).withColumn("version", F.lit(1))
    vectors = _vectors(spark, sf_dir)
    again = ing.ingest(docs, found, vectors, 64, version=2, single_section=True, tables=False)
    after = ing.reindex(before, again.chunks.withColumn("version", F.lit(2)), again.outcomes)
    return after.select("project_id", "chunk_id", "version", "is_active")


@query(
    "document_status",
    with_(sqlbase.CHUNKS, _OUTCOME_SQL, body="""SELECT o.document_id, CASE WHEN o.error_message IS NULL OR l.quality = 1 THEN 'indexed' ELSE 'failed' END AS status,
          CASE WHEN o.error_message IS NOT NULL AND coalesce(l.quality, 0) <> 1 THEN o.error_message END AS error_message
          FROM outcomes o LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = o.document_id"""),
)
def document_status(spark, sf_dir):
    """Documents that were indexed stay so when a re-index fails."""
    labels = base.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs, done = _ingested(spark, sf_dir)
    before = docs.join(labels, "doc_id", "left").select(
        "project_id", "document_id",
        F.when(F.col("quality") == 1, "indexed").otherwise("uploaded").alias("status"),
    )
    return ing.document_status(before, done.outcomes).select("document_id", "status", "error_message")


@query(
    "job_outcomes",
    """WITH events_ AS (SELECT user_id AS job_id, user_id % 40 AS doc_id, ts, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running'
         WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS error_message FROM events),
       last AS (SELECT job_id, doc_id, max_by(struct_pack(s := status, e := error_message), ts) AS l FROM events_ GROUP BY ALL),
       docs AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'indexed' ELSE 'uploaded' END AS document_status FROM labels)
       SELECT CAST(job_id AS VARCHAR) AS job_id, CASE WHEN d.doc_id IS NULL THEN 'failed' ELSE l.s END AS status,
         CASE WHEN d.doc_id IS NULL THEN 'Document not found for project' ELSE l.e END AS error_message,
         CASE WHEN d.doc_id IS NULL THEN NULL WHEN l.s = 'completed' THEN 'indexed' WHEN l.s = 'running' THEN 'processing'
              WHEN l.s = 'failed' AND d.document_status <> 'indexed' THEN 'failed' ELSE d.document_status END AS document_status
       FROM last LEFT JOIN docs d USING (doc_id)""",
)
def job_outcomes(spark, sf_dir):
    """Latest state of each job, one job per user."""
    kind = F.col("event_type")
    events = base.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        F.lit("p").alias("project_id"),
        (F.col("user_id") % 40).cast("string").alias("document_id"),
        F.when(kind == "click", "queued").when(kind == "view", "running")
        .when(kind == "purchase", "completed").otherwise("failed").alias("status"),
        "ts",
        F.when(kind.isin("error", "signup"), kind).alias("error_message"),
    )
    docs = base.table(spark, sf_dir, "labels").select(
        F.lit("p").alias("project_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("quality") == 1, "indexed").otherwise("uploaded").alias("status"),
    )
    return ing.job_outcomes(events, docs).select("job_id", "status", "error_message", "document_status")


@query(
    "delete_documents",
    with_(sqlbase.CHUNKS, """gone AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels WHERE toxic = 1),
        expected AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels)""",
          body="""SELECT 'documents' AS name, document_id AS id FROM docs WHERE document_id NOT IN (SELECT document_id FROM gone)
          UNION ALL SELECT 'chunks', chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM gone)
          UNION ALL SELECT 'citations', chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM gone)
          UNION ALL SELECT 'questions', CASE WHEN document_id NOT IN (SELECT document_id FROM gone) THEN document_id END FROM expected"""),
)
def delete_documents(spark, sf_dir):
    """I8: toxic documents leave every table; expectations of them become null."""
    docs = base.documents(spark, sf_dir)
    labels = base.table(spark, sf_dir, "labels").join(docs, "doc_id")
    chunks = base.text_chunks(spark, sf_dir)
    left = ing.delete_documents(
        {
            "documents": docs,
            "chunks": chunks,
            "citations": chunks.select("project_id", "chunk_id"),
            "questions": labels.select(
                "project_id", F.col("document_id").alias("expected_document_id"),
                F.lit(None).cast("string").alias("expected_chunk_id"),
            ),
        },
        labels.where("toxic = 1"),
    )
    ids = {"documents": "document_id", "chunks": "chunk_id", "citations": "chunk_id", "questions": "expected_document_id"}
    parts = [df.select(F.lit(name).alias("name"), F.col(ids[name]).alias("id")) for name, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "delete_projects",
    with_(sqlbase.CHUNKS, body="""SELECT project_id, chunk_id FROM chunks WHERE project_id NOT IN
          (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(quality) < 0.9)"""),
)
def delete_projects(spark, sf_dir):
    """I8: projects of mostly poor documents removed."""
    docs = base.documents(spark, sf_dir)
    poor = (
        docs.join(base.table(spark, sf_dir, "labels"), "doc_id")
        .groupBy("project_id").agg(F.avg("quality").alias("q")).where("q < 0.9")
    )
    left = ing.delete_projects({"chunks": base.text_chunks(spark, sf_dir)}, poor)
    return left["chunks"].select("project_id", "chunk_id")
