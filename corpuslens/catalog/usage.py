"""Request metrics, listings and conversations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.catalog import base
from corpuslens.catalog.registry import query, with_
from corpuslens.operators import conversations as cv
from corpuslens.operators import metrics as mt

_REQUESTS_SQL = """requests AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(user_id AS VARCHAR) AS project_id, ts AS created_at, event_type AS model,
         CAST(floor(value) AS INTEGER) AS latency_ms, CASE WHEN event_id % 3 > 0 THEN CAST(floor(value / 4) AS INTEGER) END AS retrieval_latency_ms,
         CASE WHEN event_id % 4 > 0 THEN CAST(floor(value / 2) AS INTEGER) END AS generation_latency_ms,
         CAST(props::JSON->>'$.k' AS INTEGER) AS citation_count FROM events)"""


def requests(spark, sf_dir):
    turn = F.col("event_id")
    return base.table(spark, sf_dir, "events").select(
        turn.cast("string").alias("request_id"),
        F.col("user_id").cast("string").alias("project_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("model"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(turn % 3 > 0, F.floor(F.col("value") / 4).cast("int")).alias("retrieval_latency_ms"),
        F.when(turn % 4 > 0, F.floor(F.col("value") / 2).cast("int")).alias("generation_latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("citation_count"),
    )


_MEANS = ("avg_latency_ms", "avg_retrieval_latency_ms", "avg_generation_latency_ms", "avg_citation_count")
_MEANS_SQL = """count(*) AS request_count, round(avg(latency_ms), 9) AS avg_latency_ms, round(avg(retrieval_latency_ms), 9) AS avg_retrieval_latency_ms,
  round(avg(generation_latency_ms), 9) AS avg_generation_latency_ms, round(avg(citation_count), 9) AS avg_citation_count"""


@query("chat_summary", with_(_REQUESTS_SQL, body=f"SELECT project_id, {_MEANS_SQL} FROM requests GROUP BY project_id"))
def chat_summary(spark, sf_dir):
    """K1: counts and mean latencies per project."""
    return mt.chat_summary(requests(spark, sf_dir)).withColumns(
        {name: F.round(name, 9) for name in _MEANS}
    )


@query(
    "recent_requests",
    with_(_REQUESTS_SQL, body="""SELECT project_id, request_id, model, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id
          ORDER BY created_at DESC, request_id) AS INTEGER) AS position FROM requests) WHERE position <= 20"""),
)
def recent_requests(spark, sf_dir):
    """K2: newest requests per project."""
    return mt.recent_requests(requests(spark, sf_dir), 20).select(
        "project_id", "request_id", "model", "position"
    )


@query("recorded_requests", with_(_REQUESTS_SQL, body="SELECT project_id, model, count(*) AS requests FROM requests GROUP BY ALL"))
def recorded_requests(spark, sf_dir):
    """K3: the metrics table written by a stream and read back."""
    from corpuslens.streaming import metrics as sm

    path = _stream_folder(spark)
    requests(spark, sf_dir).write.parquet(f"{path}/in")
    schema = requests(spark, sf_dir).schema
    arriving = spark.readStream.schema(schema).parquet(f"{path}/in")
    sm.record_requests(arriving, f"{path}/out", f"{path}/ckpt").awaitTermination()
    return sm.read_requests(spark, f"{path}/out").groupBy("project_id", "model").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "streamed_chat_summary",
    with_(_REQUESTS_SQL, body=f"""SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, project_id, {_MEANS_SQL} FROM requests
          GROUP BY ALL"""),
)
def streamed_chat_summary(spark, sf_dir):
    """K4: daily summaries of all requests, kept by a stream that reads them in two arrivals."""
    from corpuslens.streaming import metrics as sm

    path = _stream_folder(spark)
    given = requests(spark, sf_dir)
    late = F.col("request_id").cast("long") % 3 == 0
    for part in (given.where(~late), given.where(late)):
        part.write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(given.schema).parquet(f"{path}/in")
        sm.keep_chat_summary(arriving, f"{path}/out", f"{path}/ckpt").awaitTermination()
    return sm.read_chat_summary(spark, f"{path}/out").select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "project_id", "request_count",
        *[F.round(name, 9).alias(name) for name in _MEANS],
    )


def _stream_folder(spark):
    import uuid

    from corpuslens.session import shared_folder

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


_LISTING_SQL = """listing AS (
  SELECT source AS project_id, CAST(d.doc_id AS VARCHAR) AS document_id, 'File-' || (d.doc_id % 37) || '.' || lang AS filename,
         CASE WHEN l.quality = 1 THEN 'indexed' WHEN l.quality = 0 THEN 'failed' WHEN d.doc_id % 2 = 0 THEN 'uploaded' ELSE 'processing' END AS status,
         d.doc_id AS created_at FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _listing(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").join(
        base.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    turn = F.col("doc_id")
    return docs.select(
        F.col("source").alias("project_id"),
        turn.cast("string").alias("document_id"),
        F.concat(F.lit("File-"), (turn % 37).cast("string"), F.lit("."), "lang").alias("filename"),
        F.when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "failed")
        .when(turn % 2 == 0, "uploaded").otherwise("processing").alias("status"),
        turn.alias("created_at"),
    )


@query(
    "corpus_summary",
    with_(_LISTING_SQL, body="""SELECT project_id, count(*) AS total_count, count(DISTINCT filename) AS unique_count,
          count(*) FILTER (status = 'indexed') AS indexed_count, count(*) - count(DISTINCT filename) AS duplicate_count,
          count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status IN ('uploaded', 'processing')) AS pending_count
          FROM listing GROUP BY project_id"""),
)
def corpus_summary(spark, sf_dir):
    """K5: document counts per project."""
    return mt.corpus_summary(_listing(spark, sf_dir))


@query("duplicate_names", with_(_LISTING_SQL, body="SELECT project_id, filename, count(*) AS copies FROM listing GROUP BY ALL HAVING count(*) > 1"))
def duplicate_names(spark, sf_dir):
    """K6: names used more than once."""
    return mt.duplicate_names(_listing(spark, sf_dir))


@query(
    "natural_order",
    with_(_LISTING_SQL, body="""SELECT document_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY
          CAST(regexp_extract(filename, '(\\d+)', 1) AS INTEGER), regexp_extract(filename, '\\.(.*)$', 1), created_at) AS INTEGER) AS position FROM listing"""),
)
def natural_order(spark, sf_dir):
    """K7: the place of every document in its project's natural order."""
    from pyspark.sql import Window

    order = Window.partitionBy("project_id").orderBy(mt.natural_key(F.col("filename")), "created_at")
    return _listing(spark, sf_dir).select("document_id", F.row_number().over(order).alias("position"))


# Letters whose base letter is plain once accents are gone.
_ACCENTED = "À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ"
_NAME_WORDS = (f"([A-Za-z]*[{_ACCENTED}][A-Za-z{_ACCENTED}]*)", "([A-Za-z]+)")


@query(
    "accented_order",
    f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY strip_accents(lower(word)), number, doc_id) AS INTEGER) AS position
      FROM (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id, doc_id % 37 AS number,
          coalesce(nullif(regexp_extract(text, '{_NAME_WORDS[0]}', 1), ''), nullif(regexp_extract(text, '{_NAME_WORDS[1]}', 1), ''), 'untitled') AS word FROM documents)""",
)
def accented_order(spark, sf_dir):
    """K7: documents named by their first accented word (else their first word) and a number, in
    natural order: case and accents do not count."""
    from pyspark.sql import Window

    word = F.coalesce(
        *[F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")) for pattern in _NAME_WORDS], F.lit("untitled")
    )
    named = base.table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("document_id"), "doc_id",
        F.concat(word, F.lit(" "), F.col("doc_id") % 37, F.lit(".txt")).alias("filename"),
    )
    order = Window.partitionBy("project_id").orderBy(mt.natural_key(F.col("filename")), "doc_id")
    return named.select("document_id", F.row_number().over(order).alias("position"))


@query(
    "list_documents",
    with_(_LISTING_SQL, body="""SELECT project_id, document_id, filename, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id
          ORDER BY created_at DESC, document_id) AS INTEGER) AS position FROM listing WHERE status = 'indexed') WHERE position BETWEEN 6 AND 15"""),
)
def list_documents(spark, sf_dir):
    """K8: the same page of every project's indexed documents."""
    return mt.list_documents(_listing(spark, sf_dir), "indexed", 10, 5).select(
        "project_id", "document_id", "filename", "position"
    )


def projects(spark, sf_dir):
    return base.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(
        F.upper(F.first("source")).alias("name"), F.max("doc_id").alias("updated_at")
    )


@query("list_projects", "SELECT source AS project_id, upper(source) AS name, max(doc_id) AS updated_at FROM documents GROUP BY source")
def list_projects(spark, sf_dir):
    """K9: projects by recency."""
    return mt.list_projects(projects(spark, sf_dir))


@query(
    "check_project_names",
    """WITH added AS (SELECT CAST(c_custkey AS VARCHAR) AS project_id, 'SRC' || (c_custkey % 30) AS name, c_custkey AS created_at FROM customer)
       SELECT project_id, CASE WHEN name IN (SELECT upper(source) FROM documents) OR row_number() OVER (PARTITION BY name ORDER BY created_at, project_id) > 1
       THEN 'Project name already exists' END AS reject_reason FROM added""",
)
def check_project_names(spark, sf_dir):
    """K9: new projects whose name is taken."""
    added = base.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("project_id"),
        F.concat(F.lit("SRC"), (F.col("c_custkey") % 30).cast("string")).alias("name"),
        F.col("c_custkey").alias("created_at"),
    )
    return mt.check_project_names(projects(spark, sf_dir), added).select("project_id", "reject_reason")


_MESSAGES_SQL = """messages AS (
  SELECT 'p' || (conv_id % 5) AS project_id, CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS message_id,
         turn AS created_at, role, text AS content,
         CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'compound' WHEN role = 'assistant' AND conv_id % 3 = 1 THEN 'single' END AS asks, conv_id, turn
  FROM conversations)"""


def messages(spark, sf_dir):
    """Conversation turns; assistants of two thirds of the conversations ask which table is meant."""
    conv, turn = F.col("conv_id"), F.col("turn")
    candidate = lambda at: F.struct(
        F.concat(F.lit("d"), (conv + at).cast("string")).alias("document_id"),
        F.concat(F.lit("Report "), (conv + at).cast("string"), F.lit(".docx")).alias("document_name"),
        F.lit(at).alias("table_index"),
        F.when(turn % 2 == at, F.lit("Server list")).alias("caption"),
    )
    candidates = F.array(candidate(0), candidate(1)).alias("candidates")
    compound = F.to_json(
        F.struct(
            F.struct(
                F.lit("clarification_required").alias("status"),
                F.concat(F.lit("list all rows and show table "), conv.cast("string")).alias("original_query"),
                (turn % 6).cast("int").alias("pending_facet_index"),
                F.create_map(
                    F.lit("0"), F.struct(F.lit("d0").alias("document_id"), F.lit(0).alias("table_index"))
                ).alias("preferred_tables_by_facet"),
                candidates,
            ).alias("table_query_plan")
        )
    )
    single = F.to_json(F.struct(F.struct(F.lit("ambiguous").alias("status"), candidates).alias("table_selection")))
    said = F.col("role") == "assistant"
    return base.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("p"), (conv % 5).cast("string")).alias("project_id"),
        conv.cast("string").alias("conversation_id"),
        F.concat_ws("-", conv, F.lpad(turn.cast("string"), 6, "0")).alias("message_id"),
        turn.alias("created_at"),
        "turn",
        "role",
        F.col("text").alias("content"),
        F.when(said & (conv % 3 == 0), compound).when(said & (conv % 3 == 1), single).alias("metadata"),
    )


def _flat(history):
    return F.array_join(F.transform(history, lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")


@query(
    "recent_history",
    with_(_MESSAGES_SQL, body="""SELECT conversation_id, string_agg(role || ':' || content, chr(10) ORDER BY created_at) AS history FROM (
          SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC) AS r FROM messages) WHERE r <= 6 GROUP BY conversation_id"""),
)
def recent_history(spark, sf_dir):
    """M1: last six messages per conversation."""
    return cv.recent_history(messages(spark, sf_dir)).select(
        "conversation_id", _flat("history").alias("history")
    )


@query(
    "history_before",
    with_(_MESSAGES_SQL, body="""SELECT message_id, CAST(len(h) AS INTEGER) AS length, coalesce(array_to_string(h, chr(10)), '') AS history FROM (
          SELECT message_id, list(role || ':' || content) OVER (PARTITION BY conversation_id ORDER BY created_at ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM messages)"""),
)
def history_before(spark, sf_dir):
    """M1 for every message of every conversation."""
    return cv.history_before(messages(spark, sf_dir)).select(
        "message_id",
        F.when(F.col("history").isNotNull(), F.size("history")).alias("length"),
        F.coalesce(_flat("history"), F.lit("")).alias("history"),
    )


_LATEST_SQL = """latest AS (
  SELECT project_id, conversation_id, conv_id, max(turn) AS turn FROM messages WHERE role = 'assistant' GROUP BY ALL),
pending AS (
  SELECT project_id, conversation_id, conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'compound' ELSE 'single' END AS pending_kind
  FROM latest WHERE conv_id % 3 < 2)"""


@query(
    "pending_clarification",
    with_(_MESSAGES_SQL, _LATEST_SQL, body="""SELECT conversation_id, pending_kind,
          CASE WHEN pending_kind = 'compound' THEN 'list all rows and show table ' || conv_id END AS original_query,
          CASE WHEN pending_kind = 'compound' THEN CAST(turn % 6 AS INTEGER) END AS pending_facet_index, CAST(2 AS INTEGER) AS candidates,
          pending_kind = 'single' OR turn % 6 < 4 AS is_valid FROM pending"""),
)
def pending_clarification(spark, sf_dir):
    """M2, M3: what each conversation still asks, and whether that is well formed."""
    return cv.validate_pending(cv.pending_clarification(messages(spark, sf_dir))).select(
        "conversation_id", "pending_kind", "original_query", "pending_facet_index",
        F.size("candidates").alias("candidates"), "is_valid",
    )


@query(
    "resolve_confirmation",
    with_(_MESSAGES_SQL, _LATEST_SQL, """replies AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN 'Second' WHEN 1 THEN 'the report ' || conv_id || ' please'
            WHEN 2 THEN ' 第1个 ' WHEN 3 THEN 'option 3' ELSE 'no idea' END AS message FROM pending),
          chosen AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 END AS i FROM replies)""",
          body="""SELECT conversation_id, CAST(i AS INTEGER) AS chosen_index, 'd' || (conv_id + i) AS document_id,
          CASE WHEN pending_kind = 'compound' AND turn % 6 < 4 AND i IS NOT NULL THEN 'list all rows and show table ' || conv_id ELSE message END AS effective_question FROM chosen"""),
)
def resolve_confirmation(spark, sf_dir):
    """M4: replies matched to the pending candidates."""
    conv = F.col("conversation_id").cast("int")
    message = (
        F.when(conv % 5 == 0, "Second")
        .when(conv % 5 == 1, F.concat(F.lit("the report "), conv.cast("string"), F.lit(" please")))
        .when(conv % 5 == 2, " 第1个 ").when(conv % 5 == 3, "option 3").otherwise("no idea")
    )
    replies = cv.pending_clarification(messages(spark, sf_dir)).withColumn("message", message)
    return cv.resolve_confirmation(replies).select(
        "conversation_id", "chosen_index", F.col("chosen.document_id").alias("document_id"), "effective_question"
    )


@query(
    "clarification_text",
    with_(_MESSAGES_SQL, _LATEST_SQL, body="""SELECT conversation_id, CASE WHEN pending_kind = 'compound' THEN 'Facet requiring clarification: list all rows and show table ' || conv_id || chr(10) ELSE '' END
          || 'I found multiple relevant tables. Please choose one:' || chr(10)
          || '1. Report ' || conv_id || '.docx' || CASE WHEN turn % 2 = 0 THEN ' - Server list' ELSE '' END || ' - table 1' || chr(10)
          || '2. Report ' || (conv_id + 1) || '.docx' || CASE WHEN turn % 2 = 1 THEN ' - Server list' ELSE '' END || ' - table 2' AS text FROM pending"""),
)
def clarification_text(spark, sf_dir):
    """M5: the question put to the user."""
    pending = cv.pending_clarification(messages(spark, sf_dir))
    asked = F.coalesce("original_query", F.lit(""))
    return pending.select(
        "conversation_id",
        F.when(
            F.col("pending_kind") == "compound",
            cv.clarification_text(asked, F.col("candidates"), facet=True),
        ).otherwise(cv.clarification_text(asked, F.col("candidates"))).alias("text"),
    )


@query("conversation_titles", with_(_MESSAGES_SQL, body="SELECT conversation_id, substring(min_by(content, created_at), 1, 80) AS title FROM messages GROUP BY conversation_id"))
def conversation_titles(spark, sf_dir):
    """Titles from first messages."""
    return cv.conversation_titles(messages(spark, sf_dir)).select("conversation_id", "title")


@query(
    "list_conversations",
    with_(_MESSAGES_SQL, body="""SELECT conversation_id, 'Project ' || project_id AS project_name, max(turn) AS updated_at FROM messages GROUP BY ALL
          ORDER BY updated_at DESC, conversation_id LIMIT 50"""),
)
def list_conversations(spark, sf_dir):
    """Recent conversations across projects with the project's name."""
    said = messages(spark, sf_dir)
    listed = said.groupBy("project_id", "conversation_id").agg(F.max("turn").alias("updated_at"))
    names = said.select("project_id").distinct().withColumn(
        "name", F.concat(F.lit("Project "), F.col("project_id"))
    )
    return cv.list_conversations(listed, names, 50).select("conversation_id", "project_name", "updated_at")


@query("conversation_messages", with_(_MESSAGES_SQL, body="SELECT message_id, role, content FROM messages WHERE conv_id % 7 <> 0"))
def conversation_messages(spark, sf_dir):
    """Messages of the asked conversations; every seventh is asked in a wrong project."""
    said = messages(spark, sf_dir)
    wrong = F.col("conversation_id").cast("int") % 7 == 0
    asked = said.select(
        F.when(wrong, "elsewhere").otherwise(F.col("project_id")).alias("project_id"), "conversation_id"
    )
    return cv.conversation_messages(said, asked).select(
        "message_id", "role", "content"
    )


@query(
    "accept_feedback",
    with_(_MESSAGES_SQL, body="""SELECT message_id, CASE WHEN conv_id % 4 = 0 THEN 'Message not found' WHEN role <> 'assistant' THEN 'Feedback can only target assistant messages' END AS reject_reason FROM messages"""),
)
def accept_feedback(spark, sf_dir):
    """Feedback on every message; that of every fourth conversation names a wrong project."""
    said = messages(spark, sf_dir)
    wrong = F.col("conversation_id").cast("int") % 4 == 0
    given = said.select(
        F.when(wrong, "elsewhere").otherwise(F.col("project_id")).alias("project_id"),
        "conversation_id", "message_id", F.lit("useful").alias("rating"),
    )
    return cv.accept_feedback(given, said).select("message_id", "reject_reason")
