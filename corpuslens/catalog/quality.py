"""Evaluation runs, comparison and export over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.catalog import base, search, sqlbase
from corpuslens.catalog.registry import query, with_
from corpuslens.operators import evaluation as ev
from corpuslens.operators import prompts as pr
from corpuslens.plans.evaluate import run_eval
from corpuslens.session import durable
from corpuslens.sources import export as ex

RUNS = ["0", "1", "2", "3"]

# One evaluated result per event: the run is its user modulo eight, the question its number.
_RESULTS_SQL = """results AS (
  SELECT CAST(user_id % 8 AS VARCHAR) AS run_id, CAST(event_id // 8 AS VARCHAR) AS question_id, 'Question ' || (event_id // 8) AS question, event_id AS position,
         event_type IN ('click', 'view') AS hit, event_type <> 'error' AS citation_covered, value > 10 AS answer_matched, event_type = 'signup' AS refused,
         event_id % 2 = 0 AS judge_enabled, CASE WHEN event_id % 4 = 0 THEN value > 8 END AS judge_passed,
         CASE WHEN event_id % 4 = 2 AND event_id % 3 = 0 THEN 'Eval judge returned invalid JSON' END AS judge_error,
         CASE WHEN event_id % 5 > 0 THEN CAST(floor(value) AS INTEGER) END AS retrieval_latency_ms,
         CASE WHEN event_id % 7 > 0 THEN CAST(floor(value * 3) AS INTEGER) END AS generation_latency_ms,
         CASE WHEN event_type IN ('click', 'view') AND value > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM events)"""


def results(spark, sf_dir):
    turn, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    question = F.floor(turn / 8).cast("string")
    return base.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("string").alias("run_id"),
        question.alias("question_id"),
        F.concat(F.lit("Question "), question).alias("question"),
        turn.alias("position"),
        kind.isin("click", "view").alias("hit"),
        (kind != "error").alias("citation_covered"),
        (value > 10).alias("answer_matched"),
        (kind == "signup").alias("refused"),
        (turn % 2 == 0).alias("judge_enabled"),
        F.when(turn % 4 == 0, value > 8).alias("judge_passed"),
        F.when((turn % 4 == 2) & (turn % 3 == 0), F.lit(ev.BAD_VERDICT)).alias("judge_error"),
        F.when(turn % 5 > 0, F.floor(value).cast("int")).alias("retrieval_latency_ms"),
        F.when(turn % 7 > 0, F.floor(value * 3).cast("int")).alias("generation_latency_ms"),
        F.when(kind.isin("click", "view") & (value > 10), 1.0).otherwise(0.0).alias("score"),
    )


# One result per run and question: the first in time.
_UNIQUE_SQL = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, question_id ORDER BY position) AS nth FROM results) WHERE nth = 1)"""


def first_results(spark, sf_dir):
    every = results(spark, sf_dir)
    names = [n for n in every.columns if n not in ("run_id", "question_id")]
    return every.groupBy("run_id", "question_id").agg(
        F.min_by(F.struct(*names), "position").alias("r")
    ).select("run_id", "question_id", "r.*")


def runs(spark, sf_dir):
    """Runs known from the events, and one without any result."""
    known = base.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).cast("string").alias("run_id")).agg(
        F.max("event_id").alias("created_at")
    )
    idle = base.table(spark, sf_dir, "events").agg(F.max("event_id").alias("created_at")).select(
        F.lit("idle").alias("run_id"), "created_at"
    )
    both = known.unionByName(idle)
    mode = F.element_at(F.array(F.lit("hybrid"), F.lit("vector"), F.lit("keyword")), (F.col("created_at") % 3 + 1).cast("int"))
    return both.select(
        "run_id", "created_at", (F.col("created_at") % 4).cast("string").alias("dataset_id"),
        F.lit("completed").alias("status"), mode.alias("retrieval_mode"), (F.col("created_at") % 9 + 1).cast("int").alias("top_k"),
    )


_RUNS_SQL = """runs AS (SELECT *, CAST(created_at % 4 AS VARCHAR) AS dataset_id, 'completed' AS status,
    ['hybrid', 'vector', 'keyword'][created_at % 3 + 1] AS retrieval_mode, CAST(created_at % 9 + 1 AS INTEGER) AS top_k FROM (
  SELECT CAST(user_id % 8 AS VARCHAR) AS run_id, max(event_id) AS created_at FROM events GROUP BY 1
  UNION ALL SELECT 'idle', max(event_id) FROM events))"""

_RATES_SQL = """rates AS (SELECT run_id, count(*) AS question_count, avg(hit::INT) AS hit_rate, avg(citation_covered::INT) AS citation_coverage_rate,
    avg(answer_matched::INT) AS answer_match_rate, avg(refused::INT) AS refusal_rate, coalesce(avg(retrieval_latency_ms), 0.0::DOUBLE) AS avg_retrieval_latency_ms,
    coalesce(avg(judge_passed::INT) FILTER (judge_enabled AND judge_passed IS NOT NULL), 0.0::DOUBLE) AS judge_match_rate FROM results GROUP BY run_id)"""

_RATES = (
    "hit_rate", "citation_coverage_rate", "answer_match_rate", "refusal_rate",
    "avg_retrieval_latency_ms", "judge_match_rate",
)


def _rounded(df, names):
    return df.withColumns({name: F.round(name, 9) for name in names})


@query(
    "run_metrics",
    with_(_RESULTS_SQL, _RUNS_SQL, _RATES_SQL, body="SELECT r.run_id, coalesce(question_count, 0) AS question_count, "
          + ", ".join(f"round(coalesce({n}, 0.0::DOUBLE), 9) AS {n}" for n in _RATES) + " FROM runs r LEFT JOIN rates USING (run_id)"),
)
def run_metrics(spark, sf_dir):
    """Rates per run, zeros for a run without results."""
    return _rounded(ev.run_metrics(results(spark, sf_dir), runs(spark, sf_dir)), _RATES)


@query(
    "filter_counts",
    with_(_RESULTS_SQL, body="""SELECT run_id, 'all' AS filter, count(*) AS matches FROM results GROUP BY run_id
      UNION ALL SELECT run_id, 'failed', count(*) FILTER (score <> 1) FROM results GROUP BY run_id
      UNION ALL SELECT run_id, 'judge_failed', count(*) FILTER (judge_enabled AND (judge_passed = false OR judge_error IS NOT NULL)) FROM results GROUP BY run_id
      UNION ALL SELECT run_id, 'retrieval_miss', count(*) FILTER (NOT hit) FROM results GROUP BY run_id
      UNION ALL SELECT run_id, 'citation_miss', count(*) FILTER (NOT citation_covered) FROM results GROUP BY run_id
      UNION ALL SELECT run_id, 'refused', count(*) FILTER (refused) FROM results GROUP BY run_id"""),
)
def filter_counts(spark, sf_dir):
    """How many results each filter shows."""
    return ev.filter_counts(results(spark, sf_dir))


@query("filter_results", with_(_RESULTS_SQL, body="SELECT run_id, question_id, position FROM results WHERE judge_enabled AND (judge_passed = false OR judge_error IS NOT NULL)"))
def filter_results(spark, sf_dir):
    """Results the judge failed."""
    return ev.filter_results(results(spark, sf_dir), "judge_failed").select("run_id", "question_id", "position")


_COMPARED_SQL = """compared AS (SELECT r.run_id, r.retrieval_mode || ' · top ' || r.top_k AS label, t.* EXCLUDE (run_id, question_count, refusal_rate),
    g.avg_generation_latency_ms, coalesce(g.n, 0) AS result_count FROM runs r LEFT JOIN rates t USING (run_id)
    LEFT JOIN (SELECT run_id, avg(generation_latency_ms) AS avg_generation_latency_ms, count(*) AS n FROM results GROUP BY run_id) g USING (run_id))"""
_COMPARED = (
    "hit_rate", "citation_coverage_rate", "answer_match_rate", "judge_match_rate",
    "avg_retrieval_latency_ms", "avg_generation_latency_ms",
)


def _compared(spark, sf_dir):
    found = results(spark, sf_dir)
    return ev.compare_runs(runs(spark, sf_dir), ev.run_metrics(found), found)


@query("compare_runs", with_(_RESULTS_SQL, _RUNS_SQL, _RATES_SQL, _COMPARED_SQL, body="SELECT run_id, label, result_count, " + ", ".join(f"round({n}, 9) AS {n}" for n in _COMPARED) + " FROM compared"))
def compare_runs(spark, sf_dir):
    """Runs side by side."""
    return _rounded(_compared(spark, sf_dir), _COMPARED).select("run_id", "label", "result_count", *_COMPARED)


_MATRIX_SQL = """questions AS (SELECT question_id, min(question) AS question, min(struct_pack(run := CAST(run_id AS INTEGER) + 1, position := position)) AS seen FROM firsts WHERE run_id IN ('0', '1', '2', '3') GROUP BY question_id),
matrix AS (SELECT q.question_id, q.question, CAST(q.seen.run AS INTEGER) AS seen_run, q.seen.position AS seen_position, r.run_id, f.hit, f.citation_covered, f.score,
    CASE WHEN f.run_id IS NULL THEN 'Missing' WHEN f.refused THEN 'Refused' WHEN f.answer_matched THEN 'Pass' ELSE 'Fail' END AS outcome
  FROM questions q, (SELECT unnest(['0', '1', '2', '3']) AS run_id) r LEFT JOIN firsts f ON f.question_id = q.question_id AND f.run_id = r.run_id)"""


@query("question_matrix", with_(_RESULTS_SQL, _UNIQUE_SQL, _MATRIX_SQL, body="SELECT * FROM matrix"))
def question_matrix(spark, sf_dir):
    """Every question against four runs."""
    return ev.question_matrix(first_results(spark, sf_dir), RUNS).drop(
        "answer_matched", "refused", "judge_passed"
    )


@query(
    "export_run",
    with_(_RESULTS_SQL, _RUNS_SQL, _RATES_SQL, body=" UNION ALL ".join(
        f"SELECT 'run' AS section, r.run_id, retrieval_mode, top_k, status, created_at, '{n}' AS metric, round({n}, 9) AS value FROM runs r LEFT JOIN rates USING (run_id)" for n in ex.RUN_METRICS)),
)
def export_run(spark, sf_dir):
    """Run metrics as long rows."""
    joined = runs(spark, sf_dir).join(ev.run_metrics(results(spark, sf_dir)), "run_id", "left")
    return _rounded(ex.export_run_metrics(joined), ["value"]).select(
        "section", "run_id", "retrieval_mode", "top_k", "status", "created_at", "metric", "value"
    )


@query("export_results", with_(_RESULTS_SQL, body="SELECT run_id, question_id, score, hit, judge_passed, judge_error, CAST(NULL AS VARCHAR) AS answer FROM results"))
def export_results(spark, sf_dir):
    """Result rows."""
    return ex.export_results(results(spark, sf_dir)).select(
        "run_id", "question_id", "score", "hit", "judge_passed", "judge_error", "answer"
    )


@query("export_run_json", with_(_RESULTS_SQL, _RUNS_SQL, body="SELECT run_id, CAST(0 AS INTEGER) AS part, count(*) AS lines FROM runs GROUP BY ALL UNION ALL SELECT run_id, 1, count(*) FROM results GROUP BY ALL"))
def export_run_json(spark, sf_dir):
    """JSON lines per run and result."""
    lines = ex.export_run_json(runs(spark, sf_dir), results(spark, sf_dir))
    return lines.where(F.col("json").startswith("{")).groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "export_compare_metrics",
    with_(_RESULTS_SQL, _RUNS_SQL, _RATES_SQL, _COMPARED_SQL, body=" UNION ALL ".join(
        f"SELECT '{label}' AS metric, " + ", ".join(f"max(CASE WHEN run_id = '{r}' THEN round({n}, 9) END) AS \"{r}\"" for r in RUNS) + " FROM compared" for n, label in ex.COMPARE_METRICS.items())),
)
def export_compare_metrics(spark, sf_dir):
    """Metrics against runs."""
    return _rounded(ex.export_compare_metrics(_compared(spark, sf_dir), RUNS), RUNS)


@query(
    "export_compare_questions",
    with_(_RESULTS_SQL, _UNIQUE_SQL, _MATRIX_SQL, body="SELECT seen_run, seen_position, question_id, question, CAST(0 AS INTEGER) AS \"at\", "
          + ", ".join(f"max(CASE WHEN run_id = '{r}' THEN outcome END) AS \"{r}\"" for r in RUNS) + " FROM matrix GROUP BY ALL"
          + "".join(
              f" UNION ALL SELECT seen_run, seen_position, question_id || ':{row}', '{row}', {i + 1}, "
              + ", ".join(f"max(CASE WHEN run_id = '{r}' THEN CAST({col} AS VARCHAR) END)" for r in RUNS)
              + " FROM matrix GROUP BY seen_run, seen_position, question_id" for i, (row, col) in enumerate((("score", "score"), ("hit", "hit"), ("citation", "citation_covered"))))),
)
def export_compare_questions(spark, sf_dir):
    """Four rows per question against runs."""
    matrix = ev.question_matrix(first_results(spark, sf_dir), RUNS)
    return ex.export_compare_questions(matrix, RUNS)


@query(
    "list_runs",
    with_(_RESULTS_SQL, _RUNS_SQL, body="SELECT r.run_id, dataset_id, created_at, coalesce(n, 0) AS result_count FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM results GROUP BY run_id) USING (run_id)"),
)
def list_runs(spark, sf_dir):
    """Runs with result counts."""
    return ev.list_runs(runs(spark, sf_dir), results(spark, sf_dir)).select("run_id", "dataset_id", "created_at", "result_count")


def _datasets(spark, sf_dir):
    return base.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("dataset_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("updated_at")
    )


def _questions(spark, sf_dir):
    return base.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("question_id"), F.col("c_nationkey").cast("string").alias("dataset_id")
    )


@query("list_datasets", "SELECT CAST(n_nationkey AS VARCHAR) AS dataset_id, n_name AS name, count(c_custkey) AS question_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def list_datasets(spark, sf_dir):
    """Datasets (nations) with question counts (customers)."""
    return ev.list_datasets(_datasets(spark, sf_dir), _questions(spark, sf_dir)).select("dataset_id", "name", "question_count")


@query(
    "delete_datasets",
    """WITH gone AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
      SELECT 'datasets' AS name, count(*) AS n FROM nation WHERE n_nationkey NOT IN (FROM gone)
      UNION ALL SELECT 'questions', count(*) FROM customer WHERE c_nationkey NOT IN (FROM gone)
      UNION ALL SELECT 'runs', count(*) FROM supplier WHERE s_nationkey NOT IN (FROM gone)
      UNION ALL SELECT 'results', count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey NOT IN (FROM gone)""",
)
def delete_datasets(spark, sf_dir):
    """The datasets of one region with questions, runs (suppliers) and results (line items)."""
    runs_ = base.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.col("s_nationkey").cast("string").alias("dataset_id"))
    rows = base.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("run_id")).join(runs_.select("run_id"), "run_id", "left_semi")
    gone = base.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("dataset_id"))
    left = ev.delete_datasets(_datasets(spark, sf_dir), _questions(spark, sf_dir), runs_, rows, gone)
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in zip(("datasets", "questions", "runs", "results"), left)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("delete_questions", "SELECT CAST(c_nationkey AS VARCHAR) AS dataset_id, CAST(c_custkey AS VARCHAR) AS question_id FROM customer WHERE c_acctbal >= 0")
def delete_questions(spark, sf_dir):
    """Questions of overdrawn customers removed."""
    gone = base.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("question_id"))
    asked = _questions(spark, sf_dir)
    return ev.delete_questions(asked, asked.select("question_id"), gone)[0].select("dataset_id", "question_id")


_ANSWERS_SQL = """answers AS (SELECT doc_id, text, CASE WHEN doc_id % 23 > 0 THEN CASE doc_id % 6 WHEN 0 THEN 'Sorry, I CANNOT answer this. ' WHEN 1 THEN '没有相关信息 ' ELSE '' END || text END AS answer,
    list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
noted AS (SELECT doc_id, answer, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE array_to_string(list_filter(w, lambda x, i: i % 7 = 1), ' ') || ' ; ' || CASE WHEN doc_id % 3 = 0 THEN 'zzz ' ELSE '' END || array_to_string(list_filter(w, lambda x, i: i % 11 = 2), '  ') || chr(10) || ' ' || CASE WHEN doc_id % 5 = 0 THEN 'Alias Point' ELSE coalesce(w[1], '') END END AS expected_notes FROM answers)"""


def _answers(spark, sf_dir):
    turn = F.col("doc_id")
    w = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    lead = F.when(turn % 6 == 0, "Sorry, I CANNOT answer this. ").when(turn % 6 == 1, "没有相关信息 ").otherwise("")
    last = F.when(turn % 5 == 0, "Alias Point").otherwise(F.coalesce(F.get("w", F.lit(0)), F.lit("")))
    notes = F.concat(
        F.array_join(F.filter("w", lambda x, i: i % 7 == 0), " "), F.lit(" ; "), F.when(turn % 3 == 0, "zzz ").otherwise(""),
        F.array_join(F.filter("w", lambda x, i: i % 11 == 1), "  "), F.lit("\n "), last,
    )
    return base.table(spark, sf_dir, "documents").withColumn("w", w).select(
        turn, F.when(turn % 23 > 0, F.concat(lead, "text")).alias("answer"), F.when(turn % 4 > 0, notes).alias("expected_notes")
    )


@query("refusals", with_(_ANSWERS_SQL, body="SELECT doc_id, coalesce(contains(lower(answer), 'cannot answer') OR contains(lower(answer), 'can''t answer') OR contains(answer, '没有相关信息') OR contains(answer, '无法回答'), false) AS refused FROM noted"))
def refusals(spark, sf_dir):
    """Answers that refuse."""
    return _answers(spark, sf_dir).select("doc_id", ev.is_refusal(F.col("answer")).alias("refused"))


@query(
    "answer_matches",
    with_(_ANSWERS_SQL, f"""pts AS (SELECT doc_id, trim(regexp_replace({sqlbase.fold("answer")}, '\\s+', ' ', 'g')) AS a, trim(regexp_replace({sqlbase.fold("p")}, '\\s+', ' ', 'g')) AS p FROM (
            SELECT doc_id, coalesce(answer, '') AS answer, unnest(regexp_split_to_array(expected_notes, '[;\\n]+')) AS p FROM noted)),
          judged AS (SELECT doc_id, contains(a, p) OR (p = 'alias point' AND contains(a, 'the')) OR (len(t) > 0 AND len(list_filter(t, lambda x: contains(a, x))) >= CASE WHEN len(t) <= 2 THEN len(t) ELSE len(t) - 1 END) AS ok
            FROM (SELECT *, regexp_extract_all(p, '[a-z0-9][a-z0-9_+.-]*') AS t FROM pts WHERE p <> ''))""",
          body="SELECT n.doc_id, coalesce(j.ok, true) AS notes_matched FROM noted n LEFT JOIN (SELECT doc_id, bool_and(ok) AS ok FROM judged GROUP BY doc_id) j USING (doc_id)"),
)
def answer_matches(spark, sf_dir):
    """Expected points by phrase, alias or words."""
    aliases = base.table(spark, sf_dir, "region").agg(F.count(F.lit(1))).select(
        F.lit("Alias point").alias("point"), F.array(F.lit("The")).alias("phrases")
    )
    return ev.match_answers(_answers(spark, sf_dir), "doc_id", aliases).select("doc_id", "notes_matched")


_VERDICT_SQL = """raw AS (SELECT event_id, value, event_id % 12 AS kind FROM events)"""


@query(
    "parse_verdicts",
    with_(_VERDICT_SQL, body="""SELECT event_id,
      CASE WHEN kind IN (0, 1) THEN value > 10 WHEN kind IN (2, 6, 7) THEN true WHEN kind IN (8, 9) THEN false END AS judge_passed,
      CASE WHEN kind = 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(floor(value) AS DOUBLE) - 9))
           WHEN kind = 1 THEN CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
           WHEN kind IN (2, 6, 7) THEN 1.0::DOUBLE WHEN kind = 8 THEN 0.0::DOUBLE WHEN kind = 9 THEN 0.25::DOUBLE END AS judge_score,
      CASE WHEN kind = 0 THEN 'fine' WHEN kind IN (1, 2, 6, 7, 8, 9) THEN '' END AS judge_reason,
      CASE WHEN kind IN (3, 4, 10, 11) THEN 'Eval judge returned invalid JSON' END AS judge_error FROM raw"""),
)
def parse_verdicts(spark, sf_dir):
    """Judge replies, well formed or not; values count by their type."""
    kind = F.col("event_id") % 12
    passed = (F.col("value") > 10).cast("string")
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"passed": '), passed, F.lit(', "score": '), (F.floor("value") - 9).cast("string"), F.lit(', "reason": " fine "}')))
        .when(kind == 1, F.concat(F.lit('{"passed": '), passed, F.lit("}")))
        .when(kind == 2, '{"passed": 1}').when(kind == 3, '{"score": 1}').when(kind == 4, "yes, it is right")
        .when(kind == 6, '{"passed": "false"}').when(kind == 7, '{"passed": true, "score": true}')
        .when(kind == 8, '{"passed": null}').when(kind == 9, '{"passed": [], "score": "0.25"}')
        .when(kind == 10, '{"passed": true, "score": [1]}').when(kind == 11, "[true]")
    )
    rows = base.table(spark, sf_dir, "events").select("event_id", raw.alias("judge_raw_response"))
    return ev.parse_verdicts(rows).drop("judge_raw_response")


@query(
    "question_scores",
    with_(_RESULTS_SQL, body="""SELECT position, CASE WHEN hit THEN answer_matched ELSE refused END AS answer_matched,
      CASE WHEN hit THEN CASE WHEN hit AND citation_covered AND coalesce(judge_passed, answer_matched) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
           ELSE CASE WHEN coalesce(judge_passed, refused) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM results"""),
)
def question_scores(spark, sf_dir):
    """The score of every question."""
    rows = results(spark, sf_dir).withColumnRenamed("answer_matched", "notes_matched").withColumn("should_answer", F.col("hit"))
    return ev.question_scores(rows).select("position", "answer_matched", "score")


_EXPECTED_SQL = """expected AS (SELECT q.query_id, q.project_id, CASE WHEN q.item_id % 3 = 0 THEN m.document_id || ':1:0' END AS expected_chunk_id, CASE WHEN q.item_id % 3 < 2 THEN m.document_id END AS expected_document_id
  FROM queries q LEFT JOIN (SELECT source AS project_id, CAST(min(doc_id) AS VARCHAR) AS document_id FROM documents GROUP BY source) m USING (project_id))"""


def eval_questions(spark, sf_dir):
    """Benchmark queries that expect a chunk, a document, or anything of their project."""
    first = base.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(F.min("doc_id").cast("string").alias("doc"))
    turn = F.col("item_id") % 3
    return base.queries(spark, sf_dir).join(first, "project_id", "left").select(
        F.col("query_id").alias("question_id"), F.col("query").alias("question"), "project_id", "embedding", "item_id",
        F.when(turn == 0, F.concat("doc", F.lit(":1:0"))).alias("expected_chunk_id"),
        F.when(turn < 2, F.col("doc")).alias("expected_document_id"),
    )


@query(
    "eval_hits",
    with_(sqlbase.KEYWORD, sqlbase.VECTOR, sqlbase.fused(search.POOL), _EXPECTED_SQL,
          f"top_ AS (SELECT * FROM fused WHERE rank <= {search.TOP})",
          body="""SELECT e.query_id AS question_id, CASE WHEN expected_chunk_id IS NOT NULL THEN coalesce(bool_or(t.chunk_id = expected_chunk_id), false)
            WHEN expected_document_id IS NOT NULL THEN coalesce(bool_or(t.document_id = expected_document_id), false) ELSE count(t.chunk_id) > 0 END AS hit,
            CASE WHEN expected_chunk_id IS NOT NULL THEN coalesce(bool_or(t.chunk_id = expected_chunk_id AND t.rank <= 3), false) ELSE count(t.chunk_id) FILTER (t.rank <= 3) > 0 END AS citation_covered
            FROM expected e LEFT JOIN top_ t USING (query_id) GROUP BY e.query_id, expected_chunk_id, expected_document_id"""),
)
def eval_hits(spark, sf_dir):
    """Expectations met by hybrid results, the first three cited."""
    found = durable(search._fused(spark, sf_dir, search.TOP)).withColumnRenamed("query_id", "question_id")
    return ev.hits_and_citations(eval_questions(spark, sf_dir), found, found.where("rank <= 3")).select(
        "question_id", "hit", "citation_covered"
    )


@query(
    "check_expectations",
    with_(sqlbase.CHUNKS, sqlbase.QUERIES, """asked AS (SELECT l.doc_id, d.source AS project_id, CASE WHEN l.doc_id % 3 = 0 THEN CAST(l.doc_id + 1 AS VARCHAR) ELSE CAST(l.doc_id AS VARCHAR) END AS ed,
            CASE WHEN l.doc_id % 4 = 0 THEN l.doc_id || ':1:' || (l.doc_id % 3) END AS ec FROM labels l JOIN documents d USING (doc_id))""",
          body="""SELECT a.doc_id, CASE WHEN d.document_id IS NULL THEN 'Expected document does not belong to this project' WHEN ec IS NOT NULL AND c.chunk_id IS NULL THEN 'Expected chunk does not belong to this project' END AS reject_reason
            FROM asked a LEFT JOIN docs d ON d.project_id = a.project_id AND d.document_id = a.ed LEFT JOIN chunks c ON c.project_id = a.project_id AND c.chunk_id = a.ec"""),
)
def check_expectations(spark, sf_dir):
    """Expectations outside their project are rejected."""
    docs = base.documents(spark, sf_dir)
    turn = F.col("doc_id")
    asked = base.table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id").select(
        "doc_id", "project_id",
        F.when(turn % 3 == 0, (turn + 1).cast("string")).otherwise(turn.cast("string")).alias("expected_document_id"),
        F.when(turn % 4 == 0, F.concat_ws(":", turn, F.lit(1), turn % 3)).alias("expected_chunk_id"),
    )
    return ev.check_expectations(asked, docs, base.text_chunks(spark, sf_dir)).select("doc_id", "reject_reason")


@query(
    "citations",
    with_(sqlbase.CHUNKS, body="""SELECT 'm' || document_id AS message_id, chunk_id, CAST(chunk_index + 1 AS INTEGER) AS citation_index, substring(text, 1, 240) AS quote FROM chunks WHERE CAST(document_id AS BIGINT) % 5 > 0"""),
)
def citations(spark, sf_dir):
    """M9: quotes of cited chunks; every fifth document is cited from a wrong project."""
    chunks = base.text_chunks(spark, sf_dir)
    wrong = F.col("document_id").cast("long") % 5 == 0
    cited = chunks.select(
        F.when(wrong, "elsewhere").otherwise(F.col("project_id")).alias("project_id"),
        F.concat(F.lit("m"), "document_id").alias("message_id"), (F.col("chunk_index") + 1).alias("rank"), "chunk_id",
    )
    return pr.citations(cited, chunks)[0].select("message_id", "chunk_id", "citation_index", "quote")


@query(
    "citation_violations",
    with_(sqlbase.CHUNKS, body="SELECT 'm' || document_id AS message_id, chunk_id, 'Citation chunk must belong to the same project' AS error_message FROM chunks WHERE CAST(document_id AS BIGINT) % 5 = 0"),
)
def citation_violations(spark, sf_dir):
    """M9: citations of chunks from another project."""
    chunks = base.text_chunks(spark, sf_dir)
    wrong = F.col("document_id").cast("long") % 5 == 0
    cited = chunks.select(
        F.when(wrong, "elsewhere").otherwise(F.col("project_id")).alias("project_id"),
        F.concat(F.lit("m"), "document_id").alias("message_id"), (F.col("chunk_index") + 1).alias("rank"), "chunk_id",
    )
    return pr.citations(cited, chunks)[1].select("message_id", "chunk_id", "error_message")


@query(
    "prompt_sources",
    with_(sqlbase.CHUNKS, sqlbase.QUERIES, sqlbase.VECTOR,
          body="""SELECT q.query_id, v.n IS NULL AS should_refuse, CAST(CASE WHEN v.n IS NULL THEN 0 ELSE 2 END AS INTEGER) AS messages, coalesce(v.n, 0) AS sources
            FROM queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM vector_ranked WHERE rank <= 8 GROUP BY ALL) v USING (query_id)"""),
)
def prompt_sources(spark, sf_dir):
    """M6: prompts over vector results; questions without any are refused."""
    asked = base.queries(spark, sf_dir)
    built = pr.build_prompts(asked, search._with_text(spark, sf_dir, search._vector(spark, sf_dir, search.TOP)).drop("query"))
    content = F.coalesce(F.get("messages", F.lit(0))["content"], F.lit(""))
    return built.select(
        "query_id", "should_refuse", F.size("messages").alias("messages"),
        F.size(F.regexp_extract_all(content, F.lit(r"(?m)^\[Source \d+\]$"), F.lit(0))).cast("long").alias("sources"),
    )


@query(
    "answer_routes",
    """WITH q AS (SELECT event_id, event_id % 5 AS k, event_type FROM events)
      SELECT CAST(event_id AS VARCHAR) AS query_id, CASE WHEN k = 1 THEN 'clarification' WHEN k = 2 THEN 'refusal' ELSE 'generate' END AS route,
        CASE WHEN k = 1 THEN 'clarification_required' WHEN k = 3 THEN 'ready' WHEN k = 2 THEN 'unresolved' END AS plan_status,
        CASE WHEN k = 1 THEN 'local-table-clarification' WHEN k = 2 THEN 'local-refusal' ELSE event_type END AS model FROM q""",
)
def answer_routes(spark, sf_dir):
    """M8: ask, refuse or answer, one request per event."""
    turn = F.col("event_id") % 5
    events = base.table(spark, sf_dir, "events").withColumn("query_id", F.col("event_id").cast("string"))
    prompts = events.select("query_id", (turn == 2).alias("should_refuse"))
    plans = events.select(
        "query_id", F.when(turn.isin(1, 2, 3), 2).otherwise(1).alias("facet_count"), (turn == 3).alias("can_generate"),
        (turn == 1).alias("requires_clarification"), F.lit("which one?").alias("clarification"),
    )
    answers = events.select("query_id", F.col("props").alias("answer"), F.col("event_type").alias("model"))
    return pr.answer_route(prompts, plans, answers).select("query_id", "route", "plan_status", "model")


@query(
    "evaluation_run",
    with_(sqlbase.KEYWORD, sqlbase.VECTOR, sqlbase.fused(search.POOL), search.EVIDENCE_SQL, _EXPECTED_SQL,
          f"""sources AS (SELECT query_id, chunk_id, document_id FROM needs WHERE need <= {search.TOP}),
          met AS (SELECT e.query_id, CAST(e.query_id AS BIGINT) % 4 > 0 AS should_answer, count(s.chunk_id) = 0 AS refused,
            CASE WHEN expected_chunk_id IS NOT NULL THEN coalesce(bool_or(s.chunk_id = expected_chunk_id), false)
              WHEN expected_document_id IS NOT NULL THEN coalesce(bool_or(s.document_id = expected_document_id), false) ELSE count(s.chunk_id) > 0 END AS hit,
            CASE WHEN expected_chunk_id IS NOT NULL THEN coalesce(bool_or(s.chunk_id = expected_chunk_id), false) ELSE count(s.chunk_id) > 0 END AS citation_covered
            FROM expected e LEFT JOIN sources s USING (query_id) GROUP BY e.query_id, expected_chunk_id, expected_document_id)""",
          body="""SELECT 'run-1' AS run_id, query_id AS question_id, hit, citation_covered, refused,
            CASE WHEN should_answer THEN NOT refused ELSE refused END AS answer_matched,
            CASE WHEN NOT should_answer OR (hit AND citation_covered) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM met"""),
)
def evaluation_run(spark, sf_dir):
    """All benchmark questions retrieved, answered from a table and scored."""
    asked = eval_questions(spark, sf_dir).withColumn("should_answer", F.col("item_id") % 4 > 0).withColumn(
        "expected_answer_notes", F.col("question")
    )
    answers = base.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("answer"),
        F.lit('{"passed": true, "score": 1, "reason": "ok"}').alias("judge_raw_response"),
    )
    chunks = durable(base.embedded_chunks(spark, sf_dir))
    done = run_eval(asked, chunks, answers, "run-1", judge_enabled=True)
    return done.results.select("run_id", "question_id", "hit", "citation_covered", "refused", "answer_matched", "score")
