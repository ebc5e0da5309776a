from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from support import chunk_rows, questions

from corpuslens.operators import conversations as cv
from corpuslens.operators import evaluation as ev
from corpuslens.operators import logs
from corpuslens.operators import prompts as pr
from corpuslens.plans.evaluate import run_eval, score_run

MESSAGE = "project_id string, conversation_id string, message_id string, created_at int, role string, content string, metadata string"


def said(spark, *rows):
    return spark.createDataFrame([("p", "c", f"m{i}", i, role, text, meta) for i, (role, text, meta) in enumerate(rows)], MESSAGE)


def test_history_is_the_last_messages_oldest_first(spark):
    talk = said(spark, *[("user", f"t{i}", None) for i in range(9)])
    got = [m.content for m in cv.recent_history(talk).first().history]
    assert got == [f"t{i}" for i in range(3, 9)]
    before = cv.history_before(talk.withColumn("turn", F.col("created_at")), 2).where("message_id = 'm5'").first()
    assert [m.content for m in before.history] == ["t3", "t4"]
    # Small buckets: what a message sees does not depend on where a bucket ends.
    plain = cv.history_before(talk.withColumn("turn", F.col("created_at")), 3).collect()
    assert sorted(plain) == sorted(cv.history_before(talk.withColumn("turn", F.col("created_at")), 3, bucket=1).collect())


CANDIDATES = [
    {"document_id": "a", "document_name": "north.docx", "table_index": 0, "caption": "Server list"},
    {"document_id": "b", "document_name": "south_east_plan.docx", "table_index": 1, "caption": None},
]


def plan(**changes):
    body = {"status": "clarification_required", "original_query": "list rows and show table", "pending_facet_index": 1, "preferred_tables_by_facet": {"0": {"document_id": "z", "table_index": 0}}, "candidates": CANDIDATES}
    return json.dumps({"table_query_plan": {**body, **changes}})


@pytest.mark.parametrize(
    "changes, valid",
    [
        ({}, True),
        ({"original_query": " "}, False),
        ({"pending_facet_index": 4}, False),
        ({"pending_facet_index": True}, False),
        ({"preferred_tables_by_facet": {"9": {"document_id": "z", "table_index": 0}}}, False),
        ({"preferred_tables_by_facet": {"0": {"document_id": "z", "table_index": -1}}}, False),
        ({"candidates": []}, False),
    ],
)
def test_pending_plans_are_checked(spark, changes, valid):
    talk = said(spark, ("user", "x", None), ("assistant", "?", plan(**changes)), ("user", "y", None))
    assert cv.validate_pending(cv.pending_clarification(talk)).first().is_valid is valid


@pytest.mark.parametrize(
    "reply, chosen",
    [("2", 1), ("First", 0), ("第二个", 1), ("option 3", None), ("the server list please", 0), ("plan of the south", 1), ("what?", None)],
)
def test_replies(spark, reply, chosen):
    talk = said(spark, ("assistant", "?", plan()))
    row = cv.resolve_confirmation(cv.pending_clarification(talk).withColumn("message", F.lit(reply))).first()
    assert row.chosen_index == chosen
    assert row.effective_question == ("list rows and show table" if chosen is not None else reply)


def test_clarification_labels(spark):
    row = cv.pending_clarification(said(spark, ("assistant", "?", json.dumps({"table_selection": {"status": "ambiguous", "candidates": CANDIDATES}})))).select(
        cv.clarification_text(F.lit("show 表格"), F.col("candidates")).alias("t"), "pending_kind"
    ).first()
    assert row.pending_kind == "single"
    assert row.t == cv.HEADING_ZH + "\n1. north.docx - Server list - table 1\n2. south_east_plan.docx - table 2"


def test_feedback_targets(spark):
    talk = said(spark, ("user", "x", None), ("assistant", "y", None))
    given = spark.createDataFrame([("p", "c", "m0", "useful"), ("p", "c", "m1", "useful"), ("q", "c", "m1", "useful")], "project_id string, conversation_id string, message_id string, rating string")
    got = {(r.project_id, r.message_id): r.reject_reason for r in cv.accept_feedback(given, talk).collect()}
    assert got == {("p", "m0"): "Feedback can only target assistant messages", ("p", "m1"): None, ("q", "m1"): "Message not found"}


def test_prompt_numbers_sources_and_refuses_without(spark):
    chunks = chunk_rows(spark, [("a", 0, "red"), ("b", 0, "blue")])
    results = chunks.withColumn("query_id", F.lit("q")).withColumn("rank", F.when(F.col("document_id") == "a", 1).otherwise(2))
    history = spark.createDataFrame([("q", [("user", "before")])], "query_id string, history array<struct<role:string,content:string>>")
    built = {r.query_id: r for r in pr.build_prompts(questions(spark, [("q", "colour?"), ("none", "?")]), results, history).collect()}
    roles = [(m.role, m.content) for m in built["q"].messages]
    assert [r for r, _ in roles] == ["system", "user", "user"] and roles[-1][1] == "colour?"
    assert roles[0][1].startswith(pr.SYSTEM + "[Source 1]\nchunk_id: a:0\n") and "[Source 2]" in roles[0][1]
    assert built["none"].should_refuse and not built["none"].messages


def test_facet_notes(spark):
    outcomes = spark.createDataFrame([("q", 0, "list a"), ("q", 1, "list b")], "query_id string, facet_index int, facet_query string")
    sources = spark.createDataFrame([("q", 1, [0]), ("q", 2, [0]), ("q", 3, [1])], "query_id string, rank int, facet_indexes array<int>")
    coverage = spark.createDataFrame([("q", True, [0], [(1, 3), (5, 5)], 9), ("q", False, [1], [(1, 2)], 2)], "query_id string, is_partial boolean, facet_indexes array<int>, row_ranges array<struct<first:int,last:int>>, total_rows int")
    note = pr.facet_notes(outcomes, sources, coverage).first().note
    assert note.split("\n")[1:5] == [
        "Facet 1: list a; sources: [Source 1], [Source 2]", "Facet 2: list b; sources: [Source 3]",
        "Facet 1 is partial; provided rows 1-3, 5 of 9.", pr.NOT_COMPLETE,
    ]
    assert "covers data rows 1-3, 5 of 9." in pr.partial_note(coverage).first().note


@pytest.mark.parametrize(
    "answer, notes, match",
    [
        ("The API is reachable", None, True),
        ("Growth of 12% in Q3", "q3; growth", True),
        ("Growth of 12%", "q3; growth", False),
        ("a big red car", "big red fast car", True),
        ("a red car", "big red fast car", False),
        ("API 可达", "api reachability", True),
    ],
)
def test_answer_matching(spark, answer, notes, match):
    rows = spark.createDataFrame([("k", answer, notes)], "k string, answer string, expected_notes string")
    aliases = spark.createDataFrame([("API reachability", ["api 可达"])], "point string, phrases array<string>")
    assert ev.match_answers(rows, "k", aliases).first().notes_matched is match


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"passed": true, "score": 3, "reason": " ok "}', (True, 1.0, "ok", None)),
        ('{"passed": false}', (False, 0.0, "", None)),
        ('{"score": 1}', (None, None, None, ev.BAD_VERDICT)),
        ("yes", (None, None, None, ev.BAD_VERDICT)),
        (None, (None, None, None, None)),
    ],
)
def test_verdicts(spark, raw, want):
    row = ev.parse_verdicts(spark.createDataFrame([(raw,)], "judge_raw_response string")).first()
    assert (row.judge_passed, row.judge_score, row.judge_reason, row.judge_error) == want


QUESTION = "question_id string, question string, project_id string, expected_document_id string, expected_chunk_id string, expected_answer_notes string, should_answer boolean, embedding array<float>"


def test_a_run_scores_every_question(spark):
    asked = spark.createDataFrame(
        [("hit", "?", "p", None, "a:0", "red", True, None), ("miss", "?", "p", "z", None, "red", True, None), ("none", "?", "p", None, None, None, False, None)], QUESTION
    )
    results = spark.createDataFrame([("hit", "a:0", "a"), ("miss", "b:0", "b")], "question_id string, chunk_id string, document_id string")
    answers = spark.createDataFrame([("hit", "Red it is"), ("miss", "red"), ("none", "whatever")], "question_id string, answer string")
    got = {r.question_id: (r.hit, r.citation_covered, r.refused, r.answer_matched, r.score) for r in score_run(asked, results, answers).collect()}
    assert got == {"hit": (True, True, False, True, 1.0), "miss": (False, True, False, True, 0.0), "none": (False, False, True, True, 1.0)}


def test_a_run_without_questions_or_answers_fails(spark):
    chunks = chunk_rows(spark, [("a", 0, "red car", [1.0, 0.0])])
    none = spark.createDataFrame([], "question_id string, answer string")
    with pytest.raises(ValueError):
        run_eval(spark.createDataFrame([], QUESTION), chunks, none)
    asked = spark.createDataFrame([("q", "red", "p", None, None, None, True, [1.0, 0.0])], QUESTION)
    row = run_eval(asked, chunks, none).runs.first()
    assert (row.status, row.question_count) == ("failed", 1)


def test_citations_stay_in_their_project(spark):
    chunks = chunk_rows(spark, [("a", 0, "x" * 300)])
    cited = spark.createDataFrame([("p", "m", 1, "a:0"), ("q", "m", 2, "a:0")], "project_id string, message_id string, rank int, chunk_id string")
    good, wrong = pr.citations(cited, chunks)
    assert [len(r.quote) for r in good.collect()] == [240]
    assert [r.project_id for r in wrong.collect()] == ["q"]


def test_logs_keep_inactive_chunks(spark):
    chunks = chunk_rows(spark, [("a", 0, "y" * 600)]).withColumn("is_active", F.lit(False))
    logged = spark.createDataFrame([("p", "l", "a:0", 1)], "project_id string, retrieval_log_id string, chunk_id string, rank int")
    assert len(logs.log_detail(logged, chunks).first().text_preview) == 500
    assert len(logs.result_view(chunks).first().text_preview) == 300
