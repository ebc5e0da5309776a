"""Evaluation of answers: hits, citations, refusals, matches, verdicts, run metrics, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators.prompts import NO_ANSWER

# Words of a refusal and of a judge failure.
REFUSALS = (
    NO_ANSWER.lower(), "cannot answer", "can't answer", "无法回答", "无法从当前知识库回答",
    "无法说明", "没有相关信息", "没有关于", "未提及",
)
BAD_VERDICT = "Eval judge returned invalid JSON"
TOKEN = r"[a-z0-9][a-z0-9_+.-]*"
FILTERS = ("all", "failed", "judge_failed", "retrieval_miss", "citation_miss", "refused")
MAX_COMPARED = 4


def is_refusal(answer: Column) -> Column:
    folded = tx.casefold(answer)
    found = F.lit(False)
    for marker in REFUSALS:
        found = found | F.contains(folded, F.lit(marker))
    return F.coalesce(found, F.lit(False))


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(tx.casefold(text), tx.SPACE + "+", " "))


def points(notes: Column) -> Column:
    return F.filter(F.transform(F.split(notes, r"[;\n]+"), tx.strip), lambda p: p != "")


def point_matches(answer: Column, point: Column, aliases: Column) -> Column:
    """Phrase, accepted alias, or nearly all words.  All arguments normalised."""
    tokens = tx.find_all(point, TOKEN)
    found = F.size(F.filter(tokens, lambda t: F.contains(answer, t)))
    need = F.when(F.size(tokens) <= 2, F.size(tokens)).otherwise(F.size(tokens) - 1)
    return (
        F.contains(answer, point)
        | F.coalesce(F.exists(aliases, lambda a: F.contains(answer, a)), F.lit(False))
        | ((F.size(tokens) > 0) & (found >= need))
    )


def match_answers(rows: DataFrame, key: str, aliases: DataFrame | None = None) -> DataFrame:
    """Add ``notes_matched``: every expected point is covered; without notes it is true.

    ``rows``: key, answer, expected_notes; ``aliases``: point, phrases array<string>."""
    # The answer is normalised once per row, before its points are spread.
    prepared = rows.where(F.col("expected_notes").isNotNull()).withColumn(
        "_answer", normalise(F.coalesce("answer", F.lit("")))
    )
    asked = prepared.select(
        key, "_answer", F.explode(points(F.col("expected_notes"))).alias("_raw")
    ).withColumn("_point", normalise(F.col("_raw")))
    if aliases is None:
        asked = asked.withColumn("_aliases", F.lit(None).cast("array<string>"))
    else:
        known = aliases.select(
            normalise(F.col("point")).alias("_point"),
            F.transform("phrases", normalise).alias("_aliases"),
        )
        asked = asked.join(known, "_point", "left")
    verdicts = asked.groupBy(key).agg(
        F.every(point_matches(F.col("_answer"), F.col("_point"), F.col("_aliases"))).alias("_all")
    )
    return rows.join(verdicts, key, "left").withColumn(
        "notes_matched", F.coalesce("_all", F.lit(True))
    ).drop("_all")


def parse_verdicts(rows: DataFrame, raw: str = "judge_raw_response") -> DataFrame:
    """Judge reply to passed, score within 0..1, reason; an unreadable one keeps an error."""
    reply = F.try_parse_json(raw)
    kind = F.coalesce(F.schema_of_variant("_reply"), F.lit(""))
    is_object = kind.startswith("OBJECT")
    value = lambda key, to: F.try_variant_get("_reply", f"$.{key}", to)
    type_of = lambda key: F.schema_of_variant(F.try_variant_get("_reply", f"$.{key}", "variant"))
    has = lambda key: is_object & F.coalesce(
        F.map_contains_key(F.from_json(raw, "map<string,string>"), F.lit(key)), F.lit(False)
    )
    # A value counts by its type: false, null, zero and what is empty are no, all else is yes.
    told, told_kind = value("passed", "string"), F.coalesce(type_of("passed"), F.lit("VOID"))
    number_kinds = told_kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    passed = (
        F.when(told_kind == "BOOLEAN", told == "true")
        .when(told_kind == "VOID", False)
        .when(number_kinds, told.try_cast("double") != 0)
        .otherwise(~told.isin("", "[]", "{}"))
    )
    # A score is a number, a truth value, or text that reads as a number.
    score_kind = F.coalesce(type_of("score"), F.lit("VOID"))
    number = F.when(
        score_kind == "BOOLEAN", F.when(value("score", "string") == "true", 1.0).otherwise(0.0)
    ).otherwise(value("score", "string").try_cast("double"))
    bad = ~has("passed") | (has("score") & number.isNull())
    ok = F.col(raw).isNotNull() & ~bad
    return (
        rows.withColumn("_reply", reply)
        .withColumn("judge_passed", F.when(ok, passed))
        .withColumn(
            "judge_score",
            F.when(
                ok,
                F.greatest(
                    F.lit(0.0),
                    F.least(F.lit(1.0), F.coalesce(number, F.when(passed, 1.0).otherwise(0.0))),
                ),
            ),
        )
        .withColumn("judge_reason", F.when(ok, tx.strip(F.coalesce(value("reason", "string"), F.lit("")))))
        .withColumn("judge_error", F.when(F.col(raw).isNotNull() & bad, F.lit(BAD_VERDICT)))
        .drop("_reply")
    )


def hits_and_citations(questions: DataFrame, results: DataFrame, cited: DataFrame) -> DataFrame:
    """Add ``hit`` and ``citation_covered``.

    ``questions``: question_id, expected_document_id, expected_chunk_id; ``results`` and
    ``cited``: question_id, chunk_id (results also document_id)."""
    want = questions.select("question_id", "expected_document_id", "expected_chunk_id")
    found = (
        results.join(want, "question_id")
        .groupBy("question_id")
        .agg(
            F.bool_or(F.col("chunk_id") == F.col("expected_chunk_id")).alias("_chunk"),
            F.bool_or(F.col("document_id") == F.col("expected_document_id")).alias("_document"),
            F.lit(True).alias("_any"),
        )
    )
    quoted = (
        cited.join(want, "question_id")
        .groupBy("question_id")
        .agg(
            F.bool_or(F.col("chunk_id") == F.col("expected_chunk_id")).alias("_cited_chunk"),
            F.lit(True).alias("_cited_any"),
        )
    )
    no = F.lit(False)
    return (
        questions.join(found, "question_id", "left")
        .join(quoted, "question_id", "left")
        .withColumn(
            "hit",
            F.when(F.col("expected_chunk_id").isNotNull(), F.coalesce("_chunk", no))
            .when(F.col("expected_document_id").isNotNull(), F.coalesce("_document", no))
            .otherwise(F.coalesce("_any", no)),
        )
        .withColumn(
            "citation_covered",
            F.when(F.col("expected_chunk_id").isNotNull(), F.coalesce("_cited_chunk", no)).otherwise(
                F.coalesce("_cited_any", no)
            ),
        )
        .drop("_chunk", "_document", "_any", "_cited_chunk", "_cited_any")
    )


def question_scores(rows: DataFrame) -> DataFrame:
    """Add ``answer_matched`` and ``score``.

    ``rows``: hit, citation_covered, refused, notes_matched, should_answer, judge_passed."""
    matched = F.when(F.col("should_answer"), F.col("notes_matched")).otherwise(F.col("refused"))
    good = F.coalesce("judge_passed", "answer_matched")
    passed = F.when(
        F.col("should_answer"), F.col("hit") & F.col("citation_covered") & good
    ).otherwise(good)
    return rows.withColumn("answer_matched", matched).withColumn(
        "score", F.when(passed, 1.0).otherwise(0.0)
    )


def run_metrics(results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Rates over all questions of a run; the judge rate over judged ones; zeros when empty."""
    rate = lambda name: F.avg(F.coalesce(F.col(name), F.lit(False)).cast("int"))
    judged = F.coalesce("judge_enabled", F.lit(False)) & F.col("judge_passed").isNotNull()
    rates = {
        "hit_rate": rate("hit"),
        "citation_coverage_rate": rate("citation_covered"),
        "answer_match_rate": rate("answer_matched"),
        "refusal_rate": rate("refused"),
        "avg_retrieval_latency_ms": F.avg("retrieval_latency_ms"),
        "judge_match_rate": F.avg(F.when(judged, F.col("judge_passed").cast("int"))),
    }
    metrics = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("question_count"),
        *[F.coalesce(value, F.lit(0.0)).alias(name) for name, value in rates.items()],
    )
    if runs is None:
        return metrics
    return runs.select("run_id").join(metrics, "run_id", "left").fillna(
        0, ["question_count"]
    ).fillna(0.0, list(rates))


def check_expectations(questions: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``reject_reason`` where an expected document or chunk is not in the project."""
    docs = documents.select(
        "project_id", F.col("document_id").alias("expected_document_id"), F.lit(True).alias("_d")
    )
    parts = chunks.select(
        "project_id", F.col("chunk_id").alias("expected_chunk_id"), F.lit(True).alias("_c")
    )
    joined = questions.join(docs, ["project_id", "expected_document_id"], "left").join(
        parts, ["project_id", "expected_chunk_id"], "left"
    )
    missing = lambda id_, mark: F.col(id_).isNotNull() & F.col(mark).isNull()
    return joined.withColumn(
        "reject_reason",
        F.when(
            missing("expected_document_id", "_d"),
            "Expected document does not belong to this project",
        ).when(
            missing("expected_chunk_id", "_c"), "Expected chunk does not belong to this project"
        ),
    ).drop("_d", "_c")


def list_datasets(datasets: DataFrame, questions: DataFrame) -> DataFrame:
    counts = questions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("question_count"))
    return (
        datasets.join(counts, "dataset_id", "left")
        .fillna(0, ["question_count"])
        .orderBy(F.col("updated_at").desc(), "dataset_id")
    )


def list_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    counts = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("result_count"))
    return (
        runs.join(counts, "run_id", "left")
        .fillna(0, ["result_count"])
        .orderBy(F.col("created_at").desc(), "run_id")
    )


def filter_conditions() -> dict[str, Column]:
    no = F.lit(False)
    return {
        "all": F.lit(True),
        "failed": F.coalesce(F.col("score") != 1.0, F.lit(True)),
        "judge_failed": F.coalesce("judge_enabled", no)
        & (F.coalesce(F.col("judge_passed") == no, no) | F.col("judge_error").isNotNull()),
        "retrieval_miss": ~F.coalesce("hit", no),
        "citation_miss": ~F.coalesce("citation_covered", no),
        "refused": F.coalesce("refused", no),
    }


def filter_results(results: DataFrame, name: str) -> DataFrame:
    return results.where(filter_conditions()[name])


def filter_counts(results: DataFrame) -> DataFrame:
    """(run, filter, matches): all six counted in one pass."""
    counted = results.groupBy("run_id").agg(
        *[F.count_if(condition).alias(name) for name, condition in filter_conditions().items()]
    )
    pairs = ", ".join(f"'{name}', `{name}`" for name in FILTERS)
    return counted.selectExpr("run_id", f"stack({len(FILTERS)}, {pairs}) as (filter, matches)")


def run_label(mode: Column, top_k: Column) -> Column:
    return F.concat(mode, F.lit(" · top "), top_k.cast("string"))


def compare_runs(runs: DataFrame, metrics: DataFrame, results: DataFrame) -> DataFrame:
    """One row per run: label, rates, mean generation latency without nulls, result count."""
    counts = results.groupBy("run_id").agg(
        F.avg("generation_latency_ms").alias("avg_generation_latency_ms"),
        F.count(F.lit(1)).alias("result_count"),
    )
    return (
        runs.select("run_id", "status", "created_at", "retrieval_mode", "top_k")
        .join(metrics, "run_id", "left")
        .join(counts, "run_id", "left")
        .fillna(0, ["result_count"])
        .withColumn("label", run_label(F.col("retrieval_mode"), F.col("top_k")))
    )


def cell_outcome(present: Column, refused: Column, matched: Column) -> Column:
    return (
        F.when(~present, "Missing").when(refused, "Refused").when(matched, "Pass").otherwise("Fail")
    )


def question_matrix(results: DataFrame, run_ids: list[str]) -> DataFrame:
    """Every question of the compared runs against each of them (at most four), in the order in
    which the questions first appear; cells without a result are Missing."""
    if len(run_ids) > MAX_COMPARED:
        raise ValueError("at most four runs are compared")
    order = F.array_position(F.array(*[F.lit(run) for run in run_ids]), F.col("run_id"))
    cell = F.struct(
        "run_id", "hit", "citation_covered", "answer_matched", "refused", "judge_passed", "score"
    )
    questions = (
        results.where(F.col("run_id").isin(*run_ids))
        .groupBy("question_id")
        .agg(
            F.min(F.struct(order.alias("run"), F.col("position"))).alias("seen"),
            F.min_by("question", F.struct(order, F.col("position"))).alias("question"),
            F.collect_list(cell).alias("_cells"),
        )
    )
    spread = questions.select(
        "question_id", "question", "seen", "_cells",
        F.explode(F.array(*[F.lit(run) for run in run_ids])).alias("run_id"),
    ).withColumn(
        "_cell", F.get(F.filter("_cells", lambda c: c["run_id"] == F.col("run_id")), F.lit(0))
    )
    return spread.select(
        "question_id",
        "question",
        F.col("seen.run").cast("int").alias("seen_run"),
        F.col("seen.position").alias("seen_position"),
        "run_id",
        *[
            F.col(f"_cell.{name}").alias(name)
            for name in ("hit", "citation_covered", "answer_matched", "refused", "judge_passed", "score")
        ],
        cell_outcome(
            F.col("_cell").isNotNull(), F.col("_cell.refused"), F.col("_cell.answer_matched")
        ).alias("outcome"),
    )


def delete_questions(questions: DataFrame, results: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and their results without the given ones."""
    doomed = gone.select("question_id").distinct()
    return (
        questions.join(doomed, "question_id", "left_anti"),
        results.join(doomed, "question_id", "left_anti"),
    )


def delete_datasets(
    datasets: DataFrame, questions: DataFrame, runs: DataFrame, results: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remove datasets with their questions, runs and results."""
    doomed = gone.select("dataset_id").distinct()
    lost_runs = runs.join(doomed, "dataset_id", "left_semi").select("run_id")
    return (
        datasets.join(doomed, "dataset_id", "left_anti"),
        questions.join(doomed, "dataset_id", "left_anti"),
        runs.join(doomed, "dataset_id", "left_anti"),
        results.join(lost_runs, "run_id", "left_anti"),
    )
