"""Choosing and expanding the table a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import intent
from corpuslens.functions import text as tx
from corpuslens.functions.joins import join_small
from corpuslens.functions.ordered import top_per_key
from corpuslens.schema import PARENT_KINDS, TABLE_KINDS
from corpuslens.session import durable

# Weights and limits of table scoring, and header words that mean the same.
MIN_SCORE = 0.15
MIN_GAP = 0.15
SHOWN_CANDIDATES = 4
WEIGHTS = {"filename": 3.0, "caption": 2.0, "headers": 2.0, "retrieval": 2.0, "list_intent": 1.0}
CONTEXT_BUDGET = 1500
CONCEPTS = (
    ("server", "服务器", "主机"),
    ("host", "主机"),
    ("account", "账号"),
    ("username", "user name", "用户名", "用户"),
    ("password", "密码"),
    ("service", "服务"),
    ("node", "节点"),
    ("instance", "实例"),
)
NO_TABLES = "no table candidates in pool"
CONFIRMED = "selected from recent clarification"
GONE = "confirmed table is no longer available"
EMPTY = "selected table expansion returned no chunks"

FACET = ("query_id", "facet_index")


def normalise_name(name: Column) -> Column:
    stem = F.regexp_replace(name, r"(?s)\.[^.]*$", "")
    return tx.casefold(F.trim(F.regexp_replace(stem, r"(?U)[_\-\s]+", " ")))


def normalise_text(value: Column) -> Column:
    split = F.regexp_replace(value, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return tx.casefold(F.trim(F.regexp_replace(split, r"(?U)[_\-\s]+", " ")))


def match_tokens(normalised: Column) -> Column:
    return F.array_distinct(tx.find_all(normalised, r"[a-z0-9]+|[\u3400-\u9fff]+"))


def _long_tokens(normalised: Column) -> Column:
    return F.filter(match_tokens(normalised), lambda t: F.char_length(t) >= 3)


def _asked_concepts(query: Column) -> Column:
    """Patterns of the concepts a normalised question has."""
    compact = F.replace(query, F.lit(" "), F.lit(""))
    patterns = ["|".join(word.replace(" ", "") for word in words) for words in CONCEPTS]
    return F.filter(
        F.array(*[F.when(compact.rlike(pattern), pattern) for pattern in patterns]), lambda p: p.isNotNull()
    )


def header_match(
    query: Column, header: Column, mine: Column | None = None, concepts: Column | None = None
) -> Column:
    """1.0 phrase or equal word, 0.9 common start, 0.8 same concept, else 0.  Both normalised.

    ``mine`` and ``concepts``: ``_long_tokens`` and ``_asked_concepts`` of the question, where it meets many headers."""
    mine = _long_tokens(query) if mine is None else mine
    concepts = _asked_concepts(query) if concepts is None else concepts
    theirs = _long_tokens(header)
    starts = F.exists(
        mine, lambda q: F.exists(theirs, lambda h: F.startswith(q, h) | F.startswith(h, q))
    )
    compact_header = F.replace(header, F.lit(" "), F.lit(""))
    concept = (F.size(concepts) > 0) & F.exists(concepts, lambda p: F.rlike(compact_header, p))
    return (
        F.when((header != "") & F.contains(query, header), 1.0)
        .when(F.arrays_overlap(mine, theirs), 1.0)
        .when(starts, 0.9)
        .when(concept, 0.8)
        .otherwise(0.0)
    )


def relevance(mode_is_fused: Column) -> Column:
    """A comparable 0..1 signal from vector, keyword and fused scores."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(c, F.lit(1.0)))
    vector = F.coalesce(clamp(F.col("vector_score")), F.lit(0.0))
    keyword = F.coalesce(
        1.0 - 1.0 / (1.0 + F.greatest(F.col("keyword_score"), F.lit(0.0))), F.lit(0.0)
    )
    absolute = F.greatest(vector, keyword)
    fused = clamp(F.col("fused_score"))
    return (
        F.when(
            mode_is_fused & F.col("fused_score").isNotNull(),
            F.greatest(absolute, F.least(fused, absolute + 0.2)),
        )
        .when(F.col("vector_score").isNotNull(), vector)
        .when(F.col("keyword_score").isNotNull(), keyword)
        .otherwise(F.coalesce(fused, F.lit(0.0)))
    )


def score_tables(candidates: DataFrame) -> DataFrame:
    """Score every (question, document, table) present in a pool.

    Candidates are dealt out before they are scored: the pool may come from one task.
    ``candidates``: facet keys, facet_query, mode, chunk identity, scores, meta, rank."""
    query = normalise_text(F.col("facet_query"))
    pool = (
        candidates.where(F.col("meta.table_index").isNotNull())
        .withColumn("_deal", F.xxhash64(*FACET, "document_id", "meta.table_index"))
        .repartition("_deal")
        .withColumn("_q", query)
        .withColumn("_tokens", match_tokens(F.col("_q")))
        .withColumn("_long", _long_tokens(F.col("_q")))
        .withColumn("_concepts", _asked_concepts(F.col("_q")))
        .withColumn("_caption", normalise_text(F.col("meta.caption")))
        .withColumn(
            "_headers",
            F.transform(
                F.filter("meta.headers", lambda h: F.coalesce(h, F.lit("")) != ""), normalise_text
            ),
        )
        .withColumn(
            "_header_score",
            F.array_max(
                F.transform(
                    "_headers", lambda h: header_match(F.col("_q"), h, F.col("_long"), F.col("_concepts"))
                )
            ),
        )
    )
    by_caption = F.when(
        (F.col("_caption") != "") & F.contains(F.col("_q"), F.col("_caption")), 1.0
    ).when(
        F.exists("_tokens", lambda t: (F.char_length(t) > 2) & F.contains(F.col("_caption"), t)), 0.5
    )
    grouped = pool.groupBy(
        "_deal", *FACET, "document_id", F.col("meta.table_index").alias("table_index")
    ).agg(
        F.min_by("document_name", "rank").alias("document_name"),
        F.min("rank").alias("first_rank"),
        F.first("facet_query").alias("facet_query"),
        F.first("_q").alias("asked"),
        F.first("_tokens").alias("asked_tokens"),
        F.min_by(
            "meta.caption",
            F.when(F.coalesce("meta.caption", F.lit("")) != "", F.col("rank")),
        ).alias("caption"),
        F.coalesce(F.max(by_caption), F.lit(0.0)).alias("caption_score"),
        F.coalesce(F.max("_header_score"), F.lit(0.0)).alias("header_score"),
        F.max(relevance(F.col("mode") == "hybrid")).alias("retrieval_score"),
    )
    name = normalise_name(F.col("document_name"))
    name_tokens = F.array_distinct(F.filter(F.split("_name", " "), lambda t: t != ""))
    shared = F.size(F.array_intersect(name_tokens, F.col("asked_tokens")))
    by_name = (
        F.when(F.contains(F.col("asked"), F.col("_name")), 1.0)
        .when(shared > 0, shared / F.greatest(F.size(name_tokens), F.lit(1)) * 0.8)
        .otherwise(0.0)
    )
    listing = (
        F.when(intent.domain_list(F.col("facet_query")), 1.0)
        .when(intent.is_full_table(F.col("facet_query")), 0.5)
        .otherwise(0.0)
    )
    total = (
        F.col("name_score") * WEIGHTS["filename"]
        + F.col("caption_score") * WEIGHTS["caption"]
        + F.col("header_score") * WEIGHTS["headers"]
        + F.col("retrieval_score") * WEIGHTS["retrieval"]
        + F.col("intent_score") * WEIGHTS["list_intent"]
    ) / 10.0
    return (
        grouped.withColumn("_name", name)
        .withColumn("name_score", by_name.cast("double"))
        .withColumn("intent_score", listing)
        .withColumn("score", F.round(total, 4))
        .select(
            *FACET,
            "document_id",
            "document_name",
            "table_index",
            "caption",
            "first_rank",
            "name_score",
            "caption_score",
            "header_score",
            F.round("retrieval_score", 3).alias("retrieval_score"),
            "intent_score",
            "score",
        )
    )


def select_tables(facets: DataFrame, scored: DataFrame, gap: float = MIN_GAP) -> DataFrame:
    """One outcome per facet: none, insufficient_score, ambiguous or selected, with the best
    candidates in order."""
    best_first = [F.col("score").desc(), F.col("first_rank")]
    top = top_per_key(scored, FACET, best_first, SHOWN_CANDIDATES, "position")
    shown = F.struct(
        "position", "document_id", "document_name", "table_index", "caption", "score",
        "name_score", "caption_score", "header_score", "retrieval_score", "intent_score",
    )
    listed = top.groupBy(*FACET).agg(F.array_sort(F.collect_list(shown)).alias("candidates"))
    best = F.get("candidates", F.lit(0))
    second = F.get("candidates", F.lit(1))
    distance = best["score"] - second["score"]
    status = (
        F.when(F.col("candidates").isNull(), "none")
        .when(best["score"] < MIN_SCORE, "insufficient_score")
        .when(distance < gap, "ambiguous")
        .otherwise("selected")
    )
    reason = (
        F.when(F.col("status") == "none", NO_TABLES)
        .when(
            F.col("status") == "insufficient_score",
            F.format_string(f"best score %.3f below minimum {MIN_SCORE}", best["score"]),
        )
        .when(
            F.col("status") == "ambiguous",
            F.format_string(f"top candidates too close (gap=%.3f < {gap})", distance),
        )
        .otherwise("selected by scoring")
    )
    return (
        facets.select(*FACET, "facet_query")
        .join(listed, [*FACET], "left")
        .withColumn("status", status)
        .withColumn("reason", reason)
        .withColumn("selected", F.when(F.col("status") == "selected", best))
    )


def plan_outcomes(outcomes: DataFrame) -> DataFrame:
    """Per question: whether every facet is resolved, and what still has to be asked."""
    unresolved = F.when(F.col("status") != "selected", F.col("facet_index"))
    waiting = F.when(F.col("status") == "ambiguous", F.col("facet_index"))
    return outcomes.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("facet_count"),
        F.every(F.col("status") == "selected").alias("can_generate"),
        F.bool_or(F.col("status") == "ambiguous").alias("requires_clarification"),
        F.sort_array(F.collect_list(unresolved)).alias("unresolved_facet_indexes"),
        F.min(waiting).alias("pending_facet_index"),
    )


def table_chunks(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Active chunks of the named tables (project_id, document_id, table_index)."""
    keyed = chunks.where("is_active").withColumn("table_index", F.col("meta.table_index"))
    wanted = tables.select("project_id", "document_id", "table_index").distinct()
    return join_small(keyed, wanted, ["project_id", "document_id", "table_index"])


def prefer_tables(
    outcomes: DataFrame, preferences: DataFrame, chunks: DataFrame, scopes: DataFrame
) -> DataFrame:
    """Let a confirmed table override the choice of its facet while it still has chunks inside
    the question's project and document scope.

    ``preferences``: query_id, facet_index, document_id, table_index; ``scopes``: query_id,
    project_id, scope.  Preferences for facets that do not exist are ignored."""
    asked = preferences.join(scopes.select("query_id", "project_id", "scope"), "query_id")
    alive = (
        table_chunks(chunks, asked)
        .groupBy("project_id", "document_id", "table_index")
        .agg(
            F.min_by("document_name", "chunk_index").alias("document_name"),
            F.min_by("meta.caption", "chunk_index").alias("caption"),
        )
    )
    checked = asked.join(alive, ["project_id", "document_id", "table_index"], "left").select(
        *FACET,
        F.lit(True).alias("_preferred"),
        F.when(
            F.col("document_name").isNotNull()
            & ((F.col("scope") == "") | (F.col("scope") == F.col("document_id"))),
            F.struct(
                F.lit(1).alias("position"), "document_id", "document_name", "table_index",
                "caption", F.lit(1.0).alias("score"),
                *[
                    F.lit(None).cast("double").alias(name)
                    for name in (
                        "name_score", "caption_score", "header_score", "retrieval_score",
                        "intent_score",
                    )
                ],
            ),
        ).alias("_table"),
    )
    preferred = F.coalesce("_preferred", F.lit(False))
    found = F.col("_table").isNotNull()
    return (
        outcomes.join(checked, [*FACET], "left")
        .withColumn("selected", F.when(preferred, F.col("_table")).otherwise(F.col("selected")))
        .withColumn(
            "candidates",
            F.when(preferred & found, F.array("_table"))
            .when(preferred, F.slice("candidates", 1, 0))
            .otherwise(F.col("candidates")),
        )
        .withColumn(
            "status",
            F.when(preferred & found, "selected")
            .when(preferred, "insufficient_score")
            .otherwise(F.col("status")),
        )
        .withColumn(
            "reason",
            F.when(preferred & found, CONFIRMED)
            .when(preferred, GONE)
            .otherwise(F.col("reason")),
        )
        .drop("_preferred", "_table")
    )


def part_order() -> Column:
    """Parents, then headers, then rows, then everything else."""
    kind = F.col("meta.table_chunk_type")
    return (
        F.when(kind.isin(*PARENT_KINDS), 0)
        .when(kind == "table_header", 1)
        .when(kind == "table_row", 2)
        .otherwise(3)
    )


def expansion_order() -> list[Column]:
    """The order of an expanded table: parents by first row, others, rows by number."""
    kind = F.col("meta.table_chunk_type")
    place = F.when(kind.isin(*PARENT_KINDS), 0).when(kind == "table_row", 2).otherwise(1)
    row = F.when(place == 0, F.col("meta.data_row_start")).when(place == 2, F.col("meta.data_row"))
    return [place, F.coalesce(row, F.lit(0)), F.col("chunk_index"), F.col("chunk_id")]


ROWS_PER_SLOT = 1024


def drop_covered(chunks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Drop headers of tables that have a parent, and rows inside a parent's range.

    The range test is an equi join on slots of rows, so no pair outside a slot is formed."""
    keyed = chunks.withColumn("_kind", F.coalesce("meta.table_chunk_type", F.lit("")))
    parents = keyed.where(F.col("_kind").isin(*PARENT_KINDS))
    with_parent = parents.select(*keys).distinct()
    ranges = parents.where(
        (F.col("meta.data_row_start") > 0) & (F.col("meta.data_row_end") > 0)
    ).select(
        *keys,
        F.col("meta.data_row_start").alias("_from"),
        F.col("meta.data_row_end").alias("_to"),
        F.explode(
            F.sequence(
                F.floor(F.col("meta.data_row_start") / ROWS_PER_SLOT),
                F.floor(F.col("meta.data_row_end") / ROWS_PER_SLOT),
            )
        ).alias("_slot"),
    )
    headers = keyed.where(F.col("_kind") == "table_header").join(
        with_parent, [*keys], "left_anti"
    )
    rows = keyed.where(F.col("_kind") == "table_row").withColumn(
        "_slot", F.floor(F.col("meta.data_row") / ROWS_PER_SLOT)
    )
    left = rows.alias("r")
    right = ranges.alias("p")
    inside = [F.col(f"r.{key}") == F.col(f"p.{key}") for key in (*keys, "_slot")]
    inside.append(F.col("r.meta.data_row").between(F.col("p._from"), F.col("p._to")))
    free_rows = left.join(right, inside, "left_anti").drop("_slot")
    others = keyed.where(~F.col("_kind").isin("table_header", "table_row"))
    return others.unionByName(headers).unionByName(free_rows).drop("_kind")


def expand_tables(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """All chunks of each named table without the ones a parent already covers.

    ``part_order`` and ``expansion_order`` give their order; a table is never numbered as a
    whole."""
    return drop_covered(
        table_chunks(chunks, tables), ("project_id", "document_id", "table_index")
    )


def budget_candidates(items: DataFrame, keys: tuple[str, ...], order: list[Column], budget: int) -> DataFrame:
    """The chunks that can matter to first-fit within ``budget`` words.

    Room only shrinks, so once a chunk of some size is skipped every later one of that size is
    skipped too: of each size only the first ``budget / size`` can be kept.  The rest of a table,
    however long, is counted but never brought together."""
    sized = items if "words" in items.columns else items.withColumn("words", tx.word_count(F.col("text")))
    # A chunk without words always fits, so each is a group of its own.
    alone = F.when(F.col("words") == 0, F.col("chunk_id"))
    per_size = Window.partitionBy(*keys, "words", alone).orderBy(*order)
    return (
        sized.withColumn("_nth", F.row_number().over(per_size))
        .where(F.col("_nth") <= max(budget, 1))
        .where(F.col("_nth") * F.col("words") <= budget)
        .drop("_nth")
    )


def first_fit(items: Column, budget: Column) -> Column:
    """Fold ``array<struct<..., words>>`` in order, keeping every item that still fits."""
    start = F.struct(F.lit(0).alias("used"), F.slice(items, 1, 0).alias("kept"))
    return F.aggregate(
        items,
        start,
        lambda state, item: F.when(
            state["used"] + item["words"] <= budget,
            F.struct(
                (state["used"] + item["words"]).alias("used"),
                F.concat(state["kept"], F.array(item)).alias("kept"),
            ),
        ).otherwise(state),
    )


def apply_budget(
    items: DataFrame, keys: tuple[str, ...], order: list[Column], budget: int = CONTEXT_BUDGET
) -> tuple[DataFrame, DataFrame]:
    """(kept chunks with rank, per-key totals and ``is_partial``)."""
    full_order = [part_order(), *order]
    numbered = budget_candidates(items, keys, full_order, budget)
    per_key = Window.partitionBy(*keys).orderBy(*full_order)
    listed = (
        numbered.withColumn("_at", F.row_number().over(per_key))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "words", "chunk_id"))).alias("_items"))
        .withColumn("_fit", first_fit(F.col("_items"), F.lit(budget)))
    )
    totals = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_total"))
    summary = totals.join(
        listed.select(
            *keys, F.col("_fit.used").alias("words_used"), F.size("_fit.kept").alias("chunks_kept")
        ),
        [*keys],
        "left",
    ).select(
        *keys,
        F.coalesce("words_used", F.lit(0)).alias("words_used"),
        F.coalesce("chunks_kept", F.lit(0)).alias("chunks_kept"),
        (F.col("chunk_total") > F.coalesce("chunks_kept", F.lit(0))).alias("is_partial"),
    )
    kept = listed.select(*keys, F.posexplode("_fit.kept").alias("_pos", "_item")).select(
        *keys, F.col("_item.chunk_id").alias("chunk_id"), (F.col("_pos") + 1).alias("rank")
    )
    base = items.drop("rank") if "rank" in items.columns else items
    return base.join(kept, [*keys, "chunk_id"]), summary


def facet_groups(outcomes: DataFrame) -> DataFrame:
    """Each distinct selected table of a question once, with the facets that chose it."""
    chosen = outcomes.where(F.col("selected").isNotNull())
    return chosen.groupBy(
        "query_id",
        F.col("selected.document_id").alias("document_id"),
        F.col("selected.table_index").alias("table_index"),
    ).agg(
        F.sort_array(F.collect_set("facet_index")).alias("facet_indexes"),
        F.min("facet_index").alias("first_facet"),
        F.min_by("selected.document_name", "facet_index").alias("document_name"),
        F.min_by("selected.caption", "facet_index").alias("caption"),
    )


_GROUP_STATE = "struct<left:int,groups:array<struct<facet:int,items:array<struct<_at:int,words:int,chunk_id:string>>,total:int,used:int,kept:array<struct<_at:int,words:int,chunk_id:string>>>>>"


def budget_lists(items: DataFrame, keys: tuple[str, ...], budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Per key: ``items``, the chunks that can matter to a first fit within ``budget``, in order, as
    (_at, words, chunk_id), and ``total``, how many chunks there are.  A list is bounded by the budget
    whatever the size of the table, so it is made once and shared by all questions that chose it."""
    places = ("_part", "_place", "_row", "_index")
    slim = durable(  # without texts; read for the lists and for the totals
        items.select(
            *keys, "chunk_id", tx.word_count(F.col("text")).alias("words"),
            *[c.alias(name) for name, c in zip(places, [part_order(), *expansion_order()], strict=False)],
        )
    )
    order = [F.col(name) for name in (*places, "chunk_id")]
    per_key = Window.partitionBy(*keys).orderBy(*order)
    listed = (
        budget_candidates(slim, keys, order, budget)
        .withColumn("_at", F.row_number().over(per_key))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "words", "chunk_id"))).alias("items"))
    )
    totals = slim.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("total"))
    return totals.join(listed, [*keys], "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<struct<_at:int,words:int,chunk_id:string>>"))
    )


def apply_shared_budget(
    groups: DataFrame, items: DataFrame, budget: int = CONTEXT_BUDGET
) -> tuple[DataFrame, DataFrame]:
    """``share_budget`` over expanded chunks that carry query_id, document_id and table_index."""
    keys = ("query_id", "document_id", "table_index")
    kept, outcome = share_budget(groups, budget_lists(items, keys, budget), keys, budget)
    return items.join(kept.drop("first_facet"), [*keys, "chunk_id"]), outcome


def share_budget(
    groups: DataFrame, lists: DataFrame, on: tuple[str, ...], budget: int = CONTEXT_BUDGET
) -> tuple[DataFrame, DataFrame]:
    """Divide one budget over the tables of a question (at most four).

    Every table first gets an equal share; what is left over is offered, in order, to the tables
    that were cut.  ``groups``: query_id, document_id, table_index, first_facet, facet_indexes and
    what ``lists`` (from ``budget_lists``) is joined on.  A table without chunks counts as partial.
    Returns the kept chunk ids with their rank, and the outcome of each table."""
    keys = ("query_id", "document_id", "table_index")
    listed = groups.join(lists, [*on], "left")
    entry = F.struct(
        F.col("first_facet").alias("facet"),
        F.coalesce("items", F.array().cast("array<struct<_at:int,words:int,chunk_id:string>>")).alias(
            "items"
        ),
        F.coalesce("total", F.lit(0)).alias("total"),
    )
    per_query = (
        listed.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("groups"))
    )
    share = F.floor(F.lit(budget) / F.size("groups")).cast("int")

    def fitted(group: Column, room: Column) -> Column:
        # One entry that stands for the fit, so that it is folded once and not once per field.
        fit = F.array(first_fit(group["items"], room))
        return F.get(
            F.transform(
                fit,
                lambda f: F.struct(
                    group["facet"].alias("facet"),
                    group["items"].alias("items"),
                    group["total"].alias("total"),
                    f["used"].alias("used"),
                    f["kept"].alias("kept"),
                ),
            ),
            F.lit(0),
        )

    shared = per_query.withColumn("groups", F.transform("groups", lambda g: fitted(g, share)))
    left = F.greatest(
        F.lit(budget) - F.aggregate("groups", F.lit(0), lambda t, g: t + g["used"]), F.lit(0)
    )

    def offer(state: Column, group: Column) -> Column:
        cut = (group["total"] > F.size(group["kept"])) & (state["left"] > 0)

        def grown(again: Column) -> Column:
            more = F.greatest(again["used"] - group["used"], F.lit(0))
            return F.struct(
                F.greatest(state["left"] - more, F.lit(0)).alias("left"),
                F.concat(state["groups"], F.array(again)).alias("groups"),
            ).cast(_GROUP_STATE)

        again = F.array(fitted(group, group["used"] + state["left"]))
        return F.when(cut, F.get(F.transform(again, grown), F.lit(0))).otherwise(
            F.struct(
                state["left"].alias("left"),
                F.concat(state["groups"], F.array(group)).alias("groups"),
            ).cast(_GROUP_STATE)
        )

    start = F.struct(left.alias("left"), F.slice("groups", 1, 0).alias("groups")).cast(_GROUP_STATE)
    settled = (
        shared.withColumn("_state", F.aggregate("groups", start, offer))
        .select("query_id", F.explode("_state.groups").alias("g"))
        .select(
            "query_id",
            F.col("g.facet").alias("first_facet"),
            F.col("g.used").alias("words_used"),
            F.col("g.kept").alias("kept"),
            (
                (F.col("g.total") > F.size("g.kept")) | (F.col("g.total") == 0)
            ).alias("is_partial"),
        )
    )
    outcome = groups.join(settled, ["query_id", "first_facet"])
    final = Window.partitionBy("query_id").orderBy("first_facet", "_at")
    kept = (
        outcome.select(*keys, "first_facet", "facet_indexes", F.explode("kept").alias("item"))
        .select(
            *keys, "first_facet", "facet_indexes",
            F.col("item._at").alias("_at"), F.col("item.chunk_id").alias("chunk_id"),
        )
        .withColumn("rank", F.row_number().over(final))
        .drop("_at")
    )
    return kept, outcome.drop("kept")


def companion_budget(
    groups: DataFrame, lists: DataFrame, companions: DataFrame, on: tuple[str, ...], budget: int = CONTEXT_BUDGET
) -> tuple[DataFrame, DataFrame]:
    """One table per question, then the plain text found in its document, within one budget.

    ``companions``: query_id, chunk_id, words, rank, at most a pool per question.  Returns the kept chunk
    ids with their rank and whether they are companions, and per question the words used and
    whether anything was left out."""
    item = F.struct(F.col("rank").cast("int").alias("_at"), "words", "chunk_id")
    beside = companions.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_beside"))
    none = F.array().cast("array<struct<_at:int,words:int,chunk_id:string>>")
    own, more = F.coalesce("items", none), F.coalesce("_beside", none)

    def marked(items: Column, companion: bool) -> Column:
        return F.transform(items, lambda i: i.withField("companion", F.lit(companion)))

    fitted = (
        groups.join(lists, [*on], "left")
        .join(beside, "query_id", "left")
        .withColumn("_fit", first_fit(F.concat(marked(own, False), marked(more, True)), F.lit(budget)))
    )
    summary = fitted.select(
        "query_id",
        F.col("_fit.used").alias("words_used"),
        F.size("_fit.kept").alias("chunks_kept"),
        (F.coalesce("total", F.lit(0)) + F.size(more) > F.size("_fit.kept")).alias("is_partial"),
    )
    kept = fitted.select("query_id", "document_id", "table_index", F.posexplode("_fit.kept").alias("_pos", "_item")).select(
        "query_id", "document_id", "table_index", F.col("_item.chunk_id").alias("chunk_id"),
        F.col("_item.companion").alias("companion"), (F.col("_pos") + 1).alias("rank"),
    )
    return kept, summary


def _merge_ranges(ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Join overlapping and adjoining (first, last) ranges per key."""
    ordered = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranges.withColumn("_new", (F.col("first") > F.coalesce(reach, F.lit(-1)) + 1).cast("int"))
        .withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_island")
    )


def table_coverage(chunks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key: merged row ranges present in ``chunks``, and the largest known row count."""
    row = F.col("meta.data_row")
    first = F.col("meta.data_row_start")
    last = F.col("meta.data_row_end")
    ranged = first.isNotNull() & last.isNotNull() & (first > 0)
    known = F.when(F.coalesce("meta.total_rows", F.lit(0)) > 0, F.col("meta.total_rows")).otherwise(
        F.col("meta.row_count")
    )
    spans = chunks.select(
        *keys,
        F.when(ranged, first).when(row > 0, row).alias("first"),
        F.when(ranged, last).when(row > 0, row).alias("last"),
        F.when(known > 0, known).alias("known"),
    )
    # Ranges are merged within slots of rows, then within slots of slots, then what is left across them:
    # a table of a billion rows is a thousand windows, then one of a thousand rows.
    merged = spans.where(F.col("first").isNotNull()).select(*keys, "first", "last").distinct()
    for rows in (ROWS_PER_SLOT, ROWS_PER_SLOT**2):
        slots = merged.withColumn("_slot", F.floor(F.col("first") / rows))
        merged = _merge_ranges(slots, (*keys, "_slot")).drop("_slot")
    islands = (
        _merge_ranges(merged, keys)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("row_ranges"))
    )
    totals = spans.groupBy(*keys).agg(F.max("known").alias("total_rows"))
    return totals.join(islands, [*keys], "left").withColumn(
        "row_ranges",
        F.coalesce("row_ranges", F.array().cast("array<struct<first:int,last:int>>")),
    )


def not_tabular() -> Column:
    return ~F.coalesce(F.col("meta.table_chunk_type").isin(*TABLE_KINDS), F.lit(False))
