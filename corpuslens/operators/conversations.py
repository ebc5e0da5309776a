"""Conversation state: history, pending choices, replies, titles, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.functions.ordered import BUCKET, dense_index, top_per_key

# Lengths, reply patterns and headings.
HISTORY = 6
TITLE_LENGTH = 80
ORDINALS = (
    "1|first|the first one|option 1|table 1|第一个|第一项|第1个",
    "2|second|the second one|option 2|table 2|第二个|第二项|第2个",
    "3|third|the third one|option 3|table 3|第三个|第三项|第3个",
    "4|fourth|the fourth one|option 4|table 4|第四个|第四项|第4个",
)
HEADING_ZH = "我找到了多个可能相关的表格。请指定要查询哪一个："
HEADING_EN = "I found multiple relevant tables. Please choose one:"
FACET_ZH = "需要确认的子问题："
FACET_EN = "Facet requiring clarification: "
MAX_FACETS = 4

CONVERSATION = ("project_id", "conversation_id")
CANDIDATE = "struct<document_id:string,document_name:string,table_index:int,caption:string>"
PENDING = (
    "struct<table_query_plan:struct<status:string,original_query:string,pending_facet_index:int,"
    "preferred_tables_by_facet:map<string,struct<document_id:string,table_index:int>>,"
    f"candidates:array<{CANDIDATE}>>,table_selection:struct<status:string,"
    f"candidates:array<{CANDIDATE}>>>"
)


def recent_history(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last ``n`` messages per conversation, oldest first."""
    newest = [F.col("created_at").desc(), F.col("message_id").desc()]
    kept = top_per_key(messages, CONVERSATION, newest, n)
    item = F.struct("created_at", "message_id", "role", "content")
    return kept.groupBy(*CONVERSATION).agg(
        F.transform(
            F.array_sort(F.collect_list(item)), lambda m: F.struct(m["role"], m["content"])
        ).alias("history")
    )


def history_before(messages: DataFrame, n: int = HISTORY, bucket: int = BUCKET) -> DataFrame:
    """For every message, the ``n`` before it.  ``turn`` is an integer.

    A conversation is cut into buckets of positions; the last ``n`` messages of a bucket are handed to
    the next one as well, and a window of ``n`` rows runs inside each bucket.  So a conversation of any
    length is spread, and contents are moved twice: to find positions, and to their bucket."""
    size = max(bucket, n)
    placed = dense_index(
        messages, CONVERSATION, F.floor(F.col("turn") / 4096), [F.col("turn")], "_at"
    )
    own = F.floor(F.col("_at") / size)
    last = F.col("_at") % size >= size - n
    dealt = placed.select("*", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("_bucket"))
    before = Window.partitionBy(*CONVERSATION, "_bucket").orderBy("_at").rowsBetween(-n, -1)
    earlier = F.collect_list(F.struct("role", "content")).over(before)
    return (
        dealt.withColumn("history", earlier)
        .where(F.col("_bucket") == own)
        .withColumn("history", F.when(F.size("history") > 0, F.col("history")))
        .drop("_at", "_bucket")
    )


def pending_clarification(messages: DataFrame) -> DataFrame:
    """What the latest assistant message of each conversation still asks: a compound plan waiting
    for an answer, or a single choice with candidates.

    ``metadata`` is the JSON kept with a message."""
    latest = (
        messages.where(F.col("role") == "assistant")
        .groupBy(*CONVERSATION)
        .agg(F.max_by("metadata", F.struct("created_at", "message_id")).alias("metadata"))
        .withColumn("m", F.from_json("metadata", PENDING))
    )
    plan, single = F.col("m.table_query_plan"), F.col("m.table_selection")
    compound = plan["status"] == "clarification_required"
    asks = (single["status"] == "ambiguous") & (F.size(single["candidates"]) > 0)
    kind = F.when(compound, "compound").when(asks, "single")
    return latest.select(
        *CONVERSATION,
        kind.alias("pending_kind"),
        F.when(compound, plan["original_query"]).alias("original_query"),
        F.when(compound, plan["pending_facet_index"]).alias("pending_facet_index"),
        F.when(compound, plan["preferred_tables_by_facet"]).alias("preferred_tables_by_facet"),
        F.when(compound, plan["candidates"]).when(asks, single["candidates"]).alias("candidates"),
    ).where(F.col("pending_kind").isNotNull())


def validate_pending(pending: DataFrame) -> DataFrame:
    """Add ``is_valid``: a compound plan is usable only if every part of it is well formed."""
    sound = lambda c: (
        F.coalesce(c["document_id"], F.lit("")) != ""
    ) & F.coalesce(c["table_index"] >= 0, F.lit(False))
    entries = F.map_entries("preferred_tables_by_facet")
    good_keys = F.forall(
        entries,
        lambda e: e["key"].rlike(r"^\d+$")
        & F.coalesce(e["key"].try_cast("int") < MAX_FACETS, F.lit(False))
        & sound(e["value"]),
    )
    valid = (
        (tx.strip(F.coalesce("original_query", F.lit(""))) != "")
        & F.coalesce(F.col("pending_facet_index").between(0, MAX_FACETS - 1), F.lit(False))
        & F.coalesce(good_keys, F.lit(False))
        & F.coalesce(F.size("candidates") > 0, F.lit(False))
        & F.coalesce(F.forall("candidates", sound), F.lit(False))
    )
    return pending.withColumn("is_valid", F.when(F.col("pending_kind") == "single", True).otherwise(valid))


def _plain_words(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[^a-z0-9㐀-鿿]+", " "))


def _tokens(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(col, " "), lambda t: F.char_length(t) > 1))


def chosen_index(message: Column, candidates: Column) -> Column:
    """0-based candidate a reply means: an ordinal, else the first one whose name or caption it
    contains, is part of, or shares two words with; null when there is none."""
    lowered = tx.casefold(tx.strip(message))
    ordinal = F.lit(None).cast("int")
    for at, pattern in reversed(list(enumerate(ORDINALS))):
        ordinal = F.when(lowered.rlike(f"^(?:{pattern})$"), at).otherwise(ordinal)
    reply = _plain_words(lowered)

    def names(label: Column) -> Column:
        stem = F.regexp_replace(F.coalesce(label, F.lit("")), r"(?s)\.[^.]*$", "")
        known = _plain_words(tx.casefold(stem))
        shared = F.size(F.array_intersect(_tokens(reply), _tokens(known)))
        return (known != "") & (F.contains(reply, known) | F.contains(known, reply) | (shared >= 2))

    matching = F.filter(
        F.transform(
            candidates,
            lambda c, at: F.when(names(c["document_name"]) | names(c["caption"]), at),
        ),
        lambda at: at.isNotNull(),
    )
    index = F.coalesce(ordinal, F.get(matching, F.lit(0)))
    return F.when(index < F.size(candidates), index)


def resolve_confirmation(replies: DataFrame) -> DataFrame:
    """Add the table a reply confirms, and the question to go on with: the original one of a
    compound plan once its choice is made, else the reply itself.  A malformed compound plan is no
    plan: its candidates can be confirmed, but the reply stays the question.

    ``replies``: message plus the columns of ``pending_clarification``."""
    if "is_valid" not in replies.columns:
        replies = validate_pending(replies)
    chosen = replies.withColumn(
        "chosen_index", chosen_index(F.col("message"), F.col("candidates"))
    ).withColumn("chosen", F.get("candidates", F.col("chosen_index")))
    resumed = (F.col("pending_kind") == "compound") & F.col("is_valid") & F.col("chosen").isNotNull()
    return chosen.withColumn(
        "effective_question",
        F.when(resumed, F.col("original_query")).otherwise(F.col("message")),
    )


def clarification_text(query: Column, candidates: Column, facet: bool = False) -> Column:
    """Heading in the language of the question and one numbered label per candidate."""
    chinese = query.rlike(r"[㐀-鿿]")
    labels = F.transform(
        candidates,
        lambda c, at: F.concat_ws(
            " - ",
            F.concat((at + 1).cast("string"), F.lit(". "), c["document_name"]),
            F.when(
                (F.coalesce(c["caption"], F.lit("")) != "")
                & ~F.contains(tx.casefold(c["document_name"]), tx.casefold(c["caption"])),
                c["caption"],
            ),
            F.concat(F.lit("table "), (c["table_index"] + 1).cast("string")),
        ),
    )
    heading = F.when(chinese, HEADING_ZH).otherwise(HEADING_EN)
    text = F.concat_ws("\n", heading, F.array_join(labels, "\n"))
    if not facet:
        return text
    lead = F.when(chinese, FACET_ZH).otherwise(FACET_EN)
    return F.concat_ws("\n", F.concat(lead, query), text)


def conversation_titles(messages: DataFrame) -> DataFrame:
    """First 80 characters of the first message."""
    return messages.groupBy(*CONVERSATION).agg(
        F.substring(
            F.min_by("content", F.struct("created_at", "message_id")), 1, TITLE_LENGTH
        ).alias("title")
    )


def list_conversations(
    conversations: DataFrame, projects: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Most recently updated first; across projects with the project's name."""
    listed = conversations
    if projects is not None:
        names = projects.select("project_id", F.col("name").alias("project_name"))
        listed = listed.join(names, "project_id")
    listed = listed.orderBy(F.col("updated_at").desc(), "conversation_id")
    return listed if limit is None else listed.limit(limit)


def conversation_messages(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages of the asked (project_id, conversation_id) pairs, oldest first."""
    return messages.join(asked.select(*CONVERSATION).distinct(), [*CONVERSATION], "left_semi").orderBy(
        *CONVERSATION, "created_at", "message_id"
    )


def accept_feedback(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the message must exist in the same project and conversation and be
    an assistant's."""
    known = messages.select(*CONVERSATION, "message_id", "role")
    joined = feedback.join(known, [*CONVERSATION, "message_id"], "left")
    reason = (
        F.when(F.col("role").isNull(), "Message not found")
        .when(F.col("role") != "assistant", "Feedback can only target assistant messages")
        .when(~F.col("rating").isin("useful", "not_useful"), "rating is unknown")
    )
    return joined.withColumn("reject_reason", reason).drop("role")
