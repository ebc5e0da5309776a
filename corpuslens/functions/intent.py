"""Recognising questions about tables, and splitting compound ones."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import text as tx

# Phrases and patterns that name listing, tables and their rows.  The first group is
# looked for in the question as written, the second in its caseless form.
DOMAIN_PHRASES = (
    "server列表", "服务器列表", "账号列表", "节点列表",
    "主机列表", "服务列表", "配置表", "记录列表",
)
DOMAIN_PATTERNS = (
    r"\bserver\s+list\b", r"\blist\s+of\s+servers\b", r"\bhost\s+list\b", r"\baccount\s+list\b",
)
FULL_PATTERNS_ZH = (
    r"列出.*(?:表格|数据表|配置表|记录表)",
    r"罗列.*(?:表格|数据表|配置表|记录表)",
    r"显示.*(?:表格|数据表|配置表|记录表)",
    r"表格.*(?:列出|全部)",
    r"列出.*记录",
    r"(?:列出|罗列|显示|展示).*(?:数据行|每一行|所有行(?!为)|全部行(?!为)|各行(?!为))",
    "完整表格",
    "表格内容",
    "逐行",
    "全部记录",
    "所有记录",
)
FULL_PATTERNS_EN = (
    r"\blist\s+(all\s+)?(the\s+)?(servers?|rows?|records?|entries?|tables?)\b",
    r"\bshow\s+(all\s+)?(the\s+)?(rows?|tables?|records?)\b",
    r"\bshow\s+the\s+(full\s+)?table\b",
    r"\bcomplete\s+table\b",
    r"\btable\s+contents?\b",
    r"\bevery\s+(row|record|entry)\b",
    r"\ball\s+(rows|records|entries)\b",
)
ACTIONS_ZH = ("列出", "罗列", "显示", "展示")
ACTIONS_EN = (r"\blist\b", r"\bshow\b", r"\bdisplay\b", r"\benumerate\b")
OBJECTS_ZH = (
    "表格", "数据表", "配置表", "记录表", "记录", "条目", "表格内容", "数据行", "每一行",
    r"(?:所有行|全部行|各行)(?!为)",
)
OBJECTS_EN = (
    r"\btable\b", r"\brow\b", r"\brecords?\b", r"\bentries?\b", r"\ball\s+rows\b",
    r"\bevery\s+row\b",
)
NOUNS_ZH = ("服务器", "主机", "账号", "节点", "实例")
NOUNS_EN = ("server", "host", "account", "node", "instance", "record", "entry")
SINGLE_ROW = (
    r"\bwhat\s+is\s+the\b", r"\bfind\s+the\b", r"\blookup\b", r"\bproperties?\s+of\b",
    r"\bdetails?\s+(of|for)\b", r"\battributes?\s+of\b",
)
CONNECTOR = r"(?i)\s+(?:and|also)\s+|(?:以及|并且|同时|和)"
CLAUSE_EDGE = " ,;，；"
MAX_FACETS = 4


def _any(col: Column, patterns: tuple[str, ...]) -> Column:
    return col.rlike("(?U)(?:" + "|".join(patterns) + ")")


def domain_list(query: Column) -> Column:
    return _any(query, DOMAIN_PHRASES) | _any(tx.casefold(query), DOMAIN_PATTERNS)


def is_full_table(query: Column) -> Column:
    """The question asks for a whole table: a listing phrase, or an action with an object."""
    folded = tx.casefold(query)
    action = _any(query, ACTIONS_ZH) | _any(folded, ACTIONS_EN)
    target = reduce(
        or_,
        [
            _any(query, OBJECTS_ZH),
            _any(folded, OBJECTS_EN),
            _any(query, NOUNS_ZH),
            _any(folded, tuple(rf"(?<![a-z]){noun}(?![a-z])" for noun in NOUNS_EN)),
        ],
    )
    return (
        domain_list(query)
        | _any(query, FULL_PATTERNS_ZH)
        | _any(folded, FULL_PATTERNS_EN)
        | (action & target)
    )


def is_table(query: Column) -> Column:
    """The question is about a table, whole or one row."""
    return is_full_table(query) | _any(tx.casefold(query), SINGLE_ROW)


def clauses(query: Column) -> Column:
    return F.filter(
        F.transform(F.split(query, CONNECTOR), lambda c: F.trim(c, F.lit(CLAUSE_EDGE))),
        lambda clause: clause != "",
    )


def facets(query: Column, max_facets: int = MAX_FACETS) -> Column:
    """The clauses of a compound whole-table question, else the question alone."""
    trimmed = tx.strip(query)
    parts = clauses(trimmed)
    compound = (
        F.lit(max_facets >= 2)
        & F.size(parts).between(2, max_facets)
        & F.forall(parts, is_full_table)
    )
    return F.when(compound, parts).otherwise(F.array(trimmed))
