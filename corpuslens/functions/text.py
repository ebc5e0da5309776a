"""Text expressions: whitespace, case folding and the lexical term kinds.

All of them are built-in column expressions, so tokenising a corpus stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and the patterns and limits that define each term kind.
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SEPARATOR_ID = (
    r"(?<![a-z0-9])(?=[a-z0-9]*[.\-/_+:])[a-z0-9][a-z0-9._\-/:+]*[a-z0-9](?![a-z0-9])"
)
MIXED_WORD = r"(?<![a-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{4,}"
ASCII_TERM = r"[a-z0-9]{2,}"
CJK_RUN = r"[\u4e00-\u9fff]+"
COLLAPSED_SEPARATORS = r"[.\-/_:\s]+"
GRAM = 3
MIN_SIMILAR_LENGTH = 5

def _foldings() -> dict[str, str]:
    """Characters whose caseless form is not their lower case, from the Unicode tables at hand."""
    found = {}
    for point in range(0x80, 0x110000):
        if not 0xD800 <= point < 0xE000:
            char = chr(point)
            if char.casefold() != char.lower():
                found[char] = char.casefold()
    return found


FOLDINGS = _foldings()
_SHORT = "".join(c for c, f in FOLDINGS.items() if len(f) == 1)
_SHORT_TO = "".join(f for f in FOLDINGS.values() if len(f) == 1)
_LONG = {c: f for c, f in FOLDINGS.items() if len(f) > 1 and c != "ß"}
_RARE = "[" + "".join(c for c in FOLDINGS if c != "ß") + "]"
# Where such a letter can stand at all: tested first, as a class of many letters is slow.
_BEYOND = f"[µ{min(c for c in FOLDINGS if c > 'ÿ')}-\U0010ffff]"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(SPACE_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACE_CHARS))


def has_text(col: Column) -> Column:
    """Anything but white space; decided at the first such character."""
    return col.rlike(r"(?U)[^\s\x1c-\x1f]")


def _fold(text: Column) -> Column:
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    spelled = F.create_map(*[F.lit(part) for pair in _LONG.items() for part in pair])
    full = F.array_join(
        F.transform(
            F.split(F.translate(plain, _SHORT, _SHORT_TO), ""),
            lambda char: F.coalesce(F.try_element_at(spelled, char), char),
        ),
        "",
    )
    return (
        F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
        .when(plain.rlike(_BEYOND) & plain.rlike(_RARE), full)
        .otherwise(plain)
    )


def casefold(col: Column) -> Column:
    """Caseless form.  ASCII text, and text without the rarer letters, takes the short way; the
    letters that fold to several are looked up character by character, in texts that have any.

    The text is bound as a lambda variable, so it is evaluated once however often the rule
    mentions it."""
    return F.get(F.transform(F.array(col), _fold), F.lit(0))


def words(col: Column) -> Column:
    return F.filter(F.split(col, SPACE + "+"), lambda word: word != "")


def word_count(col: Column) -> Column:
    """How many ``words`` there are; only the first and the last part of a split can be empty."""
    parts = F.split(col, SPACE + "+")
    count = F.size(parts)
    empty = lambda at: (F.element_at(parts, at) == "").cast("int")
    return count - F.coalesce(empty(1) + F.when(count > 1, empty(-1)).otherwise(0), F.lit(0))


def find_all(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def separator_identifiers(folded: Column) -> Column:
    """Tokens carrying, or followed by, one of ``. - / _ + :``, in order, repeats kept."""
    return find_all(folded, SEPARATOR_ID)


def normalized_identifier(token: Column) -> Column:
    return F.regexp_replace(token, COLLAPSED_SEPARATORS, ".")


def mixed_words(folded: Column) -> Column:
    """Words of four or more characters with both a letter and a digit."""
    return find_all(folded, MIXED_WORD)


def without_separator_identifiers(folded: Column) -> Column:
    return F.regexp_replace(folded, SEPARATOR_ID, " ")


def cjk_terms(text: Column) -> Column:
    """Runs of ideographs followed by their two-character windows, each once."""
    runs = find_all(text, CJK_RUN)
    pairs = F.transform(
        F.filter(runs, lambda run: F.char_length(run) > 1),
        lambda run: F.transform(
            F.sequence(F.lit(1), F.char_length(run) - 1),
            lambda at: F.substring(run, at, F.lit(2)),
        ),
    )
    return F.array_distinct(F.concat(runs, F.flatten(pairs)))


def trigrams(surface: Column) -> Column:
    """Distinct three-character windows; empty below the length from which similarity counts."""
    return F.when(
        F.char_length(surface) >= MIN_SIMILAR_LENGTH,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.char_length(surface) - (GRAM - 1)),
                lambda at: F.substring(surface, at, F.lit(GRAM)),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
