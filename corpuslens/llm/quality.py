"""Quality rules with DataFrame functions only: simple base rules, then a likelihood ratio of hashed
n-grams between a trusted target and the raw corpus.

Words and word pairs of a text are hashed to a fixed number of buckets.  Two multinomials are
counted: one over all trusted documents, one over the whole corpus.  A document's score is its mean log ratio per n-gram; it passes if the score is at least a threshold, which is a
low quantile of the trusted documents' own scores less a margin, so the verdict of every document
follows from its text and the two counts alone.

Words: ``[^\\x20\\x09-\\x0D]+``.  Cases: a null or blank text has no words and fails; a word or text of
any length is taken whole; without trusted documents the ratio is zero and only the base rules
decide; documents without an id count in the corpus and are judged; repeated rows are judged alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import integer_id
from corpuslens.session import durable

BUCKETS = 1 << 14
SMOOTHING = 1.0
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The share of trusted documents that may lie below the threshold, and the margin under it.
TARGET_QUANTILE = 0.002
MARGIN = 0.1
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; splitting leaves an empty string at blank ends."""
    found = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return F.filter(found, lambda w: w != "")


def hashed(found: Column) -> Column:
    """One 64-bit hash per word; n-grams and windows are hashes of these."""
    return F.transform(found, lambda w: F.xxhash64(w))


def n_grams(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and of the word pairs."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text.

    One 64-bit hash per window shows whether any can repeat; only then are windows compared by
    128 bits: sorted by hash and place, equal neighbours mark places, places in order give words."""
    starts = F.when(F.size(hashes) >= window, F.sequence(F.lit(1), F.size(hashes) - window + 1)).otherwise(
        F.array().cast("array<int>")
    )
    one = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(window))))
    keyed = F.array_sort(
        F.transform(
            starts,
            lambda i: F.struct(
                F.xxhash64(F.slice(hashes, i, F.lit(window))).alias("a"),
                F.xxhash64(F.lit(window), F.slice(hashes, i, F.lit(window))).alias("b"),
                i.alias("at"),
            ),
        )
    )
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
    marked = lambda k: F.transform(
        F.filter(k, lambda x, i: same(x, F.get(k, i - 1)) | same(x, F.get(k, i + 1))), lambda x: x["at"]
    )
    covered = F.aggregate(
        F.array_sort(F.flatten(F.transform(F.array(keyed), marked))),
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda s, at: F.struct((s["n"] + F.least(F.lit(window), at - s["last"])).alias("n"), at.alias("last")),
        lambda s: s["n"],
    )
    return F.when(F.size(F.array_distinct(one)) < F.size(one), covered).otherwise(0).cast("long")


def base_rules(text: Column, hashes: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, each as a long."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        "n_repeat_words": repeated_words(hashes),
    }


def _of(rows: DataFrame, trusted: DataFrame, id_col: str) -> DataFrame:
    """The rows whose ``id`` is trusted.  Both sides are dealt by id at every size; a task hashes its
    part of the ids, and texts are not sorted."""
    ids = trusted.select(F.col(f"`{id_col}`").alias("id")).filter("id is not null").distinct()
    return rows.filter("id is not null").join(ids.hint("shuffle_hash"), "id", "left_semi")


def counts(docs: DataFrame, trusted: DataFrame | None, *, id_col: str, text_col: str, buckets: int) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, n): n-gram counts over all documents, and over all trusted ones."""
    rows = docs.select(integer_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))

    def count(rows: DataFrame) -> DataFrame:
        found = rows.select(hashed(words(F.col("text"))).alias("hashes"))
        grams = found.select(F.explode(n_grams(F.col("hashes"), buckets)).alias("bucket"))
        return grams.groupBy("bucket").agg(F.count("*").alias("n"))

    return count(rows), None if trusted is None else count(_of(rows, trusted, id_col))


def ratios(every: DataFrame, trusted: DataFrame | None, buckets: int, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio target / raw of every bucket; each table has ``buckets`` rows at most."""
    import math

    raw, target = [0] * buckets, [0] * buckets
    for found, into in ((trusted, target), (every, raw)):
        for row in found.collect() if found is not None else ():
            into[row["bucket"]] = row["n"]
        if not sum(target):
            return [0.0] * buckets
    a, b = sum(target) + smoothing * buckets, sum(raw) + smoothing * buckets
    return [math.log((t + smoothing) / a) - math.log((r + smoothing) / b) for r, t in zip(raw, target, strict=True)]


def log_ratio(hashes: Column, table: list[float]) -> Column:
    """Mean log ratio of a text's n-grams; 0 without any."""
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    grams = n_grams(hashes, len(table))
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(values, b))
    return F.when(F.size(hashes) > 0, total / F.greatest(2 * F.size(hashes) - 1, F.lit(1))).otherwise(0.0)


def judge(
    docs: DataFrame,
    trusted: DataFrame | None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    quantile: float = TARGET_QUANTILE,
    margin: float = MARGIN,
    threshold: float | None = None,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Per row: the id, the base figures, base_failed, score and kept.  ``trusted`` has the ids of
    the target documents; a given threshold is taken as it is."""
    table = ratios(*counts(docs, trusted, id_col=id_col, text_col=text_col, buckets=buckets), buckets)
    rows = docs.select(integer_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    split = rows.withColumn("hashes", hashed(words(F.col("text"))))
    rules = base_rules(F.col("text"), F.col("hashes"))
    judged = split.select("id", log_ratio(F.col("hashes"), table).alias("score"), *[c.alias(n) for n, c in rules.items()])
    if threshold is None:
        threshold = float("-inf")
        if trusted is not None:
            judged = durable(judged)  # every text is judged once; the quantile reads two columns
            low = _of(judged.select("id", "score"), trusted, id_col).agg(F.percentile_approx("score", quantile, 10_000)).first()[0]
            threshold = float("-inf") if low is None else low - margin
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "score", (~failed & (F.col("score") >= F.lit(threshold))).alias("kept"),
    )
