"""Licence scans with DataFrame functions only.

Templates are shingled by five words and sorted into classes by length.  For each class, documents
are cut into overlapping windows that hold any occurrence whole; MinHash values of a window are
banded, and the number of bands follows from the least Jaccard similarity an occurrence can have
with its window, so that a band collides with at least the promised probability.  Windows that
share a band with a template are verified by exact containment of its shingles.

Windows without any shingle of any template cannot hold one and are left out before they are hashed;
this loses nothing.

Words: lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Cases: a null text, or one of fewer than
five words, has no shingle and no match; texts of any length are scanned whole; a template of fewer
than five words is refused; templates of one id are separate rows; repeated rows are reported each;
several windows with equal containment give the first; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.joins import join_small
from corpuslens.llm.common import integer_id
from corpuslens.session import durable

SHINGLE = 5
CONTAINMENT = 0.8
#: A template that is there is missed by all bands with at most this probability.
MISS = 1e-4
#: Template shingles that documents are held against before their windows are hashed.
GATE_SHINGLES = 20_000
#: Words of a stretch in which overlapping hits meet.
STRETCH = 256
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Public licence notices by SPDX id: a line each, id and text.
NOTICES = Path(__file__).with_name("spdx_notices.tsv")
TEMPLATES = tuple(tuple(line.split("\t")) for line in NOTICES.read_text(encoding="utf-8").splitlines())


def templates(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in notices."""
    return spark.createDataFrame([(i, t) for i, t in TEMPLATES], "license_id string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT, -1), lambda w: w != "")


def shingles(found: Column, first: Column, last: Column) -> Column:
    """Shingles that begin at word ``first`` up to ``last`` (from 0, inclusive)."""
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(found, i + 1, F.lit(SHINGLE)), " "))


class Class:
    """Window, stride and bands for templates of ``least`` to ``most`` shingles."""

    def __init__(self, number: int, containment: float, miss: float):
        self.number = number
        self.least, self.most = 1 << number, (2 << number) - 1
        self.stride = max(1, self.most // 4)
        self.window = self.most + self.stride - 1
        # The window holds at least the share of the shortest template, and at most itself.
        shared = math.ceil(containment * self.least - 1e-9)
        self.jaccard = shared / (self.window + self.least - shared)
        self.bands = 1 if self.jaccard >= 1 else math.ceil(math.log(miss) / math.log(1 - self.jaccard))

    def signature(self, hashes: Column) -> Column:
        """One value per band: the least mixed hash, told apart by class and band."""
        return F.transform(
            F.sequence(F.lit(1), F.lit(self.bands)),
            lambda b: F.xxhash64(
                F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))), F.lit(self.number), b
            ),
        )


def _prepared(found: DataFrame) -> DataFrame:
    """Templates with their words, distinct shingles and class."""
    w = words(F.col("text"))
    rows = found.filter("text is not null").select("license_id", w.alias("_w"))
    rows = rows.select(
        "license_id",
        F.array_distinct(shingles(F.col("_w"), F.lit(0), F.size("_w") - SHINGLE)).alias("wanted"),
    )
    return rows.withColumn("wanted", F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.raise_error(F.lit("a licence template has at least five words")))).withColumn(
        "class", F.floor(F.log2(F.size("wanted"))).cast("int")
    )


def shingle_hashes(found: Column) -> Column:
    """One hash per shingle, from one hash per word."""
    own = F.transform(found, lambda w: F.xxhash64(w))
    places = F.when(F.size(found) >= SHINGLE, F.sequence(F.lit(1), F.size(found) - SHINGLE + 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.flatten(
        F.transform(F.array(own), lambda h: F.transform(places, lambda i: F.xxhash64(F.slice(h, i, F.lit(SHINGLE)))))
    )


def _gate(wanted: DataFrame, hash_of: Column, limit: int = GATE_SHINGLES) -> Column | None:
    """All template shingles as one array; none if there are more than the limit."""
    found = [r["h"] for r in wanted.select(F.explode(hash_of).alias("h")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        return None
    return F.split(F.lit(",".join(map(str, sorted(found)))), ",").cast("array<long>")


def _resolved(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The hits that no overlapping relative of another id beats.  Hits meet in the stretches of
    words that they touch, so a long text is not one comparison of all with all."""
    columns = hits.columns
    hits = hits.distinct().join(F.broadcast(wanted.select("template", "wanted")), "template")
    stretch = lambda at: F.floor(at / F.lit(STRETCH)).cast("int")
    touched = F.explode(F.sequence(stretch(F.col("at")), stretch(F.col("at") + F.col("n") + SHINGLE - 2)))
    met = hits.withColumn("stretch", touched).groupBy("row", "stretch").agg(
        F.collect_list(F.struct(*columns, "wanted", F.round(F.col("share") * F.col("n")).alias("shared"))).alias("all")
    )
    beats = lambda o, h: (
        (o["license_id"] != h["license_id"]) & (o["shared"] > h["shared"])
        & (o["at"] < h["at"] + h["n"] + SHINGLE - 1) & (h["at"] < o["at"] + o["n"] + SHINGLE - 1)
        & F.arrays_overlap(o["wanted"], h["wanted"])
    )
    judged = F.transform(
        "all",
        lambda h: F.struct(*[h[c].alias(c) for c in columns], F.exists("all", lambda o: beats(o, h)).alias("beaten")),
    )
    flat = met.select(F.explode(judged).alias("h")).select("h.*")
    return flat.groupBy(*columns).agg(F.max("beaten").alias("beaten")).filter("not beaten").select(*columns)


def find_licenses(
    docs: DataFrame,
    licenses: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
    miss: float = MISS,
    resolve: bool = False,
) -> DataFrame:
    """One row per document row and template found: the id, license_id, template_shingles,
    containment and first_word (place of the first template shingle in the best window).  With
    ``resolve``, a hit goes where one of another id overlaps it that shares shingles with it and has
    more of its own there, so a notice is not also reported as its close relatives."""
    spark = docs.sparkSession
    wanted = _prepared(licenses if licenses is not None else templates(spark))
    wanted = durable(wanted.select(F.xxhash64("license_id", "wanted").alias("template"), "license_id", "wanted", "class"))
    text = F.col(f"`{text_col}`")
    numbers = sorted(r["class"] for r in wanted.select("class").distinct().collect())
    classes = [Class(n, containment, miss) for n in numbers]  # one per doubling of length
    hash_of = F.transform("wanted", lambda s: F.xxhash64(F.transform(F.split(s, " "), lambda w: F.xxhash64(w))))
    rows = docs.filter(text.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), integer_id(docs, id_col).alias("id"), words(text).alias("words")
    )
    rows = rows.filter(F.size("words") >= SHINGLE).withColumn("hashes", shingle_hashes(F.col("words")))
    gate = _gate(wanted, hash_of)
    if gate is not None:
        rows = rows.filter(F.arrays_overlap("hashes", gate))
        places = F.sequence(F.lit(0), F.size("hashes") - 1)
        at = F.filter(places, lambda i: F.array_contains(gate, F.get("hashes", i)))
        rows = rows.withColumn("at", at)

    def windows(c: Class) -> Column:
        last = F.greatest(F.size("hashes") - F.lit(c.window), F.lit(0))
        if gate is None:
            starts = F.concat(F.sequence(F.lit(0), last, F.lit(c.stride)), F.array(last))
        else:  # the windows that hold a template shingle
            first = lambda p: F.greatest(F.ceil((p - (c.window - 1)) / F.lit(c.stride)), F.lit(0)).cast("int")
            starts = F.flatten(
                F.transform(
                    "at",
                    lambda p: F.transform(
                        F.when(first(p) <= F.floor(p / F.lit(c.stride)), F.sequence(first(p), F.floor(p / F.lit(c.stride)).cast("int"))).otherwise(F.array().cast("array<int>")),
                        lambda k: F.least(k * c.stride, last),
                    ),
                )
            )
            # The last window is cut to the end of the text.
            starts = F.concat(starts, F.when(F.exists("at", lambda p: p >= last), F.array(last)).otherwise(F.array().cast("array<int>")))
        starts = F.array_distinct(starts)
        return F.flatten(
            F.transform(
                starts,
                lambda s: F.transform(
                    c.signature(F.slice("hashes", s + 1, F.lit(c.window))),
                    lambda b: F.struct(b.alias("band"), s.alias("start"), F.lit(c.window).alias("width")),
                ),
            )
        )

    keys = None
    for c in classes:
        own = wanted.filter(F.col("class") == c.number).select("template", "license_id", "wanted", F.explode(c.signature(hash_of)).alias("band"))
        keys = own if keys is None else keys.unionByName(own)
    if keys is None:
        return spark.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, license_id string, template_shingles long, containment double, first_word long")
    banded = rows.select("row", "id", "words", F.explode(F.concat(*[windows(c) for c in classes])).alias("w"))
    found = join_small(banded.select("*", F.col("w.band").alias("band")), keys, ["band"])
    first = F.greatest(F.col("w.start") - F.col("w.width"), F.lit(0))
    last = F.least(F.col("w.start") + 2 * F.col("w.width"), F.size("words") - SHINGLE)
    seen = found.withColumn("seen", shingles(F.col("words"), first, last)).withColumn("first", first)
    share = F.size(F.array_intersect("wanted", "seen")) / F.size("wanted")
    at = F.col("first") + F.array_min(F.transform("wanted", lambda s: F.when(F.array_position("seen", s) > 0, F.array_position("seen", s)))) - 1
    hits = seen.select("row", "id", "template", "license_id", F.size("wanted").alias("n"), share.alias("share"), at.alias("at"))
    # Verified where they were found: words are not moved; a window met in several bands gives equal hits.
    hits = hits.filter(F.col("share") >= containment)
    if resolve:
        hits = _resolved(hits, wanted)
    best = (
        hits.groupBy("row", "template")
        .agg(F.max(F.struct("share", (-F.col("at")).alias("at"), "id", "license_id", "n")).alias("b"))
    )
    return best.select(
        F.col("b.id").alias(id_col), "b.license_id", F.col("b.n").cast("long").alias("template_shingles"),
        F.col("b.share").alias("containment"), (-F.col("b.at")).cast("long").alias("first_word"),
    )
