"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans.  Two character Markov models add others: one of random
strings, one of ordinary identifiers, both trained from labelled samples.  A candidate is what base
spans leave of a run of key characters, if it has some length.  Its segments of maximal sum of the
log-likelihood ratios per step (random against ordinary) are ``model`` spans where the sum reaches a
threshold fitted on the samples, so words beside a key do not outweigh it; a span is widened to the
next ``/ = - _`` or the candidate's end.

Places are taken from splitting: the pieces between matches and the matches themselves give every
start, in code points.

Cases: a null text is empty; a text or a match of any length is taken whole; repeated rows are
scanned alike; without labelled samples the models know the uniform and the letter-run prior only;
an empty table gives no rows; other columns are ignored or kept, as asked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import integer_id

# Kinds in their order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A candidate of the models, and its least length.
LEAST_RUN = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
DELIMITERS = "/_=-"
#: The least length of a model span.
LEAST_MODEL = 16
#: Labelled rows used to fit the models: about so many documents, so many strings of each label.
SAMPLE_DOCS = 20_000
SAMPLE_ROWS = 5000
#: The share of ordinary samples that may reach the threshold, which is also the likelihood ratio
#: that a segment has at least.
FALSE_ALARMS = 0.001
#: The weight of kinds of characters in both models.
BROAD = 0.5
REPLACEMENT = "[secret]"


def _matches(text: Column, pattern: str) -> Column:
    """(start, value) of the matches of a pattern, left to right."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.aggregate(
        F.arrays_zip(found.alias("value"), F.slice(pieces, F.lit(1), F.size(found)).alias("before")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, m: F.struct(
            (s["at"] + F.length(m["before"]) + F.length(m["value"])).alias("at"),
            F.concat(
                s["spans"],
                F.array(
                    F.struct(
                        (s["at"] + F.length(m["before"])).alias("start"),
                        (s["at"] + F.length(m["before"]) + F.length(m["value"])).alias("end"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda s: s["spans"],
    )


def _where(text: Column, pattern: str, keep: Column) -> Column:
    """Spans of the matches that pass, or none; most texts have no match."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(keep, _matches(text, pattern)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind (code points, end exclusive), failing matches dropped."""
    assign = F.filter(
        _where(text, ASSIGN, text.rlike(ASSIGN)),
        lambda s: F.length(_second(text.substr(s["start"] + 1, s["end"] - s["start"]))) >= LEAST["assign"],
    )
    access = F.filter(_where(text, ACCESS, text.contains("AKIA")), lambda s: s["end"] - s["start"] >= LEAST["access"])
    wide = f"[0-9a-f]{{{LEAST['hex']},}}"  # a maximal run, as the pattern takes it
    return {"assign": assign, "access": access, "hex": _where(text, wide, text.rlike(wide))}


def _second(match: Column) -> Column:
    return F.regexp_extract(match, "^" + ASSIGN + "$", 2)


def _pairs() -> dict[str, int]:
    return {c: k for k, c in enumerate(ALPHABET)}


class Markov:
    """First-order character models of both labels and the threshold between them.

    A step's likelihood is its share after the character before, mixed with the share of its kind of
    character (small, capital, digit, delimiter) after that kind, evenly over the kind; so a word of another language is
    still a word.  The threshold is a quantile of ``held_out`` ordinary strings, or of the counted ones if there are none."""

    def __init__(self, random: list[str], ordinary: list[str], smoothing: float = 0.5, held_out: list[str] | None = None):
        at, n = _pairs(), len(ALPHABET)
        kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in ALPHABET]
        tables = []
        for sample in (random, ordinary):
            count = [[smoothing] * n for _ in range(n)]
            for word in sample:
                for a, b in zip(word, word[1:]):
                    if a in at and b in at:
                        count[at[a]][at[b]] += 1
            broad = [[sum(count[a][b] for a in range(n) for b in range(n) if (kinds[a], kinds[b]) == (x, y)) for y in range(4)] for x in range(4)]
            even = [[broad[kinds[a]][kinds[b]] / sum(broad[kinds[a]]) / kinds.count(kinds[b]) for b in range(n)] for a in range(n)]
            tables.append(
                [[math.log((1 - BROAD) * x / sum(row) + BROAD * even[a][b]) for b, x in enumerate(row)] for a, row in enumerate(count)]
            )
        # A step to a delimiter is no evidence of a key; else words before one would belong to it.
        self.ratio = [min(r - o, 0.0) if c in DELIMITERS else r - o for a, b in zip(*tables) for c, r, o in zip(ALPHABET, a, b)]
        self.threshold = math.log(1 / FALSE_ALARMS)
        scores = sorted(self.score(w) for w in held_out or ordinary if len(w) > 1)
        if scores:
            high = scores[min(len(scores) - 1, int(len(scores) * (1 - FALSE_ALARMS)))]
            self.threshold = max(self.threshold, high + 1e-3)

    def score(self, word: str) -> float:
        """The maximal sum of the ratios of a segment."""
        at, n = _pairs(), len(ALPHABET)
        total = top = 0.0
        for a, b in zip(word, word[1:]):
            total = max(0.0, total + (self.ratio[at[a] * n + at[b]] if a in at and b in at else 0.0))
            top = max(top, total)
        return top

    def _walk(self, word: Column) -> Column:
        """``top``, the maximal sum of a segment, and ``spans``, the segments that reach the threshold,
        each from the delimiter before it.  A segment is over where its sum is used up or is the
        threshold below its best, so a key that follows is one of its own."""
        n = len(ALPHABET)
        values = F.split(F.lit(",".join(f"{x:.5f}" for x in self.ratio)), ",").cast("array<double>")
        codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
        steps = F.flatten(
            F.transform(
                F.array(codes),
                lambda cs: F.transform(
                    cs,
                    lambda c, i: F.struct(
                        F.when((i > 0) & (c >= 0) & (F.get(cs, i - 1) >= 0), F.get(values, F.get(cs, i - 1) * n + c)).otherwise(0.0).alias("x"),
                        c.isin([ALPHABET.index(d) for d in DELIMITERS]).alias("cut"),
                    ),
                ),
            )
        )
        none = F.array().cast("array<struct<start:int,end:int>>")
        kept = lambda s: F.when(
            s["best"] >= self.threshold, F.concat(s["spans"], F.array(F.struct(s["left"].alias("start"), s["end"].alias("end"))))
        ).otherwise(s["spans"])

        def step(s: Column, c: Column) -> Column:
            total = s["sum"] + c["x"]
            cut = F.when(c["cut"], s["at"] + 1).otherwise(s["cut"])
            over = (total <= 0) | (s["best"] - total >= self.threshold)
            return F.struct(
                (s["at"] + 1).alias("at"),
                cut.alias("cut"),
                F.when(over, 0.0).otherwise(total).alias("sum"),
                F.when(over, 0.0).otherwise(F.greatest(s["best"], total)).alias("best"),
                F.when(over, cut).otherwise(s["left"]).alias("left"),
                F.when(~over & (total > s["best"]), s["at"] + 1).otherwise(s["end"]).alias("end"),
                F.greatest(s["top"], total).alias("top"),
                F.when(over, kept(s)).otherwise(s["spans"]).alias("spans"),
            )

        zero = [F.lit(v).alias(k) for k, v in (("at", 0), ("cut", 0), ("sum", 0.0), ("best", 0.0), ("left", 0), ("end", 0), ("top", 0.0))]
        return F.aggregate(
            steps, F.struct(*zero, none.alias("spans")), step, lambda s: F.struct(s["top"].alias("top"), kept(s).alias("spans"))
        )

    def column(self, word: Column) -> Column:
        """``score`` of a string of the alphabet."""
        return self._walk(word)["top"]

    def spans(self, word: Column) -> Column:
        """(start, end) of the model spans of a string, each up to the next delimiter, joined where
        they overlap."""
        slashed = F.translate(word, DELIMITERS, "/" * len(DELIMITERS))
        wide = F.transform(
            self._walk(word)["spans"],
            lambda s: F.struct(
                s["start"].alias("start"),
                (s["end"] + F.length(F.substring_index(slashed.substr(s["end"] + 1, F.length(word)), "/", 1))).alias("end"),
            ),
        )
        joined = F.aggregate(
            wide,
            F.array().cast("array<struct<start:int,end:int>>"),
            lambda out, s: F.when(
                (F.size(out) > 0) & (s["start"] < F.get(out, F.size(out) - 1)["end"]),
                F.concat(
                    F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                    F.array(F.struct(F.get(out, F.size(out) - 1)["start"].alias("start"), F.greatest(F.get(out, F.size(out) - 1)["end"], s["end"]).alias("end"))),
                ),
            ).otherwise(F.concat(out, F.array(s))),
        )
        return F.filter(joined, lambda s: s["end"] - s["start"] >= LEAST_MODEL)


def identifiers(words: list[str]) -> list[str]:
    """Ordinary words joined as code, paths and file names join them: camel case, constants, words with
    numbers, dated paths, time stamps."""
    made = []
    for k in range(len(words) - 4):
        a, b, c, d, e = (w.lower() for w in words[k : k + 5])
        year, month, day = 1985 + k % 50, 1 + k % 12, 1 + k % 28
        clock = f"{k * 7 % 24:02}{k * 11 % 60:02}{k * 13 % 60:02}"
        camel = [w.capitalize() for w in (a, b, c, d, e)]
        made += [
            "".join(camel[: 2 + k % 4]),
            a + "".join(camel[1 : 3 + k % 3]) + (str(k % 100) if k % 3 == 0 else ""),
            "_".join((a, b, c)).upper(),
            f"/{a}/{year}/{month:02}/{day:02}/{b}_{c}",
            f"{camel[0]}{camel[1]}_{year}-{month:02}-{day:02}_{d}",
            f"/{a}/{b}{k % 10}/{c}-{year}{month:02}{day:02}{clock}-{d}" if k % 2 else f"{a}-{b}_v{k % 20}_{k % 5}_{k * 37 % 1000}",
        ]
    return made


def labelled_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str], list[str]]:
    """(random, ordinary, held-out ordinary) strings labelled by the base patterns in a hash sample of
    about ``sample_docs`` documents: what they catch is random; long runs of key characters of texts
    without a catch, alone and joined as identifiers are, and their words joined as ``identifiers``, are
    ordinary.  At most ``rows`` strings of each label are taken, the first by hash; a fifth of the ordinary
    ones, by their words, is held out."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    share = max(1, docs.count() // sample_docs)
    part = docs.filter(F.pmod(F.xxhash64(integer_id(docs, id_col)), F.lit(share)) == 0).select(text.alias("t"))
    has = F.col("t").rlike(ASSIGN) | F.col("t").contains("AKIA")
    secret = F.concat(
        F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0))
    )
    long_ = F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]{10,64}"), F.lit(0))
    plain = F.regexp_extract_all("t", F.lit(r"\b[A-Za-z]{3,12}\b"), F.lit(0))

    def first(words: DataFrame) -> list[str]:
        return [r["w"] for r in words.distinct().orderBy(F.xxhash64("w"), "w").limit(rows).collect()]

    random = first(part.filter(has).select(F.explode(secret).alias("w")).filter("length(w) between 12 and 256"))
    runs = first(part.filter(~has).select(F.explode(long_).alias("w")))
    words = first(part.filter(~has).select(F.explode(plain).alias("w")))

    def ordinary(runs: list[str], words: list[str]) -> list[str]:
        joints = ["_", "-", "/", ""]
        joined = [a[:16] + joints[k % 4] + b[:16] for k, (a, b) in enumerate(zip(runs, runs[1:]))]
        # Paths of eight, as long runs are.
        joints = ["/", "_", "-", "=", "/", "-", "_", ""]
        paths = ["".join(w[:16] + joints[(k + j) % 8] for j, w in enumerate(runs[k : k + 8])) for k in range(len(runs) - 7)]
        return runs + joined + paths + identifiers(words)

    fifth = lambda items, kept: [w for k, w in enumerate(items) if (k % 5 > 0) == kept]
    return random, ordinary(fifth(runs, True), fifth(words, True)), ordinary(fifth(runs, False), fifth(words, False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Markov:
    random, ordinary, held_out = labelled_samples(docs, id_col=id_col, text_col=text_col)
    return Markov(random, ordinary, held_out=held_out)


def _left(run: Column, base: Column) -> Column:
    """What the base spans, which are sorted by start, leave of a run."""
    piece = lambda a, b: F.when(a < b, F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )
    return F.aggregate(
        F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])),
        F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda s, b: F.struct(
            F.greatest(s["at"], b["end"]).alias("at"), F.concat(s["out"], piece(s["at"], b["start"])).alias("out")
        ),
        lambda s: F.concat(s["out"], piece(s["at"], run["end"])),
    )


def find_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: Markov | None = None,
    keep_rows: bool = False,
) -> DataFrame:
    """Per row: the id, n_assign, n_access, n_hex, ``base`` and ``spans`` (arrays of kind, start, end
    in code points, by start, then kind); with ``keep_rows`` also ``row``."""
    model = model or train(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(
        integer_id(docs, id_col).alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []),
    )
    kinds = base_spans(F.col("text"))
    rows = rows.select("*", *[c.alias(f"_{k}") for k, c in kinds.items()])
    tagged = lambda k, number: F.transform(
        k, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("k"), s["end"].alias("end"))
    )
    base = F.array_sort(F.concat(*[tagged(F.col(f"_{k}"), n) for n, k in enumerate(KINDS[:3])]))
    rows = rows.withColumn("_base", base)
    text = F.col("text")
    runs = _where(text, CANDIDATE, text.rlike(CANDIDATE))
    free = F.filter(F.flatten(F.transform(runs, lambda r: _left(r, F.col("_base")))), lambda s: s["end"] - s["start"] >= LEAST_RUN)
    rows = rows.withColumn("_free", free)
    more = F.flatten(
        F.transform(
            "_free",
            lambda g: F.transform(
                model.spans(text.substr(g["start"] + 1, g["end"] - g["start"])),
                lambda s: F.struct((g["start"] + s["start"]).alias("start"), (g["start"] + s["end"]).alias("end")),
            ),
        )
    )
    rows = rows.withColumn("_more", more)
    every = F.array_sort(F.concat("_base", tagged(F.col("_more"), 3)))
    named = lambda c: F.transform(
        c, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return rows.select(
        F.col("id").alias(id_col), *(["row"] if keep_rows else []),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        named(F.col("_base")).alias("base"), named(every).alias("spans"),
    )


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, *, text_col: str = "text", replacement: str = REPLACEMENT, **options) -> DataFrame:
    """All rows of ``docs``; in their texts every span is replaced, overlapping ones together."""
    found = find_secrets(docs, text_col=text_col, keep_rows=True, **options)
    text = F.col(f"row.`{text_col}`")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.when(
                x["start"] >= s["at"],
                F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(replacement)),
            ).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size("spans") > 0, cut).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
