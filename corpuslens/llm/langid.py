"""Language identification with interpolated Kneser-Ney character models.

Each language has one model of order 4 over lower-cased letters, all other characters being one
blank.  Counts come from a bounded sample of labelled rows per language; probabilities and back-off
weights of all languages stand side by side in arrays sorted by n-gram hash.  A text goes to the
language of the lowest cross-entropy per character; it is rejected if that exceeds a bound, a quantile
of all labelled rows that were not counted, found by Spark.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; without any
labelled row every text is; ties go to the first language in order; texts of any length are read
whole; rows without an id are judged but not learned from; repeated rows are judged alike; an empty
table gives no rows; other columns stay untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import flat, integer_id, steps
from corpuslens.session import durable

ORDER = 4
#: Labelled rows per language that are counted (about; taken by hash).  All other labelled rows calibrate
#: the bound; of a language with fewer, one in so many is left to do so, and none of one with very few.
DOCS_PER_LANGUAGE = 2000
CALIBRATION_SHARE = 5
FEW_ROWS = 40
#: The share of calibration rows that may be rejected, and what any text may be off (nats).
REJECTED_SHARE = 0.0005
SLACK = 0.35
UNKNOWN = "und"
STEP = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)


class Letters:
    """Code points -> lower-case letters, everything else 0; filled as characters appear."""

    def __init__(self):
        self.to = np.zeros(0x110000, np.uint32)
        self.known = np.zeros(0x110000, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        new = ~self.known[points]
        if new.any():
            for p in np.unique(points[new]).tolist():
                c = chr(p)
                self.to[p] = ord(c.lower()[0]) if c.isalpha() else 0
                self.known[p] = True
        return self.to[points]


def streams(column: pa.Array, letters: Letters, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, text of each, letters per text): every text begins with order - 1 blanks, and
    has no other two blanks in a row."""
    data, offsets = flat(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    head = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    at = head[offsets]
    c = letters(points)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    before = np.append(np.uint32(0), c[:-1])
    before[at[:-1][at[:-1] < len(c)]] = 0
    kept = (c != 0) | (before != 0)
    c, text = c[kept], text[kept]
    count = np.bincount(text[c != 0], minlength=len(at) - 1)
    first = np.searchsorted(text, np.arange(len(at) - 1))
    pad = np.repeat(first, order - 1)
    return np.insert(c, pad, 0), np.insert(text, pad, np.repeat(np.arange(len(at) - 1), order - 1)), count


def hashes(c: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n = 1 to order: the hash of the n characters that end at each place."""
    x = c.astype(np.uint64) + np.uint64(1)
    out = [x]
    for _ in range(order - 1):
        last = out[-1]
        out.append(np.append(np.uint64(0), last[:-1]) * _M + x)
    return out


def _key(grams: np.ndarray) -> np.ndarray:
    h = grams[:, 0].astype(np.uint64) + np.uint64(1)
    for k in range(1, grams.shape[1]):
        h = h * _M + grams[:, k].astype(np.uint64) + np.uint64(1)
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """One language: counts of the highest order, continuation counts below, one discount each."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet = alphabet
        self.levels = []  # from the highest order down: keys, counts, contexts, totals, types, discount
        while True:
            order = np.argsort(key := _key(grams), kind="stable")
            grams, counts, key = grams[order], counts[order], key[order]
            context = _key(grams[:, :-1]) if grams.shape[1] > 1 else np.zeros(len(grams), np.uint64)
            at, inverse = np.unique(context, return_inverse=True)
            one, two = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5
            self.levels.append((key, counts, at, np.bincount(inverse, counts), np.bincount(inverse), discount))
            if grams.shape[1] == 1:
                return
            grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)  # distinct left neighbours

    def back_off(self, level: int, contexts: np.ndarray) -> np.ndarray:
        _, _, known, totals, types, discount = self.levels[level]
        at, found = _find(known, contexts)
        return np.where(found, discount * types[at] / totals[at], 1.0) if len(known) else np.ones(len(contexts))

    def probability(self, level: int, grams: np.ndarray) -> np.ndarray:
        key, counts, known, totals, _, discount = self.levels[level]
        context = _key(grams[:, :-1]) if grams.shape[1] > 1 else np.zeros(len(grams), np.uint64)
        lower = self.probability(level + 1, grams[:, 1:]) if grams.shape[1] > 1 else np.full(len(grams), 1 / self.alphabet)
        at, found = _find(key, _key(grams))
        c_at, c_found = _find(known, context)
        own = np.where(found & c_found, np.maximum(counts[at] - discount, 0) / totals[c_at], 0.0)
        return own + self.back_off(level, context) * lower


@dataclass
class Models:
    """Sorted hash arrays over all languages: log probabilities by order, back-off weights by
    context, and for each language the mean entropy and the bound of its deviation."""

    languages: list[str]
    alphabet: int = 1
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    mean: np.ndarray | None = None
    bound: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, Counter]) -> Models:
        out = cls(sorted(counts))
        if not out.languages:
            return out
        tables = {}
        for lang in out.languages:
            grams = list(counts[lang])
            points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
            tables[lang] = points, np.array([counts[lang][g] for g in grams], np.float64)
        every = np.unique(np.concatenate([t[0] for t in tables.values()]), axis=0)
        out.alphabet = len(np.unique(every)) + 1
        models = [KneserNey(*tables[lang], out.alphabet) for lang in out.languages]
        for level in range(ORDER):
            keys = _key(every)
            order = np.argsort(keys)
            values = np.log(np.stack([m.probability(level, every) for m in models], axis=1))
            out.grams.append((keys[order], values[order].astype(np.float32)))
            context = np.unique(every[:, :-1], axis=0) if level < ORDER - 1 else every[:0]
            keys = _key(context) if level < ORDER - 1 else np.zeros(1, np.uint64)
            order = np.argsort(keys)
            weight = np.log(np.stack([m.back_off(level, keys) for m in models], axis=1))
            out.contexts.append((keys[order], weight[order].astype(np.float32)))
            every = np.unique(every[:, 1:], axis=0)
        return out

    def log_probabilities(self, seen: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log probability under each language of the characters at these places."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        live = np.arange(len(at))
        for level in range(ORDER):
            keys, values = self.grams[level]
            n = ORDER - level
            place, found = _find(keys, seen[n - 1][at[live]])
            out[live[found]] += values[place[found]]
            live = live[~found]
            if not len(live):
                return out
            context = seen[n - 2][at[live] - 1] if n > 1 else np.zeros(len(live), np.uint64)
            keys, values = self.contexts[level]
            place, found = _find(keys, context)
            out[live[found]] += values[place[found]]
        out[live] += np.float32(-np.log(self.alphabet))
        return out

    def entropies(self, column: pa.Array, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and language, letters by text)."""
        c, text, count = streams(column, letters)
        total = np.zeros((len(count), len(self.languages)))
        length = np.zeros(len(count))
        seen = hashes(c)
        pad = np.zeros(len(c), bool)
        first = np.searchsorted(text, np.arange(len(count)))
        for k in range(ORDER - 1):
            pad[first + k] = True
        for start in range(0, len(c), STEP):
            at = np.flatnonzero(~pad[start : start + STEP]) + start
            if not len(at):
                continue
            found = self.log_probabilities(seen, at)
            own = text[at]
            cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            total[own[cut]] += np.add.reduceat(found, cut, axis=0, dtype=np.float64)
            length[own[cut]] += np.diff(np.append(cut, len(own)))
        return -total / np.maximum(length, 1)[:, None], count

    def judge(self, entropy: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, rejected)."""
        if not self.languages:
            return np.full(len(count), -1), np.zeros(len(count)), np.ones(len(count), bool)
        best = entropy.argmin(axis=1)
        own = entropy[np.arange(len(best)), best]
        odds = np.exp((own[:, None] - entropy) * np.minimum(np.maximum(count, 1), 20)[:, None])
        off = own - self.mean[best]
        rejected = (off > SLACK) & (off * np.sqrt(np.maximum(count, 1)) > self.bound[best])
        none = count == 0
        return np.where(none, -1, best), np.where(none, 0.0, 1 / odds.sum(axis=1)), rejected | none


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, n-gram, count), summed within the partition."""
    letters, counts = Letters(), {}
    for batch in steps(batches):
        langs = batch.column(0).to_pylist()
        c, text, _ = streams(batch.column(1), letters)
        whole = c.tobytes().decode("utf-32-le")
        first = np.searchsorted(text, np.arange(len(langs) + 1)).tolist()
        for lang, a, b in zip(langs, first, first[1:]):
            own = whole[a:b]
            counts.setdefault(lang, Counter()).update(own[k : k + ORDER] for k in range(len(own) - ORDER + 1))
    for lang, own in counts.items():
        grams = list(own)
        for k in range(0, len(grams), 100_000):
            part = grams[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "gram": [g.encode("utf-32-le") for g in part], "n": [own[g] for g in part]})


def _score(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = Letters(), models.value
        for batch in steps(batches, limit=STEP):
            column = batch.column(batch.schema.get_field_index("text"))
            entropy, count = known.entropies(column, letters) if known.languages else (np.zeros((batch.num_rows, 1)), np.zeros(batch.num_rows, np.int64))
            best, score, rejected = known.judge(entropy, count)
            names = [*known.languages, UNKNOWN]
            found = {
                "lang_pred": pa.array([names[b] for b in best.tolist()], pa.string()),
                "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected),
                "cross_entropy": pa.array(np.where(count > 0, entropy.min(axis=1), np.nan), pa.float64()),
                "n_letters": pa.array(count, pa.int64()),
            }
            kept = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + list(found.values()), names=[n for n, _ in kept] + list(found))

    return run


_FOUND = "lang_pred string, score double, rejected boolean, cross_entropy double, n_letters long"


def held_out(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2."""
    number = F.crc32(integer_id(docs, id_col).cast("string").cast("binary"))
    return F.coalesce(F.pmod(number, F.lit(4)) == 2, F.lit(False))


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Models:
    """Models from the rows of ``docs`` that have an id, a text and a language."""
    rows = docs.select(integer_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Models([])
    by = lambda value: F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, value(n))])[F.col("lang")]
    # By id and text, so that rows which share an id are not all on one side.
    mixed, again = F.xxhash64("id", "text"), F.xxhash64("id", "text", F.lit(7))
    sampled = F.pmod(mixed, by(lambda n: max(1, -(-n // docs_per_language)))) == 0
    spared = (F.pmod(again, F.lit(CALIBRATION_SHARE)) == 0) & by(lambda n: FEW_ROWS <= n <= docs_per_language)
    counted_rows = sampled & ~spared
    counted = rows.filter(counted_rows).select("lang", "text").mapInArrow(_count, "lang string, gram binary, n long")
    counts: dict[str, Counter] = {}
    for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():  # of the sample
        counts.setdefault(r["lang"], Counter())[bytes(r["gram"]).decode("utf-32-le")] = r["n"]
    models = Models.fit(counts)
    if not models.languages:
        return models
    n = len(models.languages)
    models.mean, models.bound = np.zeros(n), np.full(n, np.inf)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    tried = rows.filter(~counted_rows).select("lang", "text").mapInArrow(_score(shared), f"lang string, {_FOUND}")
    root = F.sqrt("n_letters")
    seen = durable(
        tried.filter("lang = lang_pred and n_letters > 0").select("lang", F.col("cross_entropy").alias("e"), root.alias("root"))
    )
    shared.destroy()  # what follows reads the table; ``identify`` sends the finished models
    mean = (F.sum(F.col("e") * F.col("root")) / F.sum("root")).alias("mean")
    own = {r["lang"]: r for r in seen.groupBy("lang").agg(F.count("*").alias("n"), mean).collect()}  # one row per language
    everything = seen.agg(F.count("*").alias("n"), mean).first()
    # Too few of its own: those of all languages.
    source = {lang: own[lang] if lang in own and own[lang]["n"] >= 20 else everything for lang in models.languages}
    known = {lang: r["mean"] for lang, r in source.items() if r["n"] >= 20}
    if not known:
        return models
    off = (F.col("e") - F.col("mean")) * F.col("root")
    bound = F.percentile_approx(off, F.lit(1 - REJECTED_SHARE), F.lit(200_000)).alias("bound")
    means = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    bounds = {r["lang"]: r["bound"] for r in seen.withColumn("mean", means[F.col("lang")]).groupBy("lang").agg(bound).collect()}
    shared_bound = seen.agg(F.percentile_approx((F.col("e") - F.lit(everything["mean"])) * F.col("root"), F.lit(1 - REJECTED_SHARE), F.lit(200_000))).first()[0]
    for k, lang in enumerate(models.languages):
        if lang in known:
            models.mean[k] = known[lang]
            models.bound[k] = bounds[lang] if source[lang] is not everything else shared_bound
    return models


def identify(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """Per row: the id, held_out, lang_pred, score, rejected, cross_entropy and n_letters; with
    ``keep_rows`` also ``row``, the given row as a struct."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(
        integer_id(docs, id_col).alias("id"), held_out(docs, id_col).alias("held_out"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []),
        F.col(f"`{text_col}`").alias("text"),
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_score(shared), f"{kinds}, {_FOUND}").withColumnRenamed("id", id_col)
