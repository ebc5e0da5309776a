from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from corpuslens.llm import quality

DOCS = "doc_id long, text string, words string"
TRUSTED = "doc_id long, quality int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    again = {k for k, x in enumerate(windows) if windows.count(x) > 1}
    repeat = len({k + j for k in again for j in range(8)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat,
        len(w) < 20 or 100 * repeat > 30 * len(w),
    )


def texts(rng):
    out = [None, "", " \n\t", "a", "x " * 5000, "é😀 <b>| ##\n<b>|\n\n<b>|\nq", "a b \x0b c\x0cd"]
    for _ in range(30):
        n = rng.choice((3, 19, 25, 90))
        out.append("".join(rng.choice("abc") + rng.choice((" ", "\n", "  ")) for _ in range(n)))
    base = [f"w{k}" for k in range(40)]
    return out + [" ".join(base), " ".join(base + base[5:14]), " ".join(base[:9] * 2 + base)]


def test_base_rules_equal_brute_force(spark, rng):
    docs = [(k, t, "x") for k, t in enumerate(texts(rng))]
    got = quality.judge(spark.createDataFrame(docs, DOCS), None).collect()
    for r in got:
        want = brute(docs[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1])


def test_ratio_equals_brute_force(spark, rng):
    docs = [(k, " ".join(rng.choice("abcdefgh" if k % 2 else "stuvwxyz") for _ in range(40)), "x") for k in range(20)]
    docs.append((None, "a b", None))
    trusted = spark.createDataFrame([(k, 1) for k in range(1, 20, 2)] + [(1, 1), (None, 1)], TRUSTED)
    frame = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r.score for r in quality.judge(frame, trusted, buckets=64).collect()}
    grams = frame.select("doc_id", quality.n_grams(quality.hashed(quality.words(F.col("text"))), 64).alias("g")).collect()
    raw, target = [1.0] * 64, [1.0] * 64
    for r in grams:
        for g in r.g:
            raw[g] += 1
            target[g] += r.doc_id is not None and r.doc_id % 2
    for r in grams:
        want = sum(math.log(target[g] / sum(target)) - math.log(raw[g] / sum(raw)) for g in r.g) / len(r.g)
        assert abs(got[r.doc_id] - want) < 1e-4
    verdict = {r.doc_id: r.kept for r in quality.judge(frame, trusted, buckets=64).collect()}
    assert all(verdict[k] == bool(k % 2) for k in range(20))


def test_every_trusted_document_counts(spark):
    """120,000 trusted rows, among them one odd text whose id comes last by hash."""
    ids = spark.range(120_000).withColumnRenamed("id", "doc_id")
    odd = ids.orderBy(F.xxhash64("doc_id").desc()).first()[0]
    docs = ids.withColumn("text", F.when(F.col("doc_id") == odd, "zz").otherwise("a b"))
    raw, target = quality.counts(docs, ids, id_col="doc_id", text_col="text", buckets=64)
    assert sorted(map(tuple, raw.collect())) == sorted(map(tuple, target.collect()))
    assert quality.judge(docs, ids, buckets=64, margin=0.0, min_words=1).filter("not kept").count() == 0


def test_empty(spark):
    docs, trusted = spark.createDataFrame([], DOCS), spark.createDataFrame([], TRUSTED)
    assert quality.judge(docs, trusted).count() == 0
