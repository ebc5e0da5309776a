from __future__ import annotations

import public_tokenizers
from test_decontam import brute as contamination
from test_langid import LANGS, prose
from test_neardup import brute as groups
from test_secrets import brute as base_secrets
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from corpuslens.llm.secrets import REPLACEMENT

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, rng, folder):
    docs = []
    for k in range(240):
        lang = list(LANGS)[k % 3]
        docs.append((k, prose(rng, LANGS[lang], rng.randrange(30, 90)), lang, "s", 1))
    passage = prose(rng, LANGS["aa"], 20)
    docs += [(300, docs[3][1] + " " + passage, "aa", "s", 1), (301, passage, "aa", None, None)]
    docs += [(310, docs[5][1], "cc", "s", 1), (311, docs[5][1] + " tail", "cc", "s", 1)]
    docs += [(320, docs[6][1] + ' token = "0123456789abcdef0123456789abcdef01234567" ' + docs[9][1], "aa", "s", 1)]
    docs += [(330, None, "aa", "s", 0), (331, "12 34", "aa", "s", 0), (332, "жщю " * 300, None, "s", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, [(1, passage)]


def test_every_stage_against_brute_force(spark, rng, tmp_path):
    docs, items = tables(spark, rng, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = frame.columns
    by_name = dict(corpus_pipeline.STAGES)

    def step(name, before):
        after = by_name[name](spark, before, str(tmp_path))
        assert after.columns == names
        path = f"{tmp_path}/after-{name}"
        after.write.parquet(path)
        return spark.read.parquet(path), {r.doc_id: r.text for r in after.collect()}

    one, kept = step("language", frame)
    assert set(kept) >= set(range(240)) | {300, 301, 310, 311, 320} and not set(kept) & {330, 331, 332}
    two, unique = step("near_duplicates", one)
    want = groups([(i, t) for i, t in kept.items()], 5)
    assert set(unique) == {i for i, (_, _, first) in want.items() if first}
    three, clean = step("decontamination", two)
    hits = contamination(list(unique.items()), items, 10)
    assert set(clean) == {i for i in unique if not hits[i][1]} and 320 in clean and 301 not in clean
    four, masked = step("secrets", three)
    assert set(masked) == set(clean)
    for i, text in clean.items():
        if base_secrets(text):
            assert REPLACEMENT in masked[i] and not base_secrets(masked[i])
    assert masked[7] == clean[7]
    whole = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.start):
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == {i: whole.encode(t, add_special_tokens=False).ids + [1] for i, t in masked.items()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert {n.split("_")[0] for n in contract.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert contract.queries()["pipeline"] is corpus_pipeline.run
