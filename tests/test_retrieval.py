from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from support import chunk_rows, pool, questions

from corpuslens.functions import joins
from corpuslens.functions import text as tx
from corpuslens.operators import evidence, fusion, keyword, rerank, vector
from corpuslens.operators.postings import (
    Index,
    build_index,
    build_postings,
    chunk_terms,
    explode_packs,
    explode_terms,
    pack_postings,
    project_identifiers,
    query_terms,
    read_index,
    write_index,
)


def scores(spark, query, *texts, top_k=50):
    chunks = chunk_rows(spark, [(chr(97 + i), 0, t) for i, t in enumerate(texts)])
    found = keyword.retrieve_keyword(questions(spark, [("q", query)]), chunks, top_k)
    return {r.document_id: r for r in found.collect()}


@pytest.mark.parametrize(
    "query, text, score",
    [
        ("node01", "node012", None),
        ("node01-east", "node01-west", 2.0),
        ("node01", "node01-east", 3.0),
        ("node01-east", "node01", 3.0),
        ("node01-east", "node01-east", 6.0),
        ("a.b-c", "a-b.c", 5.0),
    ],
)
def test_identifier_pairs(spark, query, text, score):
    got = scores(spark, query, text)
    assert (got["a"].keyword_score if got else None) == score


def test_words_before_punctuation_are_identifiers(spark):
    got = scores(spark, "it was the.", "so was the. end", "the was")
    assert (got["a"].exact_identifiers, got["a"].exact_ascii_terms) == (1, 1)
    assert (got["b"].exact_identifiers, got["b"].exact_ascii_terms) == (0, 1)


def test_general_terms_are_capped_and_repeats_count(spark):
    got = scores(spark, "red red blue green pink black", "red", "red blue green pink black")
    assert (got["a"].keyword_score, got["a"].exact_ascii_terms) == (2.0, 2)
    assert (got["b"].keyword_score, got["b"].exact_ascii_terms) == (4.0, 6)


def test_ideographs(spark):
    got = scores(spark, "服务器列表", "列表", "无")
    assert (got["a"].exact_cjk_terms, got["a"].keyword_score) == (1, 1.0)
    assert "b" not in got


def test_similar_hits_are_dropped_where_the_group_is_matched(spark):
    got = scores(spark, "node01-east alpha", "node01-east", "node01-west alpha", "node01-west")
    assert got["a"].exact_identifiers == 1
    assert (got["b"].ngram_matches, got["b"].keyword_score) == (0, 1.0)
    assert "c" not in got


def test_equal_scores_keep_stable_order_and_projects_stay_apart(spark):
    rows = [("b", 1, "red", None), ("b", 0, "red", None), ("a", 0, "red", None), ("z", 0, "red", None, "other")]
    found = keyword.retrieve_keyword(questions(spark, [("q", "red")]), chunk_rows(spark, rows), 2)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["a:0", "b:0"]


def test_keyword_scores_match_brute_force(spark):
    """Random identifiers against a pairwise model that knows nothing of blocking."""
    rng = random.Random(7)
    stems = ["node", "web", "db", "cache", "alpha", "build"]

    def identifier():
        return rng.choice(stems) + str(rng.randint(1, 30)) + rng.choice(["", "-east", ".west", "-" + rng.choice(stems)])

    texts = [" ".join(identifier() for _ in range(6)) for _ in range(40)]
    asked = [" ".join(identifier() for _ in range(3)) for _ in range(12)]
    chunks = chunk_rows(spark, [(f"d{i:02}", 0, t) for i, t in enumerate(texts)])
    found = keyword.retrieve_keyword(
        questions(spark, [(f"q{i}", t) for i, t in enumerate(asked)]), chunks, 1000
    )
    got = {(r.query_id, r.document_id): (r.exact_identifiers, r.contained_identifiers, r.ngram_matches) for r in found.collect()}
    joint = set(".-_/:+")

    def parts(token):
        whole = {token, token.replace("-", ".")}
        inner = set() if "-" not in token and "." not in token else {
            w for w in token.replace(".", "-").split("-") if len(w) > 3 and any(c.isdigit() for c in w)
        }
        return whole, inner

    def classes(c):
        return c.isalpha(), c.isdigit()

    def inside(a, b):
        short, long = sorted((a, b), key=len)
        at = long.find(short)
        if a == b or min(len(a), len(b)) < 5 or at < 0 or len(short) / len(long) < 0.4:
            return False
        end = at + len(short)
        left = at == 0 or long[at - 1] in joint or classes(long[at - 1]) != classes(short[0])
        right = end == len(long) or long[end] in joint or classes(long[end]) != classes(short[-1])
        return right and (left or end == len(long))

    def alike(a, b):
        if min(len(a), len(b)) < 5 or a in b or b in a:
            return False
        tail = lambda s: s[len(s.rstrip("0123456789")) :]
        if tail(a) and tail(b) and tail(a) != tail(b):
            return False
        grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
        return len(grams(a) & grams(b)) / min(len(grams(a)), len(grams(b))) >= 0.5

    def tier(token, text):
        mine, my_inner = parts(token)
        best = 0
        for other in text.split():
            theirs, their_inner = parts(other)
            if mine & theirs:
                return 5
            if any(inside(a, b) for a in mine for b in theirs):
                best = 3
            elif best < 2 and any(alike(a, b) for a in mine | my_inner for b in theirs | their_inner):
                best = 2
        return best

    for i, query in enumerate(asked):
        tiers = [[tier(token, text) for text in texts] for token in query.split()]
        for row in tiers:
            if max(row) > 2:
                row[:] = [0 if t == 2 else t for t in row]
        for d in range(len(texts)):
            column = [row[d] for row in tiers]
            want = (column.count(5), column.count(3), column.count(2))
            assert got.get((f"q{i}", f"d{d:02}"), (0, 0, 0)) == want, (query, texts[d])


def test_postings_skip_inactive_chunks(spark):
    chunks = chunk_rows(spark, [("a", 0, "red"), ("b", 0, "red")]).withColumn("is_active", F.col("document_id") == "a")
    assert {r.document_id for r in build_postings(chunks).collect()} == {"a"}


def test_stored_index_gives_the_same_result(spark, tmp_path):
    rows = [("a", 0, "node01-east red"), ("b", 0, "node01 red"), ("c", 0, "node01.easter blue")]
    chunks = chunk_rows(spark, rows)
    asked = questions(spark, [("q", "node01-east red"), ("r", "blue NODE01.EASTER.")])
    direct = keyword.retrieve_keyword(asked, chunks, 5).orderBy("query_id", "rank").collect()
    write_index(chunks, str(tmp_path))
    stored = keyword.retrieve_keyword(asked, None, 5, index=read_index(spark, str(tmp_path)))
    assert len(direct) > 3 and direct == stored.orderBy("query_id", "rank").collect()
    # In one document: its own identifiers decide, also from the stored index.
    inside = asked.withColumn("document_id", F.lit("b"))
    found = keyword.retrieve_keyword(inside, None, 5, index=read_index(spark, str(tmp_path))).collect()
    assert found == keyword.retrieve_keyword(inside, chunks, 5).collect() and {r.document_id for r in found} == {"b"}


def test_packs_hold_the_postings(spark):
    """Small packs, several projects and null names: packs and exploded terms are the same postings."""
    rng = random.Random(3)
    rows = [(f"d{k % 7}", k, " ".join(rng.choice(("red", "blue", "n1-x", "n2.y", "ab12")) for _ in range(6))) for k in range(60)]
    chunks = chunk_rows(spark, rows).withColumn("project_id", F.when(F.col("chunk_index") % 3 > 0, F.concat(F.lit("p"), F.col("chunk_index") % 3)))
    terms = chunk_terms(chunks)
    packs = pack_postings(terms, size=8).cache()
    assert max(len(r.chunk_ids) for r in packs.collect()) <= 8
    columns = ["project_id", "document_id", "document_name", "chunk_index", "chunk_id", "kind", "surface"]
    plain = sorted(map(str, explode_terms(terms).select(*columns).collect()))
    assert plain == sorted(map(str, explode_packs(packs).select(*columns).collect()))
    names = project_identifiers(packs)
    assert {(r.project_id, r.kind, r.surface) for r in names.collect()} == {
        (r.project_id, r.kind, r.surface) for r in explode_terms(terms).where("kind in ('w', 'd')").collect()
    }


def test_small_packs_change_no_rank(spark, monkeypatch):
    """With packs of three chunks most are skipped once a query has its best; results stay."""
    rng = random.Random(4)
    words = ["alpha", "beta", "node01-east", "node01", "node01-west", "gamma", "x9y8", "delta"]
    rows = [(f"d{k:02}", 0, " ".join(rng.choice(words) for _ in range(5))) for k in range(40)]
    asked = questions(spark, [(f"q{k}", " ".join(rng.sample(words, 3))) for k in range(6)])
    whole = keyword.retrieve_keyword(asked, chunk_rows(spark, rows), 4).collect()
    monkeypatch.setattr(keyword, "build_index", lambda chunks: _small_index(chunks))
    assert sorted(keyword.retrieve_keyword(asked, chunk_rows(spark, rows), 4).collect()) == sorted(whole)


def _small_index(chunks):
    built = build_index(chunks)
    return Index(pack_postings(chunk_terms(chunks).coalesce(1), size=3), built.vocabulary, built.counts)


def test_vector_threshold_nulls_and_zero_norm(spark):
    rows = [("close", 0, "x", [1.0, 0.0]), ("far", 0, "x", [0.0, 1.0]), ("none", 0, "x", None), ("zero", 0, "x", [0.0, 0.0]), ("back", 0, "x", [-1.0, 0.0])]
    chunks, asked = chunk_rows(spark, rows), questions(spark, [("q", "", [1.0, 0.0])])
    kept = vector.retrieve_vector(asked, chunks, 9, threshold=0.2).collect()
    assert [(r.document_id, r.vector_score) for r in kept] == [("close", 1.0)]
    names = [r.document_id for r in vector.retrieve_vector(asked, chunks, 9).orderBy("rank").collect()]
    assert names == ["close", "far", "zero"]


def test_vector_width_must_match(spark):
    chunks, asked = chunk_rows(spark, [("a", 0, "x", [1.0, 0.0, 0.0])]), questions(spark, [("q", "", [1.0, 0.0])])
    with pytest.raises(Exception, match="differ in length"):
        vector.retrieve_vector(asked, chunks, 3).collect()


def test_vector_blocks_match_plain_cosine(spark, monkeypatch):
    """Small blocks, many copies of one vector: order and ties equal a full sort."""
    monkeypatch.setattr(vector, "CHUNK_BLOCK", 16)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rng = random.Random(3)
    copy = [rng.gauss(0, 1) for _ in range(8)]
    vectors = {f"d{i:03}": copy if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)] for i in range(150)}
    asked = {f"q{i}": [rng.gauss(0, 1) for _ in range(8)] for i in range(7)}
    chunks = chunk_rows(spark, [(d, 0, "x", v) for d, v in vectors.items()])
    import numpy as np

    found = vector.retrieve_vector(questions(spark, [(q, "", v) for q, v in asked.items()]), chunks, 60, threshold=-1.0)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.document_id)

    def cosine(a, b):
        a, b = [np.float32(x).item() for x in a], [np.float32(x).item() for x in b]
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    for q, v in asked.items():
        want = sorted(vectors, key=lambda d: (-round(cosine(vectors[d], v), 12), d))[:60]
        assert got[q] == want


def test_join_small_has_a_way_beyond_its_bound(spark):
    large = spark.range(1000).withColumn("k", F.col("id") % 10)
    small = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for bound, plan in ((100, "BroadcastHashJoin"), (5, "SortMergeJoin")):
        joined = joins.join_small(large, small, ["k"], max_rows=bound)
        assert plan in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.agg(F.sum("v")).first()[0] == 9000


def route(spark, rows, score):
    df = spark.createDataFrame(rows, f"document_id string, {score} double")
    return df.select(
        F.lit("q").alias("query_id"), F.lit("p").alias("project_id"), "document_id",
        F.col("document_id").alias("document_name"), F.lit(0).alias("chunk_index"),
        F.col("document_id").alias("chunk_id"), score,
        *([F.lit(1).alias(name) for name in keyword.EVIDENCE] if score == "keyword_score" else []),
    )


def test_fusion_ranks_and_missing_sides(spark):
    fused = fusion.fuse_rrf(
        route(spark, [("a", 0.9), ("b", 0.9), ("c", 0.1)], "vector_score"),
        route(spark, [("d", 5.0), ("c", 4.0)], "keyword_score"),
        10, 0.5, 0.5,
    )
    got = {r.document_id: r for r in fused.collect()}
    assert (got["a"].vector_rank, got["b"].vector_rank, got["c"].vector_rank) == (1, 1, 3)
    assert (got["d"].vector_rank, got["d"].fused_score, got["a"].exact_identifiers) == (0, 0.5, 0)
    assert [r.document_id for r in fused.orderBy("rank").collect()] == ["c", "a", "b", "d"]
    with pytest.raises(ValueError):
        fusion.fuse_rrf(route(spark, [("a", 1.0)], "vector_score"), route(spark, [("a", 1.0)], "keyword_score"), 1, k=-1)


def test_rerank_prefers_overlap(spark):
    df = spark.createDataFrame(
        [("q", 1, "a", "Red car", "nothing", 0.9), ("q", 2, "b", "Red car", "a red CAR", 0.1), ("q", 3, "c", "Red car", "red", 0.5)],
        "query_id string, rank int, chunk_id string, query string, text string, fused_score double",
    )
    rows = rerank.rerank(df, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.reranker_score, r.pre_rerank_rank) for r in rows] == [("b", 1.0, 2), ("c", 0.5, 3)]


def test_evidence_protects_identifiers(spark):
    rows = [{"rank": i, "chunk_id": f"c{i}", "document_id": f"d{i}"} for i in range(1, 6)]
    rows[3]["exact_identifiers"] = 1
    rows[4]["contained_identifiers"] = 2
    got = evidence.select_evidence(pool(spark, rows), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.evidence_selection_reason) for r in got] == [
        ("c1", "ranked_fill"), ("c4", "protected_exact_identifier"), ("c5", "protected_contained_identifier")
    ]


def test_structural_dedup_is_greedy(spark):
    rows = [
        {"rank": 1, "chunk_id": "row2", "table_index": 0, "kind": "table_row", "data_row": 2},
        {"rank": 2, "chunk_id": "parent", "table_index": 0, "kind": "table", "first": 1, "last": 4},
        {"rank": 3, "chunk_id": "row3", "table_index": 0, "kind": "table_row", "data_row": 3},
        {"rank": 4, "chunk_id": "same", "table_index": 0, "kind": "table_row", "data_row": 3},
        {"rank": 5, "chunk_id": "text"},
    ]
    kept = {r.chunk_id for r in evidence.structural_dedup(pool(spark, rows)).collect()}
    assert kept == {"row2", "row3", "text"}


def test_request_validation_and_limits(spark):
    df = spark.createDataFrame([("a", " x ", 8), ("b", "  ", 8), ("c", "y", 51)], "query_id string, query string, top_k int")
    got = {r.query_id: r.reject_reason for r in fusion.validate_queries(df).collect()}
    assert got == {"a": None, "b": "query must not be empty", "c": "top_k is out of range"}
    wide = spark.range(1).select(fusion.pool_limit(F.lit("hybrid"), F.lit(8), F.lit(True), F.lit(8)))
    assert wide.first()[0] == 120


def test_folding_equals_full_case_folding(spark):
    """Every character whose folding is not its lower case, alone and inside a word."""
    chars = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c.lower()]
    df = spark.createDataFrame([(c,) for c in chars] + [(f"5 {c}B",) for c in chars], "c string")
    got = df.select("c", tx.casefold(F.col("c")).alias("f")).collect()
    assert [r.c for r in got if r.f != r.c.casefold()] == []


def test_a_task_lets_out_only_what_can_still_be_kept(spark):
    """Chunks of equal scores in many packs: a pack hands on those before the best the task has seen, not all it ties with."""
    chunks = chunk_rows(spark, [(f"d{(i * 37) % 400:03}", 0, "red " + ("blue" if i % 40 == 0 else "green")) for i in range(400)])
    packs = pack_postings(chunk_terms(chunks.coalesce(1)), 8)
    asked = keyword.with_scope(questions(spark, [("few", "red"), ("more", "red blue")]).withColumn("n", F.when(F.col("query_id") == "few", 3).otherwise(12)))
    terms = query_terms(asked)
    tiers = spark.createDataFrame([], "project_id string, scope string, query_id string, gid int, kind string, surface string, tier int")
    scored = keyword.score_packs(packs.coalesce(1), asked, terms, tiers, 750, F.col("n"))
    rows = [(r.query_id, -r.keyword_score, r.document_name) for r in scored.collect()]
    blue = [f"d{(i * 37) % 400:03}.txt" for i in range(0, 400, 40)]
    names = sorted(f"d{i:03}.txt" for i in range(400))
    assert sorted(r for r in rows if r[0] == "few")[:3] == [("few", -1.0, n) for n in names[:3]]
    wanted = sorted([(-2.0, n) for n in blue] + [(-1.0, n) for n in names if n not in blue])[:12]
    assert [r[1:] for r in sorted(r for r in rows if r[0] == "more")[:12]] == wanted
    # All 400 left the task for each question before.
    assert sum(r[0] == "few" for r in rows) < 40 and sum(r[0] == "more" for r in rows) < 150


def test_a_full_memory_forgets_no_result(spark, monkeypatch):
    """Where a task cannot remember the best chunks of all questions, more rows leave it and the result is the same."""
    chunks = chunk_rows(spark, [(f"d{i:02}", 0, "red node01-x" if i % 3 else "blue red") for i in range(60)])
    asked = questions(spark, [("a", "red node01"), ("b", "blue"), ("c", "red blue")])
    want = sorted(keyword.retrieve_keyword(asked, chunks, 4).collect())
    packs = pack_postings(chunk_terms(chunks.coalesce(1)), 5)
    best = keyword._Best()
    monkeypatch.setattr(keyword, "REMEMBERED", 3)
    best.put("p", "q", [(0.0, ("x",))] * 3)
    best.put("p", "r", [(0.0, ("y",))])
    assert best.of("p", "r") == [] and len(best.of("p", "q")) == 3
    best.put("other", "r", [(0.0, ("y",))] * 2)
    assert best.of("p", "q") == [] and best.count == 2
    own = build_index(chunks)
    assert sorted(keyword.retrieve_keyword(asked, None, 4, index=Index(packs, own.vocabulary, own.counts)).collect()) == want
