from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from corpuslens.llm.sharding import PHASES, _settle, ranked, shard

DOCS = "doc_id long, text string, shard string"


def check_law(rows, docs, shards):
    """Each row once, sizes at most one apart, gapless slots, figures of the texts."""
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert set(slots) == set(range(shards)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def split_groups(rows, docs, shards):
    """(groups that fit a shard, those of them in several shards), by unique ids."""
    text = {d[0]: d[1] for d in docs}
    found, copies = defaultdict(set), Counter(d[1] for d in docs if d[1] is not None)
    for r in rows:
        if text[r.doc_id] is not None and 1 < copies[text[r.doc_id]] <= len(docs) // shards:
            found[text[r.doc_id]].add(r["shard"])
    return len(found), sum(len(s) > 1 for s in found.values())


def test_law_slots_and_links(spark, rng):
    docs = [(k, f"text {k}", None) for k in range(300)]
    docs += [(1000 + k, f"group {k // 3}", "x") for k in range(90)]
    docs += [(2000 + k, "hot", "x") for k in range(200)]
    docs += [(3000, None, None), (3001, None, None), (3002, "", None), (None, "é" * 9000, None), (5, "text 5", None)]
    rng.shuffle(docs)
    rows = shard(spark.createDataFrame(docs, DOCS).repartition(5), shards=8).collect()
    check_law(rows, docs, 8)
    assert split_groups(rows, docs, 8) == (31, 0)
    hot = Counter(r["shard"] for r in rows if r.doc_id and 2000 <= r.doc_id < 3000)
    assert sorted(hot.values()) == [66, 67, 67]  # three parts, each whole


def test_crowded(spark, rng):
    """A third in one group, nearly all others linked, little room besides: under one group in twenty is split."""
    docs, at, group = [(k, "hot", None) for k in range(1500)], 1500, 0
    while at < 4300:
        size = min(rng.randrange(2, 51), 4300 - at)
        docs += [(at + k, f"group {group}", None) for k in range(size)]
        at, group = at + size, group + 1
    docs += [(at + k, f"single {k}", None) for k in range(200)]
    rng.shuffle(docs)
    rows = shard(spark.createDataFrame(docs, DOCS).repartition(4)).collect()
    check_law(rows, docs, 16)
    groups, split = split_groups(rows, docs, 16)
    assert groups > 90 and split <= 0.05 * groups


def test_no_room_as_a_whole(spark):
    """Three groups of three in four shards of two or three rows: sizes win, what fits stays whole."""
    docs = [(k, f"g{k // 3}", None) for k in range(9)]
    rows = shard(spark.createDataFrame(docs, DOCS), shards=4).collect()
    check_law(rows, docs, 4)


def test_settled_parts_equal_a_plain_model(spark, rng):
    """The same rounds over lists."""
    parts = [(rng.getrandbits(60), rng.randrange(2, 40)) for _ in range(120)]
    made = [(p, n, [0] * 4) for p, n in parts]
    for _, n, votes in made:
        for _ in range(n):
            votes[rng.randrange(4)] += 1
    room = [700, 500, 500, 300]
    settled, left = _settle(spark.createDataFrame(made, "part long, rows long, votes array<long>"), room, 500)
    got = {r["part"]: r["shard"] for r in settled.collect()}
    hashes = {
        (r.p, r.k): r.h
        for r in spark.createDataFrame([(p, k) for p, _ in parts for k in range(4)], "p long, k int").selectExpr("p", "k", "xxhash64(p, k) as h").collect()
    }
    home, free, todo = {}, list(room), made
    for least in (*(max(2, 500 // p) for p in PHASES), 0):
        while True:
            queues = defaultdict(list)
            for p, n, votes in todo:
                can = [(votes[k], hashes[p, k], k) for k in range(4) if free[k] >= n]
                if n >= least and can:
                    k = max(can)[2]
                    queues[k].append((-n, hashes[p, k] % 64, hashes[p, k], p))
            granted = {}
            for k, queue in queues.items():
                total = 0
                for less, _, _, p in sorted(queue):
                    total -= less
                    if total <= free[k]:
                        granted[p] = (k, -less)
            if not granted:
                break
            for p, (k, n) in granted.items():
                home[p], free[k] = k, free[k] - n
            todo = [x for x in todo if x[0] not in granted]
    assert got == home and left == free


def test_small_and_empty(spark):
    assert shard(spark.createDataFrame([], DOCS)).count() == 0
    rows = shard(spark.createDataFrame([(1, "a", None), (1, "a", None)], DOCS)).collect()
    assert {r.slot for r in rows} == {0} and len(rows) == 2


def test_ranks_are_gapless(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "xxhash64(id) as h", "id as row_hash")
    rows = ranked(df, ["k"], "h", "r", buckets=7).collect()
    for k in range(3):
        own = sorted(r.r for r in rows if r.k == k)
        assert own == list(range(len(own)))
