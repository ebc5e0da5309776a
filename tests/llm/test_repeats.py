from __future__ import annotations

import hashlib

import numpy as np
import pytest

from corpuslens.llm import repeats
from corpuslens.llm.runindex import RunIndex, repeated_windows

DOCS = "doc_id long, text string, key string, spans string"


def brute(docs, window):
    texts = [(t or "").encode() for _, t, *_ in docs]
    seen = {}
    for t in texts:
        for k in range(len(t) - window + 1):
            seen[t[k : k + window]] = seen.get(t[k : k + window], 0) + 1
    out = []
    for (doc, *_), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, window):
    letters = "abcdé \n"
    prose = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [prose(rng.randrange(window // 2, 4 * window)) for _ in range(6)]
    texts = [None, "", "x", "ab" * 300, "a" * 700, prose(window), shared[0], shared[0]]
    for _ in range(40):
        texts.append("".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng.randrange(1, 2 * window)) for _ in range(rng.randrange(1, 6))))
    base = prose(1500)
    texts += [base, base, base[:700] + "#" + base[700:], base[200:]]
    return [(k % 50, t, "k", "s") for k, t in enumerate(texts)] + [(None, shared[1], None, None)]


@pytest.mark.parametrize(("window", "gram", "crowd"), [(200, 32, 2048), (50, 8, 1), (40, 32, 3)])
def test_equals_brute_force(spark, rng, window, gram, crowd):
    docs = corpus(rng, window)
    got = repeats.remove_repeats(
        spark.createDataFrame(docs, DOCS), window=window, gram=gram, anchor_segments=crowd, shard_bytes=4000, emit_text=True
    ).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(docs, window)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans for r in got)


def test_crowded_anchors(spark, rng, monkeypatch):
    """One passage in many different surroundings: every level of division decides some windows."""
    window, gram = 60, 16
    letters = "abcdefgh"
    prose = lambda n: "".join(rng.choice(letters) for _ in range(n))
    line, long_ = prose(40), prose(90)
    docs = [(k, prose(rng.randrange(50)) + line + prose(rng.randrange(50)), None, None) for k in range(60)]
    docs += [(100 + k, line[:30] + prose(5) + long_[rng.randrange(30) :] + prose(9), None, None) for k in range(40)]
    docs += [(200 + k, prose(3) + line + "same tail of all of them, and long enough"[: 10 + k], None, None) for k in range(25)]
    levels = []
    real = repeats._divide
    monkeypatch.setattr(repeats, "_divide", lambda *given: levels.append(given[2]) or real(*given))
    got = repeats.remove_repeats(spark.createDataFrame(docs, DOCS), window=window, gram=gram, anchor_segments=4, shard_bytes=2000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(docs, window)
    assert levels == [4, 16, window - gram + 1]


def test_division_keeps_every_window_once(rng):
    """Equal windows of different segments fall into groups of the same name, each window into one."""
    window, gram = 60, 16
    data = np.frombuffer(bytes(rng.choice(b"abcdef") for _ in range(3000)), np.uint8)
    data = np.concatenate([data, data[500:1500], data[100:700]])
    groups = {}
    for _, starts, counts in repeats.segments(data, np.array([0, len(data)]), window, gram):
        for s, n in zip(starts.tolist(), counts.tolist()):
            text = data[s : s + n + window - 1].tobytes()
            held = []
            for group, first, windows in repeats.divided(text, window, gram, 4):
                for k in range(first, first + windows):
                    held.append(k)
                    groups.setdefault(text[k : k + window], set()).add(group)
            assert sorted(held) == list(range(n))
    assert all(len(g) == 1 for g in groups.values())


def test_matching_statistics(rng):
    for _ in range(15):
        strings = [bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 8))]
        text = [0]
        for s in strings:
            text += [b + 1 for b in s] + [0]
        got = RunIndex(np.array(text)).matching_statistics()
        for p in range(len(text)):
            best = 0
            for q in range(len(text)):
                n = 0
                while q != p and max(p, q) + n < len(text) and text[p + n] == text[q + n] != 0:
                    n += 1
                best = max(best, n)
            assert got[p] == best
        assert [x.tolist() for x in repeated_windows([b"abcabc", b"xbca"], 3)] == [[0, 1, 3], [1]]


def test_blocks_do_not_lose_windows(rng, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(1000)), np.uint8)
    offsets = np.array([0, 300, 310, 310, 1000])
    held = []
    for _, start, n in repeats.segments(data, offsets, 20, 8):
        for s, k in zip(start.tolist(), n.tolist()):
            held += range(s, s + k)
    want = [p for a, b in zip(offsets, offsets[1:]) for p in range(a, b - 19)]
    assert held == want


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    one = repeats.remove_repeats(spark.createDataFrame([(1, "a" * 199, None, None)], DOCS)).first()
    assert (one.n_removed, one.n_bytes) == (0, 199)
