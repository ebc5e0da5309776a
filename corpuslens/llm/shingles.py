"""Distinct word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from corpuslens.llm.common import flat

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG_WORD = 48


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _A
    x = (x ^ x >> np.uint64(29)) * _B
    return x ^ x >> np.uint64(32)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end); words are runs of other than
    ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    data, offsets = flat(column)
    data = _LOWER[data]
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(word & ~(np.append(False, word[:-1]) & ~cut[:-1]))
    end = np.flatnonzero(word & ~(np.append(word[1:], False) & ~cut[1:])) + 1
    size = end - start
    h = size.astype(np.uint64)
    live = np.flatnonzero(size <= LONG_WORD)
    for k in range(LONG_WORD):
        live = live[size[live] > k]
        if not len(live):
            break
        x = h[live] * _A + data[start[live] + k]
        h[live] = x ^ x >> np.uint64(29)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest()
        h[k] = int.from_bytes(digest, "little")
    return mix(h), np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` consecutive words, or all words of a
    shorter text as one."""
    h, of = word_hashes(column)
    grams = h.copy()
    for k in range(1, width):
        if len(h) > k:
            grams[:-k] = grams[:-k] * _B + h[k:]
    grams = mix(grams)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            whole = hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
