"""FM-index of a sequence of small integers: suffix order, wavelet ranks, sampled positions.

Symbol 0 is a break: no phrase holds it, suffixes are compared up to it, and equal ones keep their
order.  The sequence must begin and end with a break.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions a suffix position is kept, besides those behind a break.
SAMPLE_RATE = 16


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions by suffix: prefixes of doubling length, only unresolved groups sorted again."""
    n = len(text)
    bits = max(1, int(sigma).bit_length())
    wide = max(1, 62 // bits)
    breaks = np.flatnonzero(text == 0)
    left = breaks[np.searchsorted(breaks, np.arange(n))] - np.arange(n) + 1
    key = np.zeros(n, np.int64)
    for k in range(wide):  # symbols behind the first break do not count
        key <<= bits
        if k < n:
            key[: n - k] |= np.where(left[: n - k] > k, text[k:], 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])
    depth = wide
    while True:
        done = left[order] <= depth  # equal up to the break: as they stand
        head |= done
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = start
        open_ = ~head
        open_[:-1] |= ~head[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        pos = order[at]
        sub = start[at] * np.int64(n + 1) + rank[pos + depth]
        by = np.argsort(sub, kind="stable")
        order[at], sub = pos[by], sub[by]
        head[at[1:]] |= sub[1:] != sub[:-1]
        depth *= 2


class Wavelet:
    """Wavelet matrix: one bit row per symbol bit, ranks by 64-bit words with running counts."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n, self.bits = len(text), max(1, int(sigma).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        rows = text.astype(np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = (rows >> np.uint32(level)) & np.uint32(1) == 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            packed[: (self.n + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(ones.sum()))
            rows = np.concatenate([rows[~bit], rows[bit]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position of a level."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of each symbol before each position."""
        first = np.zeros_like(at)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            x, y = self.ones(level, first), self.ones(level, at)
            first = np.where(one, self.zeros[level] + x, first - x)
            at = np.where(one, self.zeros[level] + y, at - y)
        return at - first

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its places before it."""
        symbol, first = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            x, y = self.ones(level, first), self.ones(level, at)
            first = np.where(one, self.zeros[level] + x, first - x)
            at = np.where(one, self.zeros[level] + y, at - y)
            symbol = symbol << 1 | one
        return symbol, at - first


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, rate: int = SAMPLE_RATE):
        order = suffix_order(text, sigma)
        self.n = len(text)
        last = text[order - 1]  # the suffix at 0 has the break at the end before it
        self.tree = Wavelet(last, sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        behind = np.zeros(self.n, bool)
        behind[1:] = text[:-1] == 0
        kept = (order % rate == 0) | behind[order]
        self.kept = np.packbits(kept, bitorder="little")
        before = np.cumsum(kept)
        self.before = (before - kept)[::8].astype(np.int64)
        self.samples = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each row of symbols, by backward search; empty where it is absent."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k].astype(np.int64)
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        absent = hi <= lo
        lo[absent] = hi[absent] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: walk back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        at, live, step = rows.copy(), np.arange(len(rows)), 0
        while len(live):
            byte = self.kept[at >> 3]
            bit = (at & 7).astype(np.uint8)
            found = (byte >> bit) & 1 == 1
            number = self.before[at >> 3] + np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[live[found]] = self.samples[number[found]] + step
            live, at = live[~found], at[~found]
            symbol, rank = self.tree.symbol_and_rank(at)
            at = self.less[symbol] + rank
            step += 1
        return out
