"""Run-length index of byte strings: a run-compressed Burrows-Wheeler transform whose run ends keep
their suffix positions, and the matching statistics that follow from them.

Between equal neighbours of the transform a match shortens by one per place, so the length of the
longest other match need only be compared at run ends; one pass over the text hands it on.
"""

from __future__ import annotations

import numpy as np

from corpuslens.llm.fmindex import suffix_order

_SYMBOLS = 7  # of 9 bits in one word of the comparisons


class RunIndex:
    """``text``: symbols 1 to 256, a 0 before, between and behind the strings."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text, 256)
        last = text[order - 1]
        new = np.append(True, (last[1:] != last[:-1]) | (last[1:] == 0))
        self.text = text
        self.heads = np.flatnonzero(new)  # first row of each run
        self.symbols = last[self.heads]
        self.head_at = order[self.heads]  # suffix positions at run heads and run ends,
        self.end_at = order[np.append(self.heads[1:], len(order)) - 1]
        # and those of the neighbours outside the run.
        self.before = np.append(-1, self.end_at[:-1])
        self.after = np.append(self.head_at[1:], -1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to the next 0."""
        n = len(self.text)
        packed = np.zeros(n + _SYMBOLS, np.int64)
        padded = np.concatenate([self.text, np.zeros(2 * _SYMBOLS, self.text.dtype)]).astype(np.int64)
        for k in range(_SYMBOLS):
            packed = packed << 9 | padded[k : k + n + _SYMBOLS]
        holds = np.zeros(n + _SYMBOLS, bool)  # a 0 within the word
        for k in range(_SYMBOLS):
            holds |= padded[k : k + n + _SYMBOLS] == 0
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            go = (packed[x] == packed[y]) & ~holds[x]
            rest = live[~go]
            x, y = x[~go], y[~go]
            open_ = np.ones(len(rest), bool)
            for k in range(_SYMBOLS):
                open_ &= (padded[x + k] == padded[y + k]) & (padded[x + k] != 0)
                out[rest] += open_
            live = live[go]
            out[live] += _SYMBOLS
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every place the length of its longest match elsewhere in the text."""
        n = len(self.text)
        reach = np.full(n, -1, np.int64)
        for own, other in ((self.head_at, self.before), (self.end_at, self.after)):
            np.maximum.at(reach, own, own + self._common(own, other))
        place = np.arange(n)
        return np.maximum(np.maximum.accumulate(reach) - place, 0)


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string the places where a window begins that begins anywhere else as well."""
    size = sum(map(len, strings)) + len(strings) + 1
    text = np.zeros(size, np.int64)
    starts, at = [], 1
    for s in strings:
        text[at : at + len(s)] = np.frombuffer(s, np.uint8)
        text[at : at + len(s)] += 1
        starts.append(at)
        at += len(s) + 1
    long_ = RunIndex(text).matching_statistics() >= window
    return [np.flatnonzero(long_[a : a + len(s)]) for a, s in zip(starts, strings, strict=True)]
