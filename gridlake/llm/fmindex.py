"""An FM-index over a sequence of small integers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; the last symbol must be smaller than all others."""
    _, rank = np.unique(text, return_inverse=True)
    rank, n, step = rank.astype(np.int64), len(text), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(pair[order], prepend=pair[order[:1]]) > 0)
        if step >= n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class Wavelet:
    """A wavelet matrix: rank and access of symbols, a level of bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            ranks = np.zeros(len(ones) + 1, np.int32 if len(ones) < 1 << 31 else np.int64)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, ones, ranks, len(symbols) - int(ranks[-1])))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros_like(at)
        for bit, _, ranks, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            begin = np.where(one, zeros + ranks[begin], begin - ranks[begin])
            at = np.where(one, zeros + ranks[at], at - ranks[at])
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bit, ones, ranks, zeros in self.levels:
            one = ones[at]
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ranks[at], at - ranks[at])
        return symbol


class FMIndex:
    """Index of a text whose symbols are 1 or more; 0 is its end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.largest = int(text.max())
        bwt = text[order - 1]
        self.wavelet = Wavelet(bwt, self.largest)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.largest + 1))))
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (rows of symbols, 0 beyond their length), all by the same backward steps."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.sampled), np.int64)
        for step in range(int(length.max(initial=0))):
            on = np.flatnonzero((step < length) & (lo < hi))
            symbol = phrases[on, length[on] - 1 - step].astype(np.int64)
            known = symbol <= self.largest
            lo[on[~known]] = hi[on[~known]] = 0
            on, symbol = on[known], symbol[known]
            lo[on] = self.below[symbol] + self.wavelet.rank(symbol, lo[on])
            hi[on] = self.below[symbol] + self.wavelet.rank(symbol, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix."""
        rows, out, walked, left = rows.copy(), np.empty_like(rows), 0, np.arange(len(rows))
        while len(left):
            here = self.sampled[rows[left]]
            done = left[here]
            out[done] = self.samples[self.sample_rank[rows[done]]] + walked
            left = left[~here]
            symbol = self.wavelet.access(rows[left])
            rows[left] = self.below[symbol] + self.wavelet.rank(symbol, rows[left])
            walked += 1
        return out
