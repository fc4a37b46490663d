"""An FM-index over integer symbols: suffix order, wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(n, dtype=np.int64)
    by_order = symbols[order]
    heads = np.flatnonzero(np.r_[True, by_order[1:] != by_order[:-1]])
    ranks[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    length = 1
    sizes = np.diff(np.r_[heads, n])
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(tied):
        at = order[tied]
        ahead = at + length
        next_ = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)], -1)
        own = ranks[at]
        again = np.lexsort((next_, own))
        at, own, next_ = at[again], own[again], next_[again]
        order[tied] = at
        fresh = np.r_[True, (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[heads, len(at)])
        ranks[at] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        length *= 2
    return order


class WaveletTree:
    """Ranks of symbols 0 .. sigma - 1: a bit of each symbol per level, zeros sorted before ones."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros(len(symbols), dtype=np.int64), ends.astype(np.int64)
        for k in range(self.levels):
            one = (symbols >> (self.levels - 1 - k)) & 1 == 1
            ones = self.ones[k]
            low = np.where(one, self.zeros[k] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[k] + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Finds phrases in one text of symbols 0 .. sigma - 1.

    Symbol 0 separates: it never occurs in a phrase. The position of every `every`-th symbol, and of every
    symbol after a separator, is kept, so a walk back from an occurrence stops before it meets one.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = 16) -> None:
        n = len(symbols)
        suffixes = suffix_array(symbols)
        self.last = symbols[suffixes - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))]
        self.tree = WaveletTree(self.last, sigma)
        kept = (suffixes % every == 0) | (self.last == 0)
        self.kept = kept
        self.before = np.cumsum(kept) - kept
        self.positions = suffixes[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase; a phrase of -1 symbols is padded at its start."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, k] >= 0) & (low < high))
            if not len(live):
                continue
            symbols = phrases[live, k]
            low[live] = self.first[symbols] + self.tree.rank(symbols, low[live])
            high[live] = self.first[symbols] + self.tree.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows, by steps back to a kept one."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.kept[at])
        while len(walking):
            symbols = self.last[at[walking]]
            at[walking] = self.first[symbols] + self.tree.rank(symbols, at[walking])
            steps[walking] += 1
            walking = walking[~self.kept[at[walking]]]
        return self.positions[self.before[at]] + steps
