"""An FM-index over word numbers: backward search by wavelet ranks, locate by sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order; every 0 is a separator of its own, so comparisons end at the next 0."""
    n = len(symbols)
    zeros = symbols == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, symbols.astype(np.int64) + int(zeros.sum()))
    reach = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - reach] = rank[reach:] + 1 if reach < n else 0
        ahead[zeros] = 0
        key = rank * np.int64(n + int(symbols.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        steps = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        new[order] = steps
        if steps[-1] == n - 1:
            return order
        rank = new
        reach *= 2


class FMIndex:
    """Index of one shard's symbols (0 separates passages and closes the sequence)."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))))
        self.bits = max(1, int(alphabet).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = bwt
        for shift in range(self.bits - 1, -1, -1):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        # a position is sampled every SAMPLE symbols and at each passage start, so no walk crosses a separator
        previous = np.concatenate(([0], symbols[:-1]))
        keep = (np.arange(len(symbols)) % SAMPLE == 0) | (previous == 0)
        self.marked = keep[order]
        self.slot = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]
        self.length = len(symbols)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each row."""
        low, high = np.zeros_like(row), row
        for depth, ones in enumerate(self.ones):
            up = (symbol >> (self.bits - 1 - depth)) & 1 == 1
            a, b = ones[low], ones[high]
            low = np.where(up, self.zeros[depth] + a, low - a)
            high = np.where(up, self.zeros[depth] + b, high - b)
        return high - low

    def backward(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer to the left."""
        symbol = np.zeros_like(row)
        at = row
        for depth, ones in enumerate(self.ones):
            a = ones[at]
            up = ones[at + 1] > a
            symbol = symbol * 2 + up
            at = np.where(up, self.zeros[depth] + a, at - a)
        return self.before[symbol] + self.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the patterns (one per line, equal lengths) that occur."""
        alive = np.arange(len(patterns))
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.length, dtype=np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            start = self.before[symbol]
            low, high = start + self.rank(symbol, low), start + self.rank(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            here = self.marked[at]
            out[todo[here]] = self.sampled[self.slot[at[here]]] + walked
            todo, at = todo[~here], at[~here]
            walked += 1
            if len(todo):
                at = self.backward(at)
        return out
