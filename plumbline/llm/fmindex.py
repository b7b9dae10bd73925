"""A compressed full-text index (FM-index) over integer symbols, in numpy, for many patterns at once.

The Burrows-Wheeler transform of a shard sits in a wavelet matrix: one bit vector per bit of the alphabet, packed in
64-bit words with a running count per word. A backward-search step for any number of patterns is one rank query per
bit. Suffixes are ordered by their first `depth` symbols (ties by position), which is exact for patterns up to that
length. Every SAMPLE-th text position is kept, others are located by walking back to one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling up to `depth` symbols, and the rank array of each doubling (1, 2, 4, ...)."""
    n = len(codes)
    rank = codes.astype(np.int64)
    levels = [rank.astype(np.int32)]
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(sorted_[1:] != sorted_[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        width *= 2
        levels.append(rank.astype(np.int32))
        if step[-1] == n - 1:
            break
    return order, levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], cap: int) -> np.ndarray:
    """lcp[i] = common prefix of suffixes i-1 and i in the order, at most what the levels can tell; lcp[0] and lcp[n] are
    -1."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n - 1, np.int64) if n else np.zeros(0, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        level = np.append(levels[j], np.int32(-1))
        same = (level[np.minimum(a, n)] == level[np.minimum(b, n)]) & (np.minimum(a, n) < n) & (np.minimum(b, n) < n)
        step = np.where(same, 1 << j, 0)
        a, b, out = a + step, b + step, out + step
    lcp = np.full(n + 1, -1, np.int64)
    if n:
        lcp[1:n] = np.minimum(out, cap)
    return lcp


def smaller_neighbours(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, the nearest position to the left and to the right with a smaller value (0 and n at the ends), by
    pointer jumping over candidates."""

    def left_of(v: np.ndarray) -> np.ndarray:
        ptr = np.arange(-1, len(v) - 1)
        ptr[0] = 0
        open_ = np.flatnonzero(v[np.maximum(ptr, 0)] >= v)
        open_ = open_[open_ > 0]
        while len(open_):
            ptr[open_] = ptr[ptr[open_]]
            p = ptr[open_]
            open_ = open_[(v[p] >= v[open_]) & (p > 0)]
        return ptr

    n = len(lcp) - 1
    return left_of(lcp), n - left_of(lcp[::-1].copy())[::-1]


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.n = len(symbols)
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        x = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((x >> level) & 1).astype(np.uint8)
            packed = np.zeros((self.n // 64 + 2) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1])
            self.zeros.append(self.n - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.start = self._walk(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self._ones(k, i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        return self._walk(symbol, i) - self.start[symbol]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position i, and how often it stands before i."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            ones = self._ones(k, i)
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            symbol = symbol * 2 + bit.astype(np.int64)
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return symbol, i - self.start[symbol]


class FMIndex:
    """Over codes 0..alphabet-1, where 0 separates texts; patterns hold no 0. The end of the text is one more symbol below
    all others. With `depth` the order is only exact for patterns up to that length and nothing can be located;
    `keep_order` keeps the order and its levels (for neighbour_lcp)."""

    def __init__(self, codes: np.ndarray, alphabet: int, depth: int | None = None, keep_order: bool = False):
        codes = np.append(codes + 1, 0)
        self.n = len(codes)
        order, levels = suffix_order(codes, depth or self.n)
        self.bwt = WaveletMatrix(codes[order - 1].astype(np.int64), alphabet + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=alphabet + 1))]).astype(np.int64)
        if not depth:
            self.is_sample = order % SAMPLE == 0
            self.sample_rank = np.concatenate([[0], np.cumsum(self.is_sample)])
            self.samples = order[self.is_sample]
        self.order, self.levels = (order, levels) if keep_order else (None, None)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extend each match [lo, hi) by a symbol to its left."""
        m, symbol = len(lo), symbol + 1
        both = self.first[np.concatenate([symbol, symbol])] + self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[:m], both[m:]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of a matrix of patterns of one length."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            a, b = self.step(patterns[live, j], lo[live], hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-order rows, by walking back to a sampled one; position 0 is sampled."""
        rows = rows.copy()
        out = np.zeros(len(rows), np.int64)
        walked = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.is_sample[rows[live]]
            at = live[hit]
            out[at] = self.samples[self.sample_rank[rows[at]]] + walked[at]
            live = live[~hit]
            symbol, r = self.bwt.access_rank(rows[live])
            rows[live] = self.first[symbol] + r
            walked[live] += 1
        return out
