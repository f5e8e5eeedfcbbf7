"""FM-index over word ids: wavelet-matrix ranks, backward search, locating by sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the only 0."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([False], key[order][1:] != key[order][:-1]))
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Index of one shard. Symbols are small non-negative integers; 0 ends the text and occurs once."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        row = self.bwt
        for b in reversed(range(self.bits)):
            bit = (row >> b) & 1
            self.levels.append((np.concatenate(([0], np.cumsum(bit))), int(n - bit.sum())))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.sampled = order % self.SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the first ``at`` symbols of the transform."""
        begin = np.zeros_like(at)
        for b, (ones, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            bit = (symbol >> b) & 1
            o_at, o_begin = ones[at], ones[begin]
            at = np.where(bit, zeros + o_at, at - o_at)
            begin = np.where(bit, zeros + o_begin, begin - o_begin)
        return at - begin

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array interval [low, high) of each pattern, right-aligned rows of ``patterns``."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for j in range(width):
            live = live[(lengths[live] > j) & (low[live] < high[live])]
            symbol = patterns[live, width - 1 - j]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix-array row: walk back to a sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.sample_rank[rows]] + steps
