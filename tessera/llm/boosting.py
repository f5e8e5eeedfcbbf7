"""Gradient-boosted regression trees for two classes, in numpy: histogram splits, logistic loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Full binary trees of ``depth``; node ``i`` has children ``2i + 1`` and ``2i + 2``, leaves follow."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 24, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.cut = np.full((self.n_trees, inner), np.inf)
        self.value = np.zeros((self.n_trees, leaves))
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                gain = np.full((width, m), -1.0)
                place = np.zeros((width, m), np.int64)
                for j in range(m):
                    size = len(cuts[j]) + 1
                    key = (node - first) * size + binned[:, j]
                    g = np.bincount(key, grad, width * size).reshape(width, size).cumsum(1)
                    h = np.bincount(key, hess, width * size).reshape(width, size).cumsum(1)
                    if size < 2:
                        continue
                    gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    got = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    got[(hl < self.least) | (ha - hl < self.least)] = -1
                    place[:, j] = got.argmax(1)
                    gain[:, j] = got.max(1)
                best = gain.argmax(1)
                for k in range(width):
                    if gain[k, best[k]] > 1e-6:
                        self.feature[t, first + k] = best[k]
                        self.cut[t, first + k] = cuts[best[k]][place[k, best[k]]]
                node = self._step(x, t, node)
            leaf = node - inner
            self.value[t] = self.rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + 1)
            score += self.value[t][leaf]
        return self

    def _step(self, x: np.ndarray, t: int, node: np.ndarray) -> np.ndarray:
        return 2 * node + 1 + (x[np.arange(len(x)), self.feature[t][node]] > self.cut[t][node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        score = np.full(len(x), self.base)
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._step(x, t, node)
            score += self.value[t][node - 2**self.depth + 1]
        return score
