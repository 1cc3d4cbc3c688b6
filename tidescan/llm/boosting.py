"""Gradient-boosted trees for two classes: histogram splits on quantile bins, logistic loss, second-order leaves."""
from __future__ import annotations

import numpy as np


class Boosted:
    """Complete trees of a fixed depth, kept as arrays: a feature and threshold for each inner node, a value for each leaf."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.features = np.zeros((trees, (1 << depth) - 1), np.int32)
        self.cuts = np.full((trees, (1 << depth) - 1), np.inf)
        self.leaves = np.zeros((trees, 1 << depth))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for d in range(self.depth):
                first, n = (1 << d) - 1, 1 << d
                best, feature, cut = np.full(n, 1e-9), np.zeros(n, int), np.full(n, self.bins)
                total = [np.bincount(node, v, n) for v in (g, h)]
                for k in range(x.shape[1]):
                    at = node * (self.bins + 1) + binned[:, k]
                    lg, lh = (np.cumsum(np.bincount(at, v, n * (self.bins + 1)).reshape(n, -1), axis=1)[:, :-1] for v in (g, h))
                    rg, rh = total[0][:, None] - lg, total[1][:, None] - lh
                    gain = lg**2 / (lh + self.l2) + rg**2 / (rh + self.l2) - (total[0] ** 2 / (total[1] + self.l2))[:, None]
                    gain[(lh < 0.1) | (rh < 0.1)] = 0
                    j = gain.argmax(axis=1)
                    top = gain[np.arange(n), j]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], k, j[better]
                for m in range(n):
                    if cut[m] < len(edges[feature[m]]):
                        self.features[t, first + m], self.cuts[t, first + m] = feature[m], edges[feature[m]][cut[m]]
                node = node * 2 + (x[np.arange(len(y)), self.features[t, first + node]] > self.cuts[t, first + node])
            n = 1 << self.depth
            self.leaves[t] = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.l2)
            f += self.leaves[t][node]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = (1 << d) - 1 + node
                node = node * 2 + (x[rows, self.features[t, at]] > self.cuts[t, at])
            f += self.leaves[t][node]
        return f
