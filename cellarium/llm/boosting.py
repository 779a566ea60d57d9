"""Gradient-boosted trees for two classes: histograms, logistic loss, trees of one depth that predict a whole table at once."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rows, cols = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(cols)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin > b means x > cuts[b]
        base = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(base / (1 - base))), []
        margin = np.full(rows, self.base)
        flat = binned + np.arange(cols) * self.bins
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(rows, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                nodes, first = 2**level, 2**level - 1
                at = ((node - first)[:, None] * (cols * self.bins) + flat).ravel()
                size = nodes * cols * self.bins
                hg, hh = (np.bincount(at, np.repeat(v, cols), size).reshape(nodes, cols, self.bins).cumsum(2) for v in (g, h))
                tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
                gain = hg**2 / (hh + self.ridge) + (tg - hg) ** 2 / (th - hh + self.ridge) - tg**2 / (th + self.ridge)
                best = gain.reshape(nodes, -1).argmax(1)
                for k in range(nodes):
                    f, b = divmod(int(best[k]), self.bins)
                    if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                        feature[first + k], cut[first + k] = f, cuts[f][b]
                node = 2 * node + 1 + (x[np.arange(rows), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out, every = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out
