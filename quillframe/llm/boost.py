"""A small gradient-boosted tree classifier, fitted on the driver from a bounded sample and carried to the workers."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Logistic loss, depth-limited trees over quantile bins."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 5.0) -> None:
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature = np.full(2**self.depth - 1, -1)
            limit = np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    mine = np.nonzero(node == k)[0]
                    best = (1e-3, -1, 0)
                    total_g, total_h = g[mine].sum(), h[mine].sum()
                    for f in range(x.shape[1]):
                        if not len(edges[f]) or len(mine) < 2:
                            continue
                        sg = np.bincount(binned[mine, f], g[mine], len(edges[f]) + 1).cumsum()[:-1]
                        sh = np.bincount(binned[mine, f], h[mine], len(edges[f]) + 1).cumsum()[:-1]
                        ok = (sh > 0.5) & (total_h - sh > 0.5)
                        gain = np.where(ok, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), -1)
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (float(gain[b]), f, b)
                    if best[1] >= 0:
                        feature[k], limit[k] = best[1], edges[best[1]][best[2]]
                        node[mine] = 2 * k + 1 + (x[mine, best[1]] > limit[k])
                    else:
                        node[mine] = 2 * k + 1
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1) * self.rate
            self.model.append((feature, limit, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        x = np.asarray(x, np.float64)
        score = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, limit, value in self.model:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = (f >= 0) & (x[row, np.maximum(f, 0)] > limit[node])
                node = 2 * node + 1 + right
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
