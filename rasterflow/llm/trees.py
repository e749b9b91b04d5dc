"""Boosted trees for small training sets: logistic loss, shallow trees over binned features. Fitted on the driver on a
bounded sample; the model is a few arrays, sent with the tasks."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of a fixed depth; node k has children 2k+1 and 2k+2; a missing split sends all rows left."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 16, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        p = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.bias)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**self.depth)
            node = np.zeros(len(y), int)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                for j, e in enumerate(edges if len(rows) else []):
                    gs, hs = (np.cumsum(np.bincount(code[rows, j], v[rows], len(e) + 1))[:-1] for v in (g, h))
                    gt, ht = g[rows].sum(), h[rows].sum()
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least / 10) | (ht - hs < self.least / 10)] = 0
                    if len(gain) and gain.max() > best:
                        best, feature[k], cut[k] = gain.max(), j, e[gain.argmax()]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            for k in range(2**self.depth):
                rows = node == inner + k
                leaf[k] = self.rate * g[rows].sum() / (h[rows].sum() + 1)
            f += leaf[node - inner]
            self.trees.append((feature, cut, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        every = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out
