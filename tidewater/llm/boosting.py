"""Gradient-boosted trees for a few classes, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Softmax boosting of depth-limited regression trees on binned features."""

    def __init__(self, rounds: int = 25, depth: int = 4, rate: float = 0.3, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.start = np.zeros(0)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        bins = self._binned(x)
        target = np.eye(classes)[y]
        self.start = np.log(target.mean(0) + 1e-6)
        z = np.tile(self.start, (len(y), 1))
        for _ in range(self.rounds):
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grown = []
            for k in range(classes):
                tree = self._tree(bins, p[:, k] - target[:, k], p[:, k] * (1 - p[:, k]))
                z[:, k] += tree[2][self._leaf(tree, bins)]
                grown.append(tree)
            self.trees.append(grown)
        return self

    def _tree(self, bins, g, h):
        """A full binary tree as arrays: feature, bin and value per node (children at 2i + 1 and 2i + 2)."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(g), int)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -self.rate * gs / (hs + self.ridge)
            if node >= size // 2 or len(rows) < 2 * self.least:
                continue
            width, features = BINS + 1, bins.shape[1]
            flat = (bins[rows] + np.arange(features) * width).ravel()
            total = lambda w: np.bincount(flat, np.repeat(w, features), features * width).reshape(features, width).cumsum(1)[:, :-1]
            gl, hl, nl = total(g[rows]), total(h[rows]), total(np.ones(len(rows)))
            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
            best = int(gain.argmax())
            if gain.flat[best] <= 1e-9:
                continue
            feature[node], cut[node] = divmod(best, width - 1)
            right = bins[rows, feature[node]] > cut[node]
            at[rows] = 2 * node + 1 + right
        return feature, cut, value

    def _leaf(self, tree, bins) -> np.ndarray:
        feature, cut, _ = tree
        at = np.zeros(len(bins), int)
        every = np.arange(len(bins))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            down = 2 * at + 1 + (bins[every, np.maximum(f, 0)] > cut[at])
            at = np.where(inner, down, at)
        return at

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        z = np.tile(self.start, (len(x), 1))
        for grown in self.trees:
            for k, tree in enumerate(grown):
                z[:, k] += tree[2][self._leaf(tree, bins)]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))
