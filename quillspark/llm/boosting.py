"""Gradient-boosted trees and isotonic regression in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees of a fixed depth on binned features, grown by Newton steps on the logistic loss."""

    def __init__(self, depth: int = 3, count: int = 80, rate: float = 0.15, bins: int = 32, ridge: float = 1.0):
        self.depth, self.count, self.rate, self.bins, self.ridge = depth, count, rate, bins, ridge
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], steps)) for j in range(x.shape[1])]
        binned = self._binned(x)
        mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, weight * (p - y), weight * p * (1 - p))
            self.trees.append(tree)
            raw += self._apply(binned, tree)
        return self

    def _grow(self, binned, g, h):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, self.bins, dtype=np.int64)
        node = np.zeros(len(g), dtype=np.int64)
        for i in range(inner):
            here = np.flatnonzero(node == i)
            best = 1e-6
            total_g, total_h = g[here].sum(), h[here].sum()
            for j in range(binned.shape[1]):
                left_g = np.cumsum(np.bincount(binned[here, j], weights=g[here], minlength=self.bins))[:-1]
                left_h = np.cumsum(np.bincount(binned[here, j], weights=h[here], minlength=self.bins))[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(left_h < 0.5) | (total_h - left_h < 0.5)] = 0
                if len(gain) and gain.max() > best:
                    best, feature[i], cut[i] = gain.max(), j, gain.argmax()
            node[here] = 2 * i + 1 + (binned[here, feature[i]] > cut[i])
        leaf = node - inner
        n = 1 << self.depth
        value = -self.rate * np.bincount(leaf, weights=g, minlength=n) / (np.bincount(leaf, weights=h, minlength=n) + self.ridge)
        return feature, cut, value

    def _apply(self, binned, tree):
        feature, cut, value = tree
        node = np.zeros(len(binned), dtype=np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.base + sum((self._apply(binned, t) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function closest to y, by pooling adjacent violators: mean score and value of each pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v, w in zip(score[order], y[order], weight[order]):
        pools.append([s * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array([p[0] / p[2] for p in pools])
    value = np.array([p[1] / p[2] for p in pools])
    return at, value
