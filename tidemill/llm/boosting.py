"""Gradient-boosted trees over binned features, and their evaluation as flat arrays.

The trees are grown breadth first on histograms of gradients for the logistic loss. Every tree is a
complete binary tree stored in three arrays (feature, threshold, value), so many rows walk down
together: ``node = 2 * node + 1 + (x[feature[node]] > threshold[node])``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """``feature`` and ``threshold``: (trees, inner nodes); ``value``: (trees, leaves); a node without a split sends all rows left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, min_weight: float = 1.0) -> Trees:
    """Fit on rows ``x`` and labels 0 or 1. With one class only, or no row, the score is constant."""
    n, d = x.shape if len(x) else (0, x.shape[1])
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature[:0], threshold[:0], value[:0])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(n, base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = node - first
            best = np.full(width, 1e-9)
            for j in range(d):
                at = here * BINS + binned[:, j]
                g = np.bincount(at, grad, width * BINS).reshape(width, BINS)
                h = np.bincount(at, hess, width * BINS).reshape(width, BINS)
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                ga, ha = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < min_weight) | (ha - hl < min_weight)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(width), top] > best)
                best[better] = gain[better, top[better]]
                feature[k, first + better] = j
                threshold[k, first + better] = cuts[j][top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value[k] = -rate * g / (h + ridge)
        total += value[k][leaf]
    return Trees(base, feature, threshold, value)
