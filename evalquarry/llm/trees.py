"""Histogram gradient-boosted trees, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Tree t, node n: feature and threshold of the split (feature -1: none), children 2n + 1 and 2n + 2, value of a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows go down a tree one level at a time."""
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            raw += value[node]
        return 1 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Forest:
    """Second-order boosting of the logistic loss on binned features."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])  # bin b: at most cuts[b]
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    threshold, value = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    flat = binned + np.arange(d) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            here = node >= first
            slot = ((node[here] - first)[:, None] * (d * bins) + flat[here]).ravel()
            tables = [np.bincount(slot, np.repeat(w[here], d), many * d * bins).reshape(many, d, bins).cumsum(axis=2) for w in (grad, hess, np.ones(n))]
            g, h, c = tables
            g_all, h_all, c_all = (q[:, :1, -1:] for q in tables)
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain = np.where((c >= least) & (c_all - c >= least), gain, -1)[:, :, :-1].reshape(many, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(many), best] > 1e-9
            f, b = best // (bins - 1), best % (bins - 1)
            for k in np.flatnonzero(good):
                feature[t, first + k], threshold[t, first + k] = f[k], cuts[f[k]][b[k]]
            at = np.where(here, np.maximum(node - first, 0), 0)
            split = here & good[at]
            right = binned[np.arange(n), f[at]] > b[at]
            node = np.where(split, 2 * node + 1 + right, node)
        value[t] = -rate * np.bincount(node, grad, nodes) / (np.bincount(node, hess, nodes) + ridge)
        raw += value[t][node]
    return Forest(feature, threshold, value, base, depth)
