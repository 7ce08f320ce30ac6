"""Small gradient-boosted trees for binary labels, in numpy.

Features are binned by quantiles, trees have a fixed depth and are stored as arrays, so a model is a
few kilobytes and scoring a batch is a few array lookups.
"""

from __future__ import annotations

import numpy as np


SLACK = 0.003


class BoostedTrees:
    """Logistic boosting with histogram splits; ``threshold`` is set by ``calibrate`` on rows not used for the fit."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.threshold = 0.5

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        n, width = b.shape
        rate = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if n else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        self.feature = np.zeros((self.trees, 2**self.depth - 1), np.int64)
        self.cut = np.full((self.trees, 2**self.depth - 1), self.bins, np.int64)
        self.leaf = np.zeros((self.trees, 2**self.depth))
        size = self.bins + 1
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                count = 2**level
                first = count - 1
                gains = np.zeros((width, count))
                cuts = np.full((width, count), self.bins, np.int64)
                for j in range(width):
                    at = node * size + b[:, j]
                    sg = np.bincount(at, g, count * size).reshape(count, size)
                    sh = np.bincount(at, h, count * size).reshape(count, size)
                    lg, lh = np.cumsum(sg, 1), np.cumsum(sh, 1)
                    rg, rh = lg[:, -1:] - lg, lh[:, -1:] - lh
                    gain = lg**2 / (lh + self.penalty) + rg**2 / (rh + self.penalty) - lg[:, -1:] ** 2 / (lh[:, -1:] + self.penalty)
                    gain[(lh < self.least) | (rh < self.least)] = 0
                    cuts[j] = gain.argmax(1)
                    gains[j] = gain[np.arange(count), cuts[j]]
                best = gains.argmax(0)
                use = gains[best, np.arange(count)] > 1e-9
                self.feature[t, first : first + count] = best
                self.cut[t, first : first + count] = np.where(use, cuts[best, np.arange(count)], self.bins)
                f, c = self.feature[t, first + node], self.cut[t, first + node]
                node = node * 2 + (b[np.arange(n), f] > c)
            sg, sh = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.leaf[t] = self.rate * sg / (sh + self.penalty)
            score += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        if not len(x):
            return np.zeros(0)
        b, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (b[rows, self.feature[t, at]] > self.cut[t, at])
            score += self.leaf[t][node]
        return 1 / (1 + np.exp(-score))

    def calibrate(self, p: np.ndarray, y: np.ndarray, missed: int = 0) -> float:
        """Sets the threshold from held-out scores: of the cuts within ``SLACK`` of the best F1 the one nearest to even odds.

        ``missed`` positives had no candidate.
        """
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        total = y.sum() + missed
        if not total:
            return self.threshold
        f1 = 2 * hits / (np.arange(1, len(p) + 1) + total)
        cut = (p[order] + np.append(p[order][1:], 0.0)) / 2
        good = np.flatnonzero(f1 >= f1.max() - SLACK)
        self.threshold = float(np.clip(cut[good[np.abs(cut[good] - 0.5).argmin()]], 0.05, 0.95))
        return float(f1.max())
