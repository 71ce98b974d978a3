"""Gradient-boosted trees for binary labels, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth: a feature and a threshold for each inner node, a value for each leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 1.0) -> BoostedTrees:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        score = np.full(len(y), np.log(mean / (1 - mean)))
        start, all_features, all_thresholds, all_leaves = float(score[0]), [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            features, thresholds = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                width, first = 1 << level, (1 << level) - 1
                best, at = np.full(width, 1e-9), [(0, np.inf)] * width
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    cell = node * (bins + 1) + binned[:, f]
                    g, h = (np.bincount(cell, v, width * (bins + 1)).reshape(width, -1).cumsum(axis=1) for v in (gradient, weight))
                    left, right = g[:, :-1] ** 2 / (h[:, :-1] + least), (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + least)
                    gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + least)
                    gain = gain[:, : len(edges[f])]
                    top = gain.argmax(axis=1)
                    for n in np.flatnonzero(gain[np.arange(width), top] > best):
                        best[n], at[n] = gain[n, top[n]], (f, edges[f][top[n]])
                for n, (f, t) in enumerate(at):
                    features[first + n], thresholds[first + n] = f, t
                node = 2 * node + (x[np.arange(len(y)), features[first + node]] > thresholds[first + node])
            g, h = (np.bincount(node, v, 1 << depth) for v in (gradient, weight))
            leaves = rate * g / (h + least)
            score = score + leaves[node]
            all_features.append(features)
            all_thresholds.append(thresholds)
            all_leaves.append(leaves)
        return cls(np.array(all_features), np.array(all_thresholds), np.array(all_leaves), start)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(self.leaves.shape[1]).bit_length() - 1
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                place = (1 << level) - 1 + node
                node = 2 * node + (x[rows, features[place]] > thresholds[place])
            total += leaves[node]
        return total
