"""Small gradient-boosted trees for binary labels, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth; node ``k`` has children ``2k + 1`` and ``2k + 2``."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - (2**self.depth - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> BoostedTrees:
    """Newton boosting of the logistic loss; deterministic."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(n, np.log(p0 / (1 - p0)))
    base, inner = float(score[0]), 2**depth - 1
    features, thresholds, values = [], [], []
    # features of two values are added up as one product, the others by bins
    pairs = [j for j in range(m) if len(cuts[j]) == 1]
    right = (binned[:, pairs] > 0).astype(np.float64)
    wide = [j for j in range(m) if len(cuts[j]) > 1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        feature, threshold, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            best = np.full(count, 1e-6)
            node = np.zeros((n, count))
            node[np.arange(n), local] = 1
            gt, ht = (node.T @ g)[:, None], (node.T @ h)[:, None]

            def gains(gs: np.ndarray, hs: np.ndarray, gt=gt, ht=ht) -> np.ndarray:
                return gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)

            found = [(pairs, gains(gt - (node * g[:, None]).T @ right, ht - (node * h[:, None]).T @ right))] if pairs else []
            for j in wide:
                key = local * bins + binned[:, j]
                sums = (np.bincount(key, v, count * bins).reshape(count, bins).cumsum(1)[:, : len(cuts[j])] for v in (g, h))
                found.append(([j] * len(cuts[j]), gains(*sums)))
            for js, gain in found:
                where = gain.argmax(1)
                top = gain[np.arange(count), where]
                for k in np.flatnonzero(top > best).tolist():
                    j, cut = js[where[k]], 0 if js is pairs else where[k]
                    best[k] = top[k]
                    feature[first + k], cut_bin[first + k], threshold[first + k] = j, cut, cuts[j][cut]
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut_bin[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return BoostedTrees(base, depth, np.array(features), np.array(thresholds), np.array(values))
