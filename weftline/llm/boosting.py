"""Gradient-boosted trees for two classes, in numpy: depth-limited trees on binned features, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays (feature, threshold, leaf values), a base score, and calibration by isotonic steps."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    steps_at: np.ndarray
    steps_to: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**depth - 1)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: the share of positives among held-out examples of such a score."""
        at = np.searchsorted(self.steps_at, self.scores(x), "right") - 1
        return self.steps_to[np.maximum(at, 0)]


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: where each step begins and the share of positives on it."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(scores[order].tolist(), y[order].tolist()):
        if pools and pools[-1][0] == s:
            pools[-1][1] += v
            pools[-1][2] += 1
        else:
            pools.append([s, v, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, v2, n2 = pools.pop()
            pools[-1][1] += v2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.3, n_bins: int = 16, least: float = 4.0) -> Boosted:
    """Trees on the first seven tenths of the rows (shuffle before), calibration on the rest."""
    cut = len(x) * 7 // 10
    xs, ys, n_features = x[:cut], y[:cut].astype(float), x.shape[1]
    edges = [np.unique(np.quantile(xs[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, xs[:, f], "left") for f, e in enumerate(edges)], 1)
    p = min(max(ys.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score = np.full(cut, base)
    n_inner, n_leaves = 2**depth - 1, 2**depth
    features, thresholds, leaves = (np.zeros((n_trees, n_inner), np.int64), np.full((n_trees, n_inner), np.inf), np.zeros((n_trees, n_leaves)))
    for tree in range(n_trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = ys - prob, prob * (1 - prob)
        node = np.zeros(cut, np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                g, h = grad[rows], hess[rows]
                best = (1e-6, 0, np.inf)
                for f in range(n_features):
                    if not len(rows) or not len(edges[f]):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g, len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h, len(edges[f]) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(hl < least / 4) | (h.sum() - hl < least / 4)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), f, float(edges[f][at]))
                features[tree, k], thresholds[tree, k] = best[1], best[2]
                node[rows] = 2 * k + 1 + (xs[rows, best[1]] > best[2])
        place = node - n_inner
        g, h = np.bincount(place, grad, n_leaves), np.bincount(place, hess, n_leaves)
        leaves[tree] = rate * g / (h + 1)
        score += leaves[tree][place]
    model = Boosted(base, features, thresholds, leaves, np.zeros(1), np.zeros(1))
    model.steps_at, model.steps_to = isotonic(model.scores(x[cut:]), y[cut:].astype(float))
    return model
