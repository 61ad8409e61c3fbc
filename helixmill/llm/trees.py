"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, flat: a leaf points to itself. ``roots`` are the first nodes of the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for each row of ``x``; all trees step down together."""
        if not len(self.roots):
            return np.full(len(x), self.bias)
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Logistic of the margin."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5) -> Forest:
    """Boosted trees for labels 0 and 1. ``monotone``: 1, -1 or 0 for each feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate_1 / (1 - rate_1)))
    margin = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column, start in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            column.append(start)
        return len(feature) - 1

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        todo = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            own = float(np.clip(-total_g / (total_h + ridge), low, high))
            best = None
            if level < depth and len(rows) >= 2 * least:
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    b = binned[rows, f]
                    gs = np.cumsum(np.bincount(b, g[rows], len(edges[f]) + 1))[:-1]
                    hs = np.cumsum(np.bincount(b, h[rows], len(edges[f]) + 1))[:-1]
                    ns = np.cumsum(np.bincount(b, minlength=len(edges[f]) + 1))[:-1]
                    vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
                    gain = -(gs * vl + 0.5 * (hs + ridge) * vl**2) - ((total_g - gs) * vr + 0.5 * (total_h - hs + ridge) * vr**2) + total_g * own + 0.5 * (total_h + ridge) * own**2
                    gain[(ns < least) | (len(rows) - ns < least) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, float(vl[k]), float(vr[k]))
            if best is None:
                value[at] = rate * own
                margin[rows] += rate * own
                continue
            _, f, k, vl, vr = best
            feature[at], threshold[at] = f, float(edges[f][k])
            left[at], right[at] = node(), node()
            goes = binned[rows, f] <= k
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
            todo += [(left[at], rows[goes], level + 1, *bounds[0]), (right[at], rows[~goes], level + 1, *bounds[1])]
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, bias)
