"""Small numpy learners: gradient-boosted trees with logistic loss, isotonic and logistic calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class BoostedTrees:
    """Complete trees of a fixed depth over quantile bins; a node that can't gain keeps one side empty."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.15, bins: int = 64, ridge: float = 2.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if n else 0.0
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1) if n else np.zeros((0, k), int)
        self.feature, self.cut, self.leaf = [], [], []
        raw = np.full(n, self.base)
        for _ in range(self.rounds if n else 0):
            p = sigmoid(raw)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, int)
            feature, cut = [], []
            for level in range(self.depth):
                width = 1 << level
                best = np.zeros(width)
                f_at, c_at, b_at = np.zeros(width, int), np.full(width, np.inf), np.full(width, self.bins + 1)
                for j in range(k):
                    m = len(cuts[j]) + 1
                    cell = node * m + binned[:, j]
                    gs = np.bincount(cell, g, width * m).reshape(width, m)
                    hs = np.bincount(cell, h, width * m).reshape(width, m)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    for v in range(width) if m > 1 else ():
                        b = int(gain[v].argmax())
                        if gain[v, b] > best[v] + 1e-12:
                            best[v], f_at[v], c_at[v], b_at[v] = gain[v, b], j, cuts[j][b], b
                feature.append(f_at)
                cut.append(c_at)
                node = node * 2 + (binned[np.arange(n), f_at[node]] > b_at[node])
            leaf = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            raw += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for f, c in zip(feature, cut, strict=True):
                node = node * 2 + (x[row, f[node]] > c[node])
            out += leaf[node]
        return out


class Isotonic:
    """Pool-adjacent-violators fit, linear between the pools' means, shrunk from 0 and 1 by one pseudo-count a pool."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # weight, sum of y, sum of x
        for a, b in zip(x[order], y[order], strict=True):
            pools.append([1.0, float(b), float(a)])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[2] / p[0] for p in pools] or [0.0])
        self.y = np.maximum.accumulate(np.array([(p[1] + 0.5) / (p[0] + 1) for p in pools] or [0.5]))
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(x) else 0):
        p = sigmoid(x @ w)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w
