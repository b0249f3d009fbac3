"""Gradient boosted trees of fixed depth in numpy: small, deterministic, picklable."""

from __future__ import annotations

import numpy as np


class Boost:
    """Logistic boosting of complete trees, with a Platt calibration on held-out rows."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 16, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None) -> Boost:
        """held marks the rows for calibration and threshold, by default every fifth; then the trees are grown again on all rows."""
        held = np.arange(len(x)) % 5 == 0 if held is None else held
        self._grow(x, y, held)
        self.a, self.b = self._platt(self.raw(x[held]), y[held])
        self.threshold = self._best(self.prob(x[held]), y[held])
        self._grow(x, y, np.zeros(len(x), dtype=bool))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
        n, k = x.shape
        self.cuts = [self._cuts(x[~held, f]) for f in range(k)]
        b = np.stack([np.searchsorted(self.cuts[f], x[:, f], side="left") for f in range(k)], axis=1)
        width, size = self.bins + 1, 2**self.depth - 1
        self.base = float(np.log((y[~held].mean() + 1e-3) / (1 - y[~held].mean() + 1e-3)))
        self.feature = np.zeros((self.trees, size), dtype=np.int32)
        self.cut = np.full((self.trees, size), np.inf)
        self.leaf = np.zeros((self.trees, 2**self.depth))
        bt, yt = b[~held], y[~held]
        score = np.full(len(yt), self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = yt - p, p * (1 - p)
            node = np.zeros(len(yt), dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                choice: list[tuple[int, int] | None] = [None] * count
                at = node - first
                for f in range(k):
                    if not len(self.cuts[f]):
                        continue
                    key = at * width + bt[:, f]
                    sg = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)
                    sh = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)
                    lg, lh, tg, th = sg[:, :-1], sh[:, :-1], sg[:, -1:], sh[:, -1:]
                    gain = lg**2 / (lh + self.least) + (tg - lg) ** 2 / (th - lh + self.least) - tg**2 / (th + self.least)
                    for i in np.flatnonzero(gain.max(axis=1) > best):
                        j = int(gain[i].argmax())
                        if j < len(self.cuts[f]):
                            best[i], choice[i] = gain[i, j], (f, j)
                right = np.zeros(len(yt), dtype=np.int64)
                for i, c in enumerate(choice):
                    if c:
                        self.feature[t, first + i], self.cut[t, first + i] = c[0], self.cuts[c[0]][c[1]]
                        here = at == i
                        right[here] = bt[here, c[0]] > c[1]
                node = 2 * node + 1 + right
            leaf = node - size
            sg, sh = np.bincount(leaf, g, size + 1), np.bincount(leaf, h, size + 1)
            self.leaf[t] = self.rate * sg / (sh + self.least)
            score += self.leaf[t][leaf]

    def _cuts(self, v: np.ndarray) -> np.ndarray:
        u = np.unique(v)
        mid = (u[1:] + u[:-1]) / 2
        return mid if len(mid) < self.bins else np.unique(np.quantile(mid, np.linspace(0, 1, self.bins)))

    @staticmethod
    def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
            w = p * (1 - p) + 1e-9
            ga, gb = ((y - p) * s).sum() - 0.01 * (a - 1), (y - p).sum() - 0.01 * b
            haa, hab, hbb = (w * s * s).sum() + 0.01, (w * s).sum(), w.sum() + 0.01
            det = haa * hbb - hab * hab
            a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
        return float(np.clip(a, 0.2, 5)), float(np.clip(b, -5, 5))

    @staticmethod
    def _best(p: np.ndarray, y: np.ndarray) -> float:
        """The threshold of highest F1 on the held-out rows, the middle one of equals."""
        grid = np.linspace(0.05, 0.95, 19)
        f1 = np.array([2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + (y == 1).sum()) for t in grid])
        return float(np.median(grid[f1 >= f1.max() - 1e-12]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            score += leaf[node - len(f)]
        return score

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -50, 50)))
