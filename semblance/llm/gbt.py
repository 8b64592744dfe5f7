"""Gradient-boosted trees for two classes on binned features, and isotonic
calibration, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Trees:
    """Logistic loss, Newton leaves, complete trees of ``depth`` levels.

    A tree is an array of (feature, threshold) for the inner nodes in level
    order and one of leaf values; ``x > threshold`` goes right. A node that
    can't gain splits at infinity, so everything in it goes left.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 4.0):
        self.n, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        x = np.asarray(x, np.float64)
        cuts = [np.unique(np.quantile(c[c != c[0]] if (c != c[0]).any() else c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        cuts = [np.unique(np.append(c, x[:, k].min())) for k, c in enumerate(cuts)]
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
        width = max(map(len, cuts)) + 1
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.base)
        self.feature, self.threshold, self.leaf = [], [], []
        for _ in range(self.n):
            p = _sigmoid(z)
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            feature, threshold = [], []
            for level in range(self.depth):
                k = 1 << level
                best = np.zeros(k)
                at = [(0, np.inf, width)] * k
                for f, c in enumerate(cuts):
                    key = node * width + code[f]
                    gs = np.bincount(key, g, k * width).reshape(k, width).cumsum(1)
                    hs = np.bincount(key, h, k * width).reshape(k, width).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl * 4 < self.least) | ((ht - hl) * 4 < self.least)] = 0
                    gain[:, len(c) :] = 0
                    j = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(k), j] > best + 1e-9):
                        best[i], at[i] = gain[i, j[i]], (f, c[j[i]], j[i])
                feature += [a[0] for a in at]
                threshold += [a[1] for a in at]
                f, b = np.array([a[0] for a in at]), np.array([a[2] for a in at])
                node = node * 2 + (code[f[node], np.arange(len(y))] > b[node])
            leaf = np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2) * self.rate
            z += leaf[node]
            self.feature.append(feature), self.threshold.append(threshold), self.leaf.append(leaf)
        self.feature, self.threshold, self.leaf = np.array(self.feature), np.array(self.threshold), np.array(self.leaf)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                inner = node + (1 << level) - 1
                node = node * 2 + (x[rows, feature[inner]] > threshold[inner])
            z += leaf[node]
        return z


class Isotonic:
    """Pool-adjacent-violators on (score, outcome); linear between blocks."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # mean outcome, weight, first and last score
        for a, b in zip(s[order], y[order], strict=True):
            blocks.append([float(b), 1.0, float(a), float(a)])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                m, w, _, end = blocks.pop()
                o = blocks[-1]
                o[0], o[1], o[3] = (o[0] * o[1] + m * w) / (o[1] + w), o[1] + w, end
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.array([v for b in blocks for v in (b[0], b[0])])
        return self

    def predict(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.y)
