"""Gradient-boosted trees and isotonic calibration in numpy, for tables of a few thousand rows."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary logistic boosting of depth-limited trees over quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if k else np.zeros((n, 0), int)
        share = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
        self.start, self.grown = float(np.log(share / (1 - share))), []
        margin = np.full(n, self.start)
        nodes, width = (2 << self.depth) - 1, self.bins + 1
        for _ in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, split, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
            node = np.zeros(n, int)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                best, choice = np.full(count, 1e-6), [None] * count
                at = node - first
                active = (at >= 0) & (at < count)
                for j in range(k):
                    key = at[active] * width + binned[active, j]
                    gs, hs, ns = (np.bincount(key, w, count * width).reshape(count, width).cumsum(axis=1) for w in (g[active], h[active], None))
                    left, lh, ln = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                    all_g, all_h, all_n = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = left**2 / (lh + self.penalty) + (all_g - left) ** 2 / (all_h - lh + self.penalty) - all_g**2 / (all_h + self.penalty)
                    gain[(ln < self.least) | (all_n - ln < self.least)] = 0
                    top = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(count), top] > best):
                        best[i], choice[i] = gain[i, top[i]], (j, top[i])
                for i, found in enumerate(choice):
                    if found:
                        feature[first + i], split[first + i] = found
                go = active & (feature[np.minimum(node, nodes - 1)] >= 0)
                own = node[go]
                node[go] = 2 * own + 1 + (binned[go, feature[own]] > split[own])
            gs, hs = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
            value = self.rate * gs / (hs + self.penalty)
            margin += value[node]
            self.grown.append((feature, split, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration."""
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, split, value in self.grown:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (binned[rows, f] > split[node]), node)
            out += value[node]
        return out


class Isotonic:
    """Pool-adjacent-violators fit, linear between the pooled blocks' means."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([b, 1.0, a])
            while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
                s, n, at = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, (blocks[-1][2] * blocks[-1][1] + at * n) / (blocks[-1][1] + n)]
        self.x = np.array([b[2] for b in blocks] or [0.0])
        self.y = np.array([b[0] / b[1] for b in blocks] or [0.0])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1)
