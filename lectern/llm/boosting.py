"""Gradient-boosted regression trees on small numeric tables (logistic loss), in numpy.

Trees are trained here and evaluated for whole batches of rows: a tree of depth d is d
rounds of table look-ups.  Features are cut at quantiles of the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # of the inner nodes, in level order
    cut: np.ndarray
    value: np.ndarray  # of the leaves


class BoostedTrees:
    """A calibrated scorer: sum of trees, then a monotone map fitted on rows held out."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, cuts: int = 32, smooth: float = 1.0):
        self.depth, self.rounds, self.rate, self.cuts, self.smooth = depth, rounds, rate, cuts, smooth
        self.trees: list[Tree] = []
        self.start = 0.0
        self.steps_x, self.steps_y = np.zeros(1), np.zeros(1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        grid = [np.unique(np.quantile(c, np.linspace(0, 1, self.cuts + 2)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(g, c, side="left") for g, c in zip(grid, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(bins, grid, y - p, p * (1 - p))
            self.trees.append(tree)
            score += tree.value[leaf]
        return self

    def _grow(self, bins: np.ndarray, grid: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[Tree, np.ndarray]:
        node = np.zeros(len(g), np.int64)
        features, cuts = [], []
        for level in range(self.depth):
            chosen = np.zeros(1 << level, np.int64), np.full(1 << level, np.inf)
            split = np.full(1 << level, 1 << 30)
            for k in range(1 << level):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                for f in range(bins.shape[1]):
                    if len(rows) and len(grid[f]):
                        size = len(grid[f]) + 1
                        gs = np.cumsum(np.bincount(bins[rows, f], g[rows], size))
                        hs = np.cumsum(np.bincount(bins[rows, f], h[rows], size))
                        gain = gs**2 / (hs + self.smooth) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.smooth) - gs[-1] ** 2 / (hs[-1] + self.smooth)
                        b = int(np.argmax(gain[:-1]))
                        if gain[b] > best:
                            best, chosen[0][k], chosen[1][k], split[k] = gain[b], f, grid[f][b], b
            features.append(chosen[0])
            cuts.append(chosen[1])
            node = 2 * node + (bins[np.arange(len(node)), chosen[0][node]] > split[node])
        leaves = 1 << self.depth
        value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.smooth)
        return Tree(np.concatenate(features), np.concatenate(cuts), value), node

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, t.feature[at]] > t.cut[at])
            score += t.value[node]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Isotonic regression of held-out labels on raw scores (pool adjacent violators)."""
        raw = self.raw(x)
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for s, t in zip(raw[order], y[order].astype(float), strict=True):
            blocks.append([s, t, 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                s0, t0, n0 = blocks.pop()
                blocks[-1] = [blocks[-1][0], blocks[-1][1] + t0, blocks[-1][2] + n0]
        self.steps_x = np.array([b[0] for b in blocks])
        self.steps_y = np.array([(b[1]) / (b[2]) for b in blocks])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if len(x) == 0:
            return np.zeros(0)
        return self.steps_y[np.clip(np.searchsorted(self.steps_x, self.raw(x), side="right") - 1, 0, None)]


def lowest_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which held-out precision reaches ``precision``; 2.0 (nothing) if none does."""
    best = 2.0
    for t in np.unique(p)[::-1]:
        if y[p >= t].mean() >= precision:
            best = float(t)
    return best
