"""Gradient-boosted trees for small tabular problems: logistic loss, binned splits, numpy only."""

from __future__ import annotations

import numpy as np

BINS = 24


class BoostedTrees:
    """Fit on a bounded sample on the driver; the fitted trees are a few kilobytes of plain lists."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.25, least: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list[tuple]] = []
        self.base = 0.0
        self.flat: tuple | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        y = y.astype(float)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base, self.trees, self.flat = float(np.log(share / (1 - share))), [], None
        if not len(y) or y.min() == y.max():
            self.base = -5.0 if not len(y) or not y.any() else 5.0
            return self
        edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(col)) > BINS else np.unique(col)[:-1] for col in x.T]
        binned = [np.searchsorted(e, col, side="left").astype(np.int16) for e, col in zip(edges, x.T)]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            score += self._apply_tree(tree, x)
        return self

    def _grow(self, binned, edges, gradient, hessian, rows, depth) -> tuple:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        leaf = ("leaf", float(self.rate * g / (h + 1.0)))
        if depth == self.depth or len(rows) < 2 * self.least:
            return leaf
        best, choice = 1e-3, None
        own_gradient, own_hessian = gradient[rows], hessian[rows]
        for f in range(len(binned)):
            if not len(edges[f]):
                continue
            codes, size = binned[f][rows], len(edges[f]) + 1
            gs = np.bincount(codes, own_gradient, size).cumsum()[:-1]
            hs = np.bincount(codes, own_hessian, size).cumsum()[:-1]
            ns = np.bincount(codes, minlength=size).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            at = int(gain.argmax())
            if gain[at] > best:
                best, choice = float(gain[at]), (f, at)
        if choice is None:
            return leaf
        f, at = choice
        left = binned[f][rows] <= at
        grow = lambda part: self._grow(binned, edges, gradient, hessian, part, depth + 1)
        return ("split", f, float(edges[f][at]), grow(rows[left]), grow(rows[~left]))

    def _apply_tree(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if tree[0] == "leaf":
            return np.full(len(x), tree[1])
        left = x[:, tree[1]] <= tree[2]
        out = np.empty(len(x))
        out[left], out[~left] = self._apply_tree(tree[3], x[left]), self._apply_tree(tree[4], x[~left])
        return out

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, threshold, value) of the nodes of all trees as complete ones: node n has the children 2n + 1 and 2n + 2."""
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.zeros((len(self.trees), size), np.int32), np.full((len(self.trees), size), np.inf), np.zeros((len(self.trees), size))
        for t, tree in enumerate(self.trees):
            open_ = [(tree, 0)]
            while open_:
                node, at = open_.pop()
                if node[0] == "split":
                    feature[t, at], threshold[t, at] = node[1], node[2]
                    open_ += [(node[3], 2 * at + 1), (node[4], 2 * at + 2)]
                elif 2 * at + 1 < size:
                    open_.append((node, 2 * at + 1))
                else:
                    value[t, at] = node[1]
        return feature, threshold, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all trees walk down together, a bounded number of rows at a time."""
        score = np.full(len(x), self.base)
        if self.trees:
            if self.flat is None:
                self.flat = self._flat()
            feature, threshold, value = self.flat
            trees = np.arange(len(self.trees))
            for first in range(0, len(x), 4096):
                part = x[first : first + 4096]
                rows, at = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), np.int32)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (part[rows, feature[trees, at]] > threshold[trees, at])
                score[first : first + 4096] += value[trees, at].sum(axis=1)
        return 1 / (1 + np.exp(-score))
