"""A small decision tree (Gini, axis-parallel cuts) for tables of a few
hundred rows, trained on the driver and handed to tasks as plain arrays."""

from __future__ import annotations

import numpy as np


class DecisionTree:
    def __init__(self, max_depth: int = 6, min_leaf: int = 1):
        self.max_depth, self.min_leaf = max_depth, min_leaf
        self.feature, self.cut, self.low, self.high, self.value = [], [], [], [], []

    def _node(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.value)
        for column, start in zip((self.feature, self.cut, self.low, self.high), (-1, 0.0, -1, -1)):
            column.append(start)
        self.value.append(float(y.mean()))
        if depth == self.max_depth or y.min() == y.max():
            return at
        best = (1e-12, -1, 0.0)
        whole = y.mean() * (1 - y.mean()) * len(y)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            for i in np.flatnonzero(v[1:] > v[:-1]):
                left, right = n[i], len(y) - n[i]
                if min(left, right) < self.min_leaf:
                    continue
                a, b = t[i] / left, (t[-1] - t[i]) / right
                gain = whole - a * (1 - a) * left - b * (1 - b) * right
                if gain > best[0]:
                    best = (gain, f, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return at
        down = x[:, best[1]] <= best[2]
        self.feature[at], self.cut[at] = best[1], best[2]
        self.low[at] = self._node(x[down], y[down], depth + 1)
        self.high[at] = self._node(x[~down], y[~down], depth + 1)
        return at

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self._node(np.asarray(x, float), np.asarray(y, float), 0)
        for name in ("feature", "cut", "low", "high", "value"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of positive training rows in each row's leaf."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.value[node]
            here = node[inner]
            down = x[inner, self.feature[here]] <= self.cut[here]
            node[inner] = np.where(down, self.low[here], self.high[here])
