"""Gradient-boosted trees for small training sets, fitted on the driver and compiled to SQL."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of regression trees with exact greedy splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees = []
        f = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate, ridge)
            self.trees.append(tree)
            f += self._leaf(tree, x)

    def _grow(self, x, g, h, idx, depth, rate, ridge):
        value = rate * float(g[idx].sum() / (h[idx].sum() + ridge))
        if depth == 0 or len(idx) < 8:
            return value
        whole = g[idx].sum() ** 2 / (h[idx].sum() + ridge)
        best = (1e-6, None, None)
        for j in range(x.shape[1]):
            order = idx[np.argsort(x[idx, j], kind="stable")]
            v = x[order, j]
            gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            cut = np.flatnonzero(np.diff(v) > 0)
            if not len(cut):
                continue
            gain = gl[cut] ** 2 / (hl[cut] + ridge) + (g[idx].sum() - gl[cut]) ** 2 / (h[idx].sum() - hl[cut] + ridge) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        _, j, at = best
        if j is None:
            return value
        left, right = idx[x[idx, j] < at], idx[x[idx, j] >= at]
        return (j, at, self._grow(x, g, h, left, depth - 1, rate, ridge), self._grow(x, g, h, right, depth - 1, rate, ridge))

    def _leaf(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, at, left, right = tree
        return np.where(x[:, j] < at, self._leaf(left, x), self._leaf(right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._leaf(t, x) for t in self.trees)

    def sql(self, names: list[str]) -> str:
        """The margin as a SQL expression over the named features."""

        def case(tree):
            if not isinstance(tree, tuple):
                return f"{tree:.6f}D"
            j, at, left, right = tree
            return f"CASE WHEN {names[j]} < {at:.6f}D THEN {case(left)} ELSE {case(right)} END"

        return " + ".join([f"{self.bias:.6f}D", *map(case, self.trees)])
