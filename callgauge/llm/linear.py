"""Logistic regression on sparse rows, for samples of a bounded size."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows of ones: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        sizes = np.array([len(r) for r in rows], np.int64)
        self.width, self.n = width, len(rows)
        self.columns = np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))
        self.row_of = np.repeat(np.arange(self.n), sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row_of, w[self.columns], self.n)

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, g[self.row_of], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(rows: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, known: np.ndarray | None = None, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights of columns, of dense columns and of the intercept, by accelerated gradient steps.

    use: which rows are trained on; known: which columns may have weights (all); penalty: on squared weights, in rows.
    """
    k = dense.shape[1]
    n = max(1, int(use.sum()))
    w = np.zeros(rows.width + k + 1)
    largest = np.bincount(rows.row_of, minlength=rows.n).max(initial=0) + (dense**2).sum(1).max(initial=0) + 1
    rate = 4 / max(1.0, largest**0.5)
    v, size = np.zeros_like(w), np.ones_like(w) * 1e-3
    for step in range(steps):
        z = rows.dot(w) + dense @ w[rows.width : rows.width + k] + w[-1]
        g = np.where(use, sigmoid(z) - y, 0.0)
        grad = np.concatenate((rows.transposed_dot(g), dense.T @ g, [g.sum()])) / n
        grad[:-1] += penalty / n * w[:-1]
        if known is not None:
            grad[: rows.width][~known] = 0
        size = np.maximum(0.99 * size, np.abs(grad))
        v = 0.9 * v + grad / size
        w = w - 0.1 * rate * v * (1 - step / steps)
    return w


def best_threshold(scores: np.ndarray, y: np.ndarray, false_cost: float) -> float:
    """The cut that costs least, a missed positive costing 1 and a false one ``false_cost``; midway between scores."""
    if not y.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], y[order].astype(bool)
    cost = (~hits).cumsum() * false_cost + hits.sum() - hits.cumsum()
    cost = np.where(np.append(s[1:] != s[:-1], True), cost, np.inf)
    at = int(np.argmin(cost))
    if cost[at] >= hits.sum():
        return float(np.nextafter(s[0], np.inf))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])
