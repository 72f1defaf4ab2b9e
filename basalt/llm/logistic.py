"""Small dense solvers for models on sparse rows, on the driver, over a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Rows:
    """Sparse rows: row i has columns[bounds[i]:bounds[i + 1]] with values. Sums run over blocks of entries, so that what they hold at once stays small."""

    BLOCK = 300_000

    def __init__(self, columns: np.ndarray, values: np.ndarray, bounds: np.ndarray, width: int):
        self.columns, self.values, self.bounds, self.width = columns.astype(np.int32), values.astype(np.float32), bounds, width

    @property
    def of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))

    def _blocks(self) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        """(first row, row after the last, their entries, each entry's row counted from the first)."""
        first, n = 0, len(self.bounds) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(self.bounds, self.bounds[first] + self.BLOCK, "right")) - 1)
            yield first, last, slice(self.bounds[first], self.bounds[last]), np.repeat(np.arange(last - first), np.diff(self.bounds[first : last + 1]))
            first = last

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.bounds) - 1)
        for first, last, at, of in self._blocks():
            out[first:last] = np.bincount(of, w[self.columns[at]] * self.values[at], last - first)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for first, last, at, of in self._blocks():
            out += np.bincount(self.columns[at], g[first:last][of] * self.values[at], self.width)
        return out

    def squares(self) -> np.ndarray:
        """Sum of squared values of each row."""
        out = np.zeros(len(self.bounds) - 1)
        for first, last, at, of in self._blocks():
            out[first:last] = np.bincount(of, self.values[at].astype(float) ** 2, last - first)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: Rows, y: np.ndarray, use: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps over the rows in use; both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (use & (y > 0)).sum()), 0.5 / max(1, (use & (y <= 0)).sum())) * use
    norm = x.squares()
    step = 1 / (0.25 * (norm.max(initial=0) + 1) + l2)
    w = look = np.zeros(x.width)
    b = look_b = 0.0
    for i in range(rounds):
        g = weight * (sigmoid(x.dot(look) + look_b) - y)
        new, new_b = look - step * (x.back(g) + l2 * look), look_b - step * g.sum()
        push = i / (i + 3)
        look, look_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b = new, new_b
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of sigmoid(a * z + b), the probability of y given the score z (Platt's targets, Newton steps)."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        v = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - t) * z).sum() + 1e-6 * a, (p - t).sum()])
        hess = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        d = np.linalg.solve(hess, grad)
        a, b = a - np.clip(d[0], -5, 5), b - np.clip(d[1], -5, 5)
    return float(a), float(b)
