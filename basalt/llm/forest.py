"""A small random forest, grown with numpy on the driver and compiled to a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    """A split (feature <= cut goes left) or, with feature -1, a leaf with the share of positives."""

    feature: int
    cut: float = 0.0
    share: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _best_split(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Gini gain and cut of one feature."""
    order = np.argsort(x, kind="stable")
    xs, ones = x[order], np.cumsum(y[order])
    at = np.flatnonzero(xs[1:] > xs[:-1]) + 1
    if not len(at):
        return 0.0, 0.0
    n, total = len(y), ones[-1]
    p, q = ones[at - 1] / at, (total - ones[at - 1]) / (n - at)
    after = (at * p * (1 - p) + (n - at) * q * (1 - q)) / n
    i = int(np.argmin(after))
    return total / n * (1 - total / n) - after[i], float((xs[at[i] - 1] + xs[at[i]]) / 2)


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, tried: int, rng: np.random.Generator) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Node(-1, share=share)
    options = [(*_best_split(x[:, f], y), int(f)) for f in rng.permutation(x.shape[1])[:tried]]
    gain, cut, f = max(options, key=lambda o: o[0])
    left = x[:, f] <= cut
    if gain <= 1e-9 or min(left.sum(), (~left).sum()) < least:
        return Node(-1, share=share)
    return Node(f, cut, share, _grow(x[left], y[left], depth - 1, least, tried, rng), _grow(x[~left], y[~left], depth - 1, least, tried, rng))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 7, least: int = 3, seed: int = 7) -> list[Node]:
    """Bootstrap trees; each split tries about the square root of the features, and two more."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], depth, least, int(x.shape[1] ** 0.5) + 2, rng))
    return out


def predict(forest: list[Node], x: np.ndarray) -> np.ndarray:
    def one(t: Node, row: np.ndarray) -> float:
        while t.feature >= 0:
            t = t.left if row[t.feature] <= t.cut else t.right
        return t.share

    return np.array([sum(one(t, row) for t in forest) / len(forest) for row in x])


def to_sql(forest: list[Node], names: list[str]) -> str:
    """The mean of the trees as nested CASE expressions over the named features; plain SQL."""

    def one(t: Node) -> str:
        if t.feature < 0:
            return f"CAST({t.share!r} AS DOUBLE)"
        return f"CASE WHEN {names[t.feature]} <= CAST({t.cut!r} AS DOUBLE) THEN {one(t.left)} ELSE {one(t.right)} END"

    return "(" + " + ".join(one(t) for t in forest) + f") / CAST({len(forest)} AS DOUBLE)"
