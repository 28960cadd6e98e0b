"""Small gradient-boosted trees: fitted on a bounded sample, scored as a Column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: float = 0.0


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float) -> Node:
    """A tree of the Newton step; thresholds are mid-points between at most 32 quantiles."""
    leaf = Node(value=float(rate * grad.sum() / (hess.sum() + 1.0)))
    if depth == 0 or len(x) < 8:
        return leaf
    best, whole = (1e-6, -1, 0.0), grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33), method="nearest"))
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            g, h = grad[low].sum(), hess[low].sum()
            gain = g**2 / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - whole
            if gain > best[0]:
                best = (gain, f, float(at))
    _, f, at = best
    if f < 0:
        return leaf
    low = x[:, f] <= at
    return Node(
        f, at, _grow(x[low], grad[low], hess[low], depth - 1, rate), _grow(x[~low], grad[~low], hess[~low], depth - 1, rate)
    )


def _follow(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.value)
    low, out = x[:, node.feature] <= node.at, np.empty(len(x))
    out[low], out[~low] = _follow(node.low, x[low]), _follow(node.high, x[~low])
    return out


class Boosted:
    """Logistic boosting of shallow trees; deterministic."""

    def __init__(self, rounds: int = 25, depth: int = 3, rate: float = 0.3):
        self.rounds, self.depth, self.rate, self.trees, self.start = rounds, depth, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        total = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            tree = _grow(x, y - p, p * (1 - p), self.depth, self.rate)
            self.trees.append(tree)
            total += _follow(tree, x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(_follow(t, x) for t in self.trees))))

    def column(self, features: Column) -> Column:
        """The same score as an expression over an array of doubles."""

        def branch(node: Node) -> Column:
            if node.low is None:
                return F.lit(node.value)
            return F.when(F.get(features, F.lit(node.feature)) <= node.at, branch(node.low)).otherwise(branch(node.high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + branch(tree)
        return 1 / (1 + F.exp(-total))
