"""A small random forest on numeric features, that is applied as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    share: float  # of positives
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The split of least weighted Gini impurity: (impurity, feature, limit)."""
    best = None
    n, total = len(y), y.sum()
    for f in features.tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        cuts = cuts[(cuts >= least) & (cuts <= n - least)]
        if not len(cuts):
            continue
        left = ones[cuts - 1]
        p, q = left / cuts, (total - left) / (n - cuts)
        impurity = cuts * p * (1 - p) + (n - cuts) * q * (1 - q)
        at = int(np.argmin(impurity))
        found = (float(impurity[at]), f, float((v[cuts[at] - 1] + v[cuts[at]]) / 2))
        if best is None or found < best:
            best = found
    return best


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> Node:
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    some = rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False)
    best = _split(x, y, np.sort(some), least) or _split(x, y, np.arange(x.shape[1]), least)
    if best is None:
        return node
    _, node.feature, node.limit = best
    low = x[:, node.feature] <= node.limit
    node.low, node.high = _grow(x[low], y[low], depth - 1, least, rng), _grow(x[~low], y[~low], depth - 1, least, rng)
    return node


def train(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 7, least: int = 3, seed: int = 10) -> list[Node]:
    """Trees on bootstrap samples, each split chosen among a random root of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), depth, least, rng))
    return out


def probability(forest: list[Node], row: np.ndarray) -> float:
    total = 0.0
    for node in forest:
        while node.low is not None:
            node = node.low if row[node.feature] <= node.limit else node.high
        total += round(node.share, 6)
    return total / len(forest)


def to_sql(forest: list[Node], names: list[str]) -> str:
    """The forest's mean share of positives as nested CASE expressions over the named features."""

    def sql(node: Node) -> str:
        if node.low is None:
            return f"{round(node.share, 6):.6f}D"
        return f"CASE WHEN {names[node.feature]} <= {node.limit!r}D THEN {sql(node.low)} ELSE {sql(node.high)} END"

    return "(" + " + ".join(f"({sql(t)})" for t in forest) + f") / {len(forest)}D"
