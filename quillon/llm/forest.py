"""A small random forest: trained on the driver on a bounded table of labelled rows, and turned into one Column expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, float, "Tree", "Tree"]


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tried: int) -> Tree:
    p = float((y.sum() + 1) / (len(y) + 2))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return round(p, 4)
    best, split = None, None
    for f in sorted(rng.choice(x.shape[1], tried, replace=False).tolist()):
        order = np.argsort(x[:, f], kind="stable")
        values, ys = x[order, f], y[order]
        ups = np.cumsum(ys)
        n = np.arange(1, len(ys))
        a, b = ups[:-1], ups[-1] - ups[:-1]
        rest = len(ys) - n
        impurity = a * (n - a) / n + b * (rest - b) / rest
        can = (values[1:] > values[:-1]) & (n >= least) & (rest >= least)
        if can.any():
            i = int(np.argmin(np.where(can, impurity, np.inf)))
            if best is None or impurity[i] < best:
                best, split = impurity[i], (f, float((values[i] + values[i + 1]) / 2))
    if split is None:
        return round(p, 4)
    f, cut = split
    low = x[:, f] <= cut
    return (f, cut, _grow(x[low], y[low], rng, depth - 1, least, tried), _grow(x[~low], y[~low], rng, depth - 1, least, tried))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 5, least: int = 5, seed: int = 7) -> list[Tree]:
    rng = np.random.default_rng(seed)
    tried = max(2, int(np.ceil(x.shape[1] ** 0.5)) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), rng, depth, least, tried))
    return out


def score(tree: Tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def column(forest: list[Tree], feature: Callable[[int], Column]) -> Column:
    """The mean of the trees' probabilities."""

    def of(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, cut, low, high = tree
        return F.when(feature(f) <= F.lit(cut), of(low)).otherwise(of(high))

    total = of(forest[0])
    for t in forest[1:]:
        total = total + of(t)
    return total / F.lit(float(len(forest)))
