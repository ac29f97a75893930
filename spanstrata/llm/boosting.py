"""Small gradient-boosted trees: fitted on a bounded sample, applied as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 32


class Trees:
    """Sum of trees in log odds.  A tree is ``(feature, limit, left, right)``; a leaf is a number."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees = start, trees

    def predict(self, rows) -> np.ndarray:
        x = np.asarray(rows, dtype=float)
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += _apply(tree, x)
        return 1 / (1 + np.exp(-total))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, limit, left, right = tree
    return np.where(x[:, k] < limit, _apply(left, x), _apply(right, x))


def _grow(binned, edges, gradient, hessian, rows, depth, smooth, least):
    """Best splits by the gain of the second-order loss, on histograms of the binned features."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for k, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = binned[rows, k]
            n = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, gradient[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hessian[rows], len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + smooth) + (g - gl) ** 2 / (h - hl + smooth) - g**2 / (h + smooth)
            gain[(n < least) | (len(rows) - n < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), k, at)
    if best[1] is None:
        return float(-g / (h + smooth))
    _, k, at = best
    left = binned[rows, k] <= at
    args = (depth - 1, smooth, least)
    return (k, float(edges[k][at]), _grow(binned, edges, gradient, hessian, rows[left], *args), _grow(binned, edges, gradient, hessian, rows[~left], *args))


def fit_trees(rows, labels, rounds: int = 20, depth: int = 3, rate: float = 0.3, smooth: float = 1.0, least: int = 5) -> Trees:
    """Trees for 0/1 labels on a sample that the caller has bounded; with one class or no rows, a constant."""
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Trees(-20.0 if not len(y) or y.max() == 0 else 20.0, [])
    x = np.asarray(rows, dtype=float)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    edges = [e[e > x[:, k].min()] for k, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)
    total = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    start, trees, everything = float(total[0]), [], np.arange(len(y))

    def scaled(tree):
        return tree * rate if isinstance(tree, float) else (tree[0], tree[1], scaled(tree[2]), scaled(tree[3]))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = scaled(_grow(binned, edges, p - y, p * (1 - p), everything, depth, smooth, least))
        total += _apply(tree, x)
        trees.append(tree)
    return Trees(start, trees)


def _expression(tree, values: dict[str, Column], names: list[str]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    k, limit, left, right = tree
    return F.when(values[names[k]] < limit, _expression(left, values, names)).otherwise(_expression(right, values, names))


def score(model: Trees, values: dict[str, Column], names: list[str]) -> Column:
    """The model's probability as a column expression."""
    total = F.lit(model.start)
    for tree in model.trees:
        total = total + _expression(tree, values, names)
    return 1 / (1 + F.exp(-total))


def calibrate(scores, labels, precision: float, counts=None) -> float:
    """Smallest score at which the calibrated probability, less one standard error, is ``precision``; 2 if none.

    The probability of a score is the share of positives around it, not above it: an isotonic
    regression pools neighbouring scores until the shares rise with the score, so sure examples
    do not pay for doubtful ones.  ``counts``: examples of each score, of which ``labels`` are positive.
    """
    s, at = np.unique(np.asarray(scores, dtype=float), return_inverse=True)
    pools: list[list[float]] = []  # positives, examples, least score
    for score_, y, n in zip(s, np.bincount(at, np.asarray(labels, dtype=float), len(s)), np.bincount(at, counts, len(s)), strict=True):
        pools.append([y, n, score_])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, n, _ = pools.pop()
            pools[-1][0] += y
            pools[-1][1] += n
    least = 2.0
    for y, n, score_ in reversed(pools):
        share = (y + 1) / (n + 2)
        if share - math.sqrt(share * (1 - share) / (n + 2)) < precision:
            break
        least = float(score_)
    return least
