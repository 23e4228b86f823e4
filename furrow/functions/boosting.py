"""Boosted regression trees on one group's rows, in numpy, by binned sums.

Squared loss with second-order gains: each round fits a tree to the residuals of a
row sample on a column sample, level by level, from sums of residuals and counts per
(node, feature, bin).  A leaf moves the prediction by ``step`` times its shrunken mean residual.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature; the split points are quantiles of the training rows.
BINS = 128
#: Shrinkage of leaf means and of split gains.
SHRINK = 1.0


@dataclass
class Tree:
    """Nodes from the root on: feature, threshold (left if not greater), children (-1 at leaves), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return self.value[at]
            at = np.where(inner, np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at]), at)


def split_points(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds of every feature: midpoints between neighbouring values, at most ``BINS`` - 1 of them."""
    points = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        points.append(middle if len(middle) < BINS else np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])))
    return points


def grow(binned: np.ndarray, residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, points: list[np.ndarray], depth: int, step: float) -> Tree:
    """One tree on the given rows and columns."""
    count = len(columns)
    codes = binned[rows][:, columns] + BINS * np.arange(count)
    r = residual[rows]
    at = np.zeros(len(rows), np.int64)
    feature, threshold, left, right, value = [0], [0.0], [-1], [-1], [0.0]
    open_nodes = np.array([0])
    for level in range(depth + 1):
        here = np.full(len(feature), -1)
        here[open_nodes] = np.arange(len(open_nodes))
        place = here[at]
        active = place >= 0
        number = np.bincount(place[active], minlength=len(open_nodes)).astype(float)
        total = np.bincount(place[active], r[active], minlength=len(open_nodes))
        for k, node in enumerate(open_nodes):
            value[node] = step * total[k] / (number[k] + SHRINK)
        if level == depth or not active.any():
            break
        cell = (place[active][:, None] * (BINS * count) + codes[active]).ravel()
        shape = (len(open_nodes), count, BINS)
        n = np.cumsum(np.bincount(cell, minlength=np.prod(shape)).reshape(shape), axis=2)
        s = np.cumsum(np.bincount(cell, np.repeat(r[active], count), minlength=np.prod(shape)).reshape(shape), axis=2)
        rest_n, rest_s = number[:, None, None] - n, total[:, None, None] - s
        gain = s * s / (n + SHRINK) + rest_s * rest_s / (rest_n + SHRINK) - (total * total / (number + SHRINK))[:, None, None]
        gain[(n < 1) | (rest_n < 1)] = -np.inf
        best = gain.reshape(len(open_nodes), -1).argmax(axis=1)
        worth = gain.reshape(len(open_nodes), -1)[np.arange(len(open_nodes)), best] > 1e-9
        following = []
        for k in np.flatnonzero(worth):
            node, (f, b) = open_nodes[k], divmod(int(best[k]), BINS)
            feature[node], threshold[node] = int(columns[f]), float(points[columns[f]][b])
            left[node], right[node] = len(feature), len(feature) + 1
            following += [left[node], right[node]]
            for column, start in ((feature, 0), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
                column += [start, start]
        if not following:
            break
        lefts, rights, chosen = np.array(left), np.array(right), np.full(len(feature), -1)
        chosen[open_nodes[worth]] = best[worth]
        split = np.flatnonzero(chosen[at] >= 0)
        f, b = np.divmod(chosen[at[split]], BINS)
        goes_left = codes[split, f] - BINS * f <= b
        at[split] = np.where(goes_left, lefts[at[split]], rights[at[split]])
        open_nodes = np.array(following)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, step: float, subsample: float = 1.0, columns: float = 1.0, seed: int = 42) -> tuple[float, list[Tree]]:
    """Start value and trees fitted to (x, y)."""
    random = np.random.default_rng(seed)
    points = split_points(x)
    binned = np.column_stack([np.searchsorted(p, c, side="left") for p, c in zip(points, x.T, strict=True)])
    start = float(np.mean(y)) if len(y) else 0.0
    prediction, trees = np.full(len(y), start), []
    take, width = max(1, round(subsample * len(y))), max(1, round(columns * x.shape[1]))
    for _ in range(rounds if len(y) else 0):
        rows = np.arange(len(y)) if take == len(y) else np.sort(random.choice(len(y), take, replace=False))
        some = np.arange(x.shape[1]) if width == x.shape[1] else np.sort(random.choice(x.shape[1], width, replace=False))
        trees.append(grow(binned, y - prediction, rows, some, points, depth, step))
        prediction = prediction + trees[-1].predict(x)
    return start, trees


def predict(start: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return start + sum((t.predict(x) for t in trees), np.zeros(len(x)))
