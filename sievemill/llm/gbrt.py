"""Gradient-boosted regression trees for small labelled tables: least squares, exact splits, numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; `feature` -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for values, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            values.append(x)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), int)
        rows = np.arange(len(x))
        while (inner := feature[node] >= 0).any():
            at, i = node[inner], rows[inner]
            node[inner] = np.where(x[i, feature[at]] <= cut[at], left[at], right[at])
        return np.array(self.value)[node]


def _best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, int, float]:
    """Gain, feature and cut of the split that lowers the squared error most; gain 0 if there is none."""
    n, best = len(y), (0.0, -1, 0.0)
    order = np.argsort(x, axis=0, kind="stable")
    sorted_x = np.take_along_axis(x, order, axis=0)
    sums = np.cumsum(y[order], axis=0)
    size = np.arange(1, n)[:, None]
    gain = sums[:-1] ** 2 / size + (sums[-1] - sums[:-1]) ** 2 / (n - size) - sums[-1] ** 2 / n
    gain[(sorted_x[1:] <= sorted_x[:-1]) | (size < least) | (n - size < least)] = 0
    if gain.size:
        i, f = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[i, f] > 1e-9:
            best = (float(gain[i, f]), int(f), float((sorted_x[i, f] + sorted_x[i + 1, f]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> Tree:
    tree = Tree()
    todo = [(tree.add(float(y.mean())), np.arange(len(y)), depth)]
    while todo:
        node, rows, room = todo.pop()
        gain, f, cut = _best_split(x[rows], y[rows], least) if room and len(rows) >= 2 * least else (0.0, -1, 0.0)
        if f < 0:
            continue
        low = x[rows, f] <= cut
        tree.feature[node], tree.cut[node] = f, cut
        for side, part in (("left", rows[low]), ("right", rows[~low])):
            child = tree.add(float(y[part].mean()))
            getattr(tree, side)[node] = child
            todo.append((child, part, room - 1))
    return tree


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.shift + self.slope * self.raw(x)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, depth: int = 3, least: int = 5, columns: float = 0.5, seed: int = 3) -> Boosted:
    """Each round sees a random share of the columns, so that no single feature carries the model."""
    rng = np.random.default_rng(seed)
    model = Boosted(float(y.mean()), rate, [])
    at = np.full(len(y), model.base)
    some = max(1, int(round(columns * x.shape[1])))
    for _ in range(rounds):
        keep = np.sort(rng.choice(x.shape[1], some, replace=False))
        tree = grow(x[:, keep], y - at, depth, least)
        tree.feature = [int(keep[f]) if f >= 0 else -1 for f in tree.feature]
        at = at + rate * tree.predict(x)
        model.trees.append(tree)
    return model


def cross_validated(x: np.ndarray, y: np.ndarray, groups: np.ndarray, **options) -> tuple[Boosted, np.ndarray]:
    """The model on all rows, calibrated by a line through its out-of-fold predictions, and those predictions."""
    held = np.full(len(y), float(y.mean()))
    for g in np.unique(groups):
        out = groups == g
        if out.all():
            continue
        held[out] = fit(x[~out], y[~out], **options).raw(x[out])
    model = fit(x, y, **options)
    if held.std() > 1e-9:
        model.slope, model.shift = (float(v) for v in np.polyfit(held, y, 1))
    return model, model.shift + model.slope * held
