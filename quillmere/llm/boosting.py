"""Gradient boosted trees for a binary label, on arrays, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth as arrays of features and thresholds by node, and leaf values."""

    depth: int
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30))) if len(x) else np.zeros(0)


def _tree(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, ridge: float):
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(gradient), np.int64)
    width = max(map(len, edges)) + 1
    for level in range(depth):
        first, n = 2**level - 1, 2**level
        best = np.full(n, 1e-6)
        split = np.zeros(n, np.int64)
        where = at - first
        total_g, total_h = (np.bincount(where, v, n) for v in (gradient, hessian))
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            cell = where * width + bins[:, f]
            g, h = (np.bincount(cell, v, n * width).reshape(n, width).cumsum(1)[:, : len(cuts)] for v in (gradient, hessian))
            other_g, other_h = total_g[:, None] - g, total_h[:, None] - h
            gain = g**2 / (h + ridge) + other_g**2 / (other_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
            gain[(h < least) | (other_h < least)] = -1
            cut = gain.argmax(1)
            value = gain[np.arange(n), cut]
            better = value > best
            best[better], split[better] = value[better], cut[better]
            feature[first : first + n][better] = f
            threshold[first : first + n][better] = cuts[cut[better]]
        right = np.zeros(len(at), bool)
        for node in range(n):
            if np.isfinite(threshold[first + node]):
                mine = where == node
                right[mine] = bins[mine, feature[first + node]] > split[node]
        at = 2 * at + 1 + right
    leaf = at - inner
    g, h = (np.bincount(leaf, v, 2**depth) for v in (gradient, hessian))
    return feature, threshold, g / (h + ridge), leaf


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 1.0, ridge: float = 1.0, seed: int = 7) -> Boosted:
    """Fit on three quarters of the rows; calibrate the margin and choose the threshold of best F1 on the rest.

    Without rows of both labels the model gives a probability of 0 throughout.
    """
    weight = np.ones(len(y)) if weight is None else weight
    model = Boosted(depth)
    if len(y) < 8 or y.min() == y.max():
        model.base, model.threshold = -20.0, 0.5
        return model
    held = np.random.default_rng(seed).random(len(y)) < 0.25
    if not (held & (y == 1)).any() or not (~held & (y == 1)).any() or not (~held & (y == 0)).any():
        held[:] = False
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] if len(e) else e for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    xs, ys, ws, bs = x[~held], y[~held], weight[~held], bins[~held]
    share = np.clip(np.average(ys, weights=ws), 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    margin = np.full(len(ys), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        feature, threshold, leaf, at = _tree(bs, edges, ws * (ys - p), ws * p * (1 - p), depth, least, ridge)
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(rate * leaf)
        margin += rate * leaf[at]
    check = held if held.any() else ~held
    _calibrate(model, x[check], y[check], weight[check])
    return model


def _calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """A logistic curve over the margin by Newton steps, with a prior that keeps it finite; then the threshold."""
    m = model.margin(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = w * p * (1 - p)
        ga, gb = (w * (y - p) * m).sum() - (a - 1), (w * (y - p)).sum() - b
        haa, hab, hbb = (v * m * m).sum() + 1, (v * m).sum(), v.sum() + 1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(0.05, a + np.clip(da, -1, 1)), b + np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-6:
            break
    model.slope, model.offset = float(a), float(b)
    p = model.probability(x)
    best, at = -1.0, 0.5
    for t in np.linspace(0.1, 0.9, 33):
        hit = w[(p >= t) & (y == 1)].sum()
        f1 = 2 * hit / (w[p >= t].sum() + w[y == 1].sum() + 1e-9)
        if f1 > best + 1e-12 or (f1 > best - 1e-12 and abs(t - 0.5) < abs(at - 0.5)):
            best, at = f1, float(t)
    model.threshold = at
