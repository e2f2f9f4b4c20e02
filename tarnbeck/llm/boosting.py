"""Gradient-boosted regression trees on the logistic loss, with histograms, and isotonic
calibration, in numpy. Sized for a bounded sample of dense rows on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .fitting import squash


@dataclass(frozen=True)
class Tree:
    """Nodes of a full binary tree in heap order; a node without a split sends all rows left."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (2 * node[:1] + 1 < len(self.value)).any():
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.bound[node])
        return self.value[node]


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if len(x):
            for tree in self.trees:
                out += tree.predict(x)
        return out


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, curve: np.ndarray, depth: int, ridge: float, least: float, rate: float) -> Tree:
    nodes = 2 ** (depth + 1) - 1
    feature, bound, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
    where = {0: np.arange(len(grad))}
    for node in range(nodes):
        rows = where.pop(node, np.empty(0, np.int64))
        g, h = grad[rows].sum(), curve[rows].sum()
        value[node] = -rate * g / (h + ridge)
        if 2 * node + 2 >= nodes:
            continue
        best = 1e-6
        for f, edge in enumerate(edges):
            gl = np.cumsum(np.bincount(bins[rows, f], grad[rows], len(edge) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins[rows, f], curve[rows], len(edge) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(hl < least) | (h - hl < least)] = 0
            if len(gain) and gain.max() > best:
                at = int(gain.argmax())
                best, feature[node], bound[node], cut = gain[at], f, edge[at], at
        if best > 1e-6:
            left = bins[rows, feature[node]] <= cut
            where[2 * node + 1], where[2 * node + 2] = rows[left], rows[~left]
        else:
            where[2 * node + 1] = rows
    return Tree(feature, bound, value)


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0, levels: int = 48) -> Boosted:
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Boosted(start, [])
    edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, levels)[1:-1]), [0.0]])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    raw = np.full(len(y), start)
    grown = []
    for _ in range(trees):
        p = squash(raw)
        tree = _grow(bins, edges, p - y, p * (1 - p), depth, ridge, least, rate)
        grown.append(tree)
        raw += tree.predict(x)
    return Boosted(start, grown)


@dataclass(frozen=True)
class Isotonic:
    at: np.ndarray
    level: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.level)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pool's level is smoothed by one row of the overall share."""
    if not len(y):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum, weight, lowest, highest
    for r, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([t, 1.0, r, r])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, w, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
            pools[-1][3] = hi
    share = float(y.mean())
    level = [(s + share) / (w + 1) for s, w, _, _ in pools]
    level = np.maximum.accumulate(level)
    return Isotonic(np.array([p[k] for p in pools for k in (2, 3)]), np.repeat(level, 2))
