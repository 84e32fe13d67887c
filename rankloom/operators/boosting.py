"""Gradient-boosted trees for clicks: histograms of binned features, leaves grown by largest gain.

Fitting takes the table of labelled rows in memory, binned to a byte a value; prediction is plain array arithmetic on any batch of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

#: Trees, learning rate, leaves of a tree, bins of a feature, rows of a leaf at least, seed.
ITERATIONS, RATE, LEAVES, BINS, LEAST_ROWS, SEED = 300, 0.08, 31, 255, 20, 0
_LEAST_CURVATURE = 1e-3
#: Threads that fill a leaf's histogram, a feature each, and rows of a leaf from which on they are used.
THREADS, THREADED_ROWS = 4, 20_000


@dataclass
class Tree:
    """Nodes in arrays: rows go left where their feature is at most the cut; a node without feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int32)
        rows = np.arange(len(x)) if self.feature[0] >= 0 else np.empty(0, int)
        while len(rows):
            at = node[rows]
            node[rows] = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            rows = rows[self.feature[node[rows]] >= 0]
        return self.value[node]


@dataclass
class Model:
    """Log-odds as a start value plus the values of all trees."""

    features: Sequence[str]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of a click of every row."""
        raw = np.full(len(x), self.start)
        for t in self.trees:
            raw += t.predict(x)
        return 1.0 / (1.0 + np.exp(-raw))


class _Leaf:
    """Rows of a leaf with the sums of its histogram and its best split."""

    def __init__(self, rows: np.ndarray, sums: np.ndarray):
        self.rows, self.sums, self.node = rows, sums, -1
        below = np.cumsum(sums, axis=2)  # (gradient, curvature, rows) x feature x bin
        whole = below[:, :1, -1:]
        above = whole - below
        ok = (below[2] >= LEAST_ROWS) & (above[2] >= LEAST_ROWS) & (below[1] >= _LEAST_CURVATURE) & (above[1] >= _LEAST_CURVATURE)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = below[0] ** 2 / below[1] + above[0] ** 2 / above[1] - (whole[0] ** 2 / whole[1])
        gain = np.where(ok, gain, -np.inf)
        self.feature, self.bin = (int(v) for v in np.unravel_index(int(gain.argmax()), gain.shape))
        self.gain = float(gain[self.feature, self.bin])
        self.value = float(-whole[0, 0, 0] / max(whole[1, 0, 0], 1e-12))


def fit(x: np.ndarray, y: np.ndarray, features: Sequence[str], iterations: int = ITERATIONS, rate: float = RATE, leaves: int = LEAVES) -> Model:
    """Trees on rows ``x`` (n x features) with labels ``y`` of 0 and 1. Without rows, or with labels all alike, no tree is grown."""
    n, f = x.shape
    share = float(y.mean()) if n else 0.0
    if not 0 < share < 1:
        return Model(tuple(features), 20.0 if share >= 1 else -20.0)
    model = Model(tuple(features), float(np.log(share / (1 - share))))
    edges = []
    for j in range(f):
        values = np.unique(x[:, j])
        middle = (values[:-1] + values[1:]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(middle)
    width = BINS + 1
    codes = [np.searchsorted(edges[j], x[:, j], side="left").astype(np.uint8) for j in range(f)]  # a byte a value, by feature
    raw = np.full(n, model.start)
    every = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)

    def histogram(rows: np.ndarray | None, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of a leaf's rows, of all rows for None: (gradient, curvature, rows) x feature x bin."""
        sums = np.empty((3, f, width))
        if rows is not None:
            g, h = g[rows], h[rows]

        def fill(j: int) -> None:
            code = (codes[j] if rows is None else codes[j][rows]).astype(np.intp)
            sums[0, j], sums[1, j], sums[2, j] = np.bincount(code, g, width), np.bincount(code, h, width), np.bincount(code, minlength=width)

        list((pool.map if len(g) >= THREADED_ROWS else map)(fill, range(f)))
        return sums

    pool = ThreadPoolExecutor(min(f, THREADS))
    for _ in range(iterations):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, left, right, value = [-1], [0.0], [0], [0], [0.0]
        root = _Leaf(every, histogram(None, g, h))
        root.node, made, done = 0, 1, []
        heap = [(-root.gain, 0, root)]
        while heap:
            _, _, leaf = heapq.heappop(heap)
            if made >= leaves or not leaf.gain > 1e-12:
                done.append(leaf)
                continue
            low = codes[leaf.feature][leaf.rows] <= leaf.bin
            sides = [leaf.rows[low], leaf.rows[~low]]
            small = int(len(sides[1]) < len(sides[0]))
            few = histogram(sides[small], g, h)
            both = [few, leaf.sums - few] if small == 0 else [leaf.sums - few, few]
            feature[leaf.node], cut[leaf.node] = leaf.feature, float(edges[leaf.feature][leaf.bin])
            for rows, sums, child in zip(sides, both, (left, right)):
                next_leaf = _Leaf(rows, sums)
                next_leaf.node = child[leaf.node] = len(feature)
                for column, first in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    column.append(first)
                heapq.heappush(heap, (-next_leaf.gain, next_leaf.node, next_leaf))
            made += 1
        for leaf in done:
            value[leaf.node] = rate * leaf.value
            raw[leaf.rows] += value[leaf.node]
        model.trees.append(Tree(np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), np.array(right, np.int32), np.array(value)))
    pool.shutdown()
    return model
