"""A small random forest on dense features, trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES = 40
DEPTH = 8
LEAF = 4
CUTS = 24


@dataclass
class Tree:
    feature: np.ndarray  # -1 in a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of label 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            inner = f >= 0
            below = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
        return self.share[at]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Tree]:
    """TREES trees, each on a bootstrap sample, each split among a random third of the features."""
    rng = np.random.default_rng(seed)
    return [_grow(x[pick], y[pick], rng) for pick in (rng.integers(0, len(x), len(x)) for _ in range(TREES))]


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean share of label 1 over the trees; 0 without trees."""
    if not trees or not len(x):
        return np.zeros(len(x))
    return np.mean([t.predict(x) for t in trees], axis=0)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    rows: list[list[float]] = []

    def node(own: np.ndarray, depth: int) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, float(y[own].mean())])
        if depth < DEPTH and len(own) >= 2 * LEAF and 0 < rows[at][4] < 1:
            split = _best_split(x[own], y[own], rng)
            if split:
                feature, cut = split
                below = x[own, feature] <= cut
                rows[at][:2] = [feature, cut]
                rows[at][2] = node(own[below], depth + 1)
                rows[at][3] = node(own[~below], depth + 1)
        return at

    node(np.arange(len(x)), 0)
    table = np.array(rows)
    return Tree(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4])


def _best_split(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
    best, found = 1e-9, None
    n, positive = len(y), y.sum()
    whole = positive * (n - positive) / n
    for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 3)]:
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[:-1]))
        below = x[:, f][:, None] <= cuts
        size, hits = below.sum(axis=0), (below * y[:, None]).sum(axis=0)
        good = (size >= LEAF) & (n - size >= LEAF)
        if not good.any():
            continue
        size, hits, cuts = size[good], hits[good], cuts[good]
        rest, rest_hits = n - size, positive - hits
        gain = whole - hits * (size - hits) / size - rest_hits * (rest - rest_hits) / rest
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = float(gain[k]), (int(f), float(cuts[k]))
    return found
