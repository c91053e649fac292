"""Shapley values of a forest's mean path length, exact, by the weights of its paths.

A leaf's path asks for an interval of each feature on it. With some features known and the others drawn
as the training rows were, the leaf is reached with the product of 1 or 0 for each known feature (its value is in
the interval or not) and, for each unknown one, the share of rows that its splits on the path let through.
Shapley values are sums over the known sets, so a leaf gives each of its m features a number that depends only
on which of the m intervals hold. These 2^m x m numbers of each leaf are made once, by multiplying out the
polynomials of the path; for a row, m comparisons a leaf look them up.

The values of a row sum to its mean path length less that of the training rows. A forest of t trees of n rows
has at most t * n leaves, so the tables' size is bounded by t * n * 2^features rows whatever the data.
"""

from __future__ import annotations

from math import comb

import numpy as np

#: A tree: feature (-1: leaf), split, left child (the right one follows it), mean path length below, training rows.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Leaves times rows that are looked up together.
TOGETHER = 200_000


def leaves(tree: Tree) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, feature -> (above, up to, share of training rows let through)) of every leaf that rows reach."""
    feature, split, left, length, cover = tree
    out, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        f = int(feature[at])
        if f < 0:
            out.append((float(length[at]), path))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        a, b = int(left[at]), int(left[at]) + 1
        todo.append((a, path | {f: (low, min(high, float(split[at])), share * cover[a] / cover[at])}))
        todo.append((b, path | {f: (max(low, float(split[at])), high, share * cover[b] / cover[at])}))
    return out


def weights(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """[leaf, pattern, feature] for leaves with m features each: bit k of a pattern says that interval k holds."""
    n, m = shares.shape
    holds = (np.arange(1 << m)[:, None] >> np.arange(m)[None, :] & 1).astype(float)  # [pattern, feature]
    out = np.empty((n, 1 << m, m))
    for i in range(m):
        # coefficients by number of known features of the product over the others of (share + holds * y)
        known = np.zeros((n, 1 << m, m))
        known[..., 0] = 1.0
        for j in range(m):
            if j != i:
                more = known[..., :-1] * holds[None, :, j, None]
                known *= shares[:, None, j, None]
                known[..., 1:] += more
        size = np.array([1.0 / (m * comb(m - 1, s)) for s in range(m)])  # |S|! (m - |S| - 1)! / m!
        out[..., i] = values[:, None] * (holds[None, :, i] - shares[:, i, None]) * (known @ size)
    return out


class Explainer:
    """The tables of a forest."""

    def __init__(self, forest: list[Tree], features: int):
        self.features, self.trees = features, len(forest)
        #: by number of features on the path: (features, above, up to) as [leaf, k], and the table [leaf, pattern, k]
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        every = [leaf for tree in forest for leaf in leaves(tree)]
        self.base = sum(float(t[3][0]) for t in forest) / max(1, len(forest))
        for m in sorted({len(p) for _, p in every} - {0}):
            mine = [(v, sorted(p.items())) for v, p in every if len(p) == m]
            places = np.array([[f for f, _ in p] for _, p in mine])
            low, high, share = (np.array([[x[i] for _, x in p] for _, p in mine]) for i in range(3))
            self.groups.append((places, low, high, weights(np.array([v for v, _ in mine]), share).astype(np.float32)))

    def values(self, x: np.ndarray) -> np.ndarray:
        """[row, feature]: Shapley values of the mean path length."""
        out = np.zeros((len(x), self.features))
        for places, low, high, table in self.groups:
            n, m = places.shape
            step = max(1, TOGETHER // max(1, len(x)))
            for a in range(0, n, step):
                some = slice(a, min(n, a + step))
                pattern = np.zeros((len(x), some.stop - a), dtype=np.int64)
                for k in range(m):
                    v = x[:, places[some, k]]
                    pattern |= ((v > low[some, k]) & (v <= high[some, k])).astype(np.int64) << k
                given = table[np.arange(a, some.stop)[None, :], pattern]  # [row, leaf, k]
                for k in range(m):
                    onto = np.zeros((some.stop - a, self.features))
                    onto[np.arange(some.stop - a), places[some, k]] = 1.0
                    out += given[..., k].astype(float) @ onto
        return out / self.trees
