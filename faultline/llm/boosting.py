"""Gradient-boosted trees, and the paths of their trees.

Trees are grown by depth on binned features with the logistic loss. A tree is three flat
arrays, so it can be evaluated on arrays inside a task or read as rules. ``fit`` takes a
bounded sample as arrays; ``fit_spread`` takes rows of any number, which stay in their tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark import RDD, StorageLevel


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: leaf
    bound: list[float] = field(default_factory=list)  # left if value <= bound
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, feature: int = -1, bound: float = 0.0, value: float = 0.0) -> int:
        for col, x in zip((self.feature, self.bound, self.left, self.right, self.value), (feature, bound, -1, -1, value)):
            col.append(x)
        return len(self.feature) - 1

    def ends(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(x), np.int64)
        feature, bound, left, right = (np.array(c) for c in (self.feature, self.bound, self.left, self.right))
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            n = node[inner]
            node[inner] = np.where(x[inner, f[inner]] <= bound[n], left[n], right[n])


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.ends(x)]
        return out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    u = np.unique(x)
    if len(u) > bins:
        u = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="lower"))
    return u[:-1]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32,
        least: int = 5, shrink: float = 1.0) -> Boosted:
    """x: rows x features, y: 0 or 1."""
    rows, features = x.shape
    cuts = [_cuts(x[:, j], bins) for j in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if rows else x.astype(int)
    share = np.clip(y.mean() if rows else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, grown = np.full(rows, start), []

    def grow(tree: Tree, index: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        sg, sh = g[index].sum(), h[index].sum()
        best = (1e-6, -1, 0)
        if level < depth and len(index) >= 2 * least:
            for j in range(features):
                k = len(cuts[j])
                if not k:
                    continue
                b = binned[index, j]
                cg = np.cumsum(np.bincount(b, g[index], k + 1))[:-1]
                ch = np.cumsum(np.bincount(b, h[index], k + 1))[:-1]
                cn = np.cumsum(np.bincount(b, minlength=k + 1))[:-1]
                gain = cg**2 / (ch + shrink) + (sg - cg)**2 / (sh - ch + shrink) - sg**2 / (sh + shrink)
                gain[(cn < least) | (len(index) - cn < least)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at)
        if best[1] < 0:
            return tree.add(value=float(-rate * sg / (sh + shrink)))
        _, j, at = best
        me = tree.add(j, float(cuts[j][at]))
        goes = binned[index, j] <= at
        tree.left[me] = grow(tree, index[goes], g, h, level + 1)
        tree.right[me] = grow(tree, index[~goes], g, h, level + 1)
        return me

    for _ in range(trees if rows else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = Tree()
        grow(tree, np.arange(rows), p - y, np.maximum(p * (1 - p), 1e-6), 0)
        grown.append(tree)
        margin += Boosted(0.0, [tree]).margin(x)
    return Boosted(start, grown)


def cuts_of(values: np.ndarray, counts: np.ndarray, bins: int = 32) -> np.ndarray:
    """The cuts of :func:`fit` from the distinct values, ascending, and how often each occurs."""
    if len(values) > bins:
        at = np.floor(np.linspace(0, 1, bins + 1) * (counts.sum() - 1)).astype(np.int64)
        values = np.unique(values[np.searchsorted(np.cumsum(counts), at, "right")])
    return values[:-1]


def fit_spread(blocks: RDD, cuts: list[np.ndarray], trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5,
               shrink: float = 1.0) -> Boosted:
    """The trees of :func:`fit` from blocks of (binned rows, y, how often each row counts).

    Each level of a tree is one job that sums gradients by node, feature and bin; the driver
    holds those sums only. They are sums of whole numbers of 2^-24, the same in any order."""
    features, width = len(cuts), max(len(c) for c in cuts) + 1
    rows, hits = blocks.map(lambda b: np.array([b[2].sum(), (b[1] * b[2]).sum()])).treeReduce(np.add)
    share = np.clip(hits / rows, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    room = np.array([np.arange(width - 1) < len(c) for c in cuts])
    now, held, grown = blocks.map(lambda b: (*b, np.full(len(b[1]), start))), None, []

    def value(sums) -> float:
        return float(-rate * sums[0] / (sums[1] + shrink))

    for _ in range(trees):
        now.persist(StorageLevel.MEMORY_AND_DISK)
        tree = Tree()
        tree.add()
        front = [0]
        for level in range(depth):
            sums = now.map(partial(_level_sums, tree, front, features, width)).treeReduce(np.add)
            sums = sums.reshape(len(front), features, width, 3) / np.array([_UNIT, _UNIT, 1])
            nodes, front = front, []
            for node, cells in zip(nodes, sums):
                whole = cells[0].sum(0)
                tree.value[node] = value(whole)
                low = np.cumsum(cells, 1)[:, :-1]
                high = whole - low
                gain = sum(s[..., 0] ** 2 / (s[..., 1] + shrink) for s in (low, high)) - whole[0] ** 2 / (whole[1] + shrink)
                gain[~room | (low[..., 2] < least) | (high[..., 2] < least)] = -1
                j, at = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
                if not gain.size or gain[j, at] <= 1e-6:
                    continue
                tree.feature[node], tree.bound[node] = int(j), int(at)
                tree.left[node], tree.right[node] = (tree.add(value=value(s[j, at])) for s in (low, high))
                front += [n for n, s in ((tree.left[node], low), (tree.right[node], high)) if s[j, at, 2] >= 2 * least]
            if not front:
                break
        grown.append(tree)
        if held:  # the margins of the last tree are held by now
            held.unpersist()
        now, held = now.map(partial(_stepped, tree)), now
    if held:
        held.unpersist()
    for tree in grown:
        tree.bound = [float(cuts[f][int(at)]) if f >= 0 else 0.0 for f, at in zip(tree.feature, tree.bound)]
    return Boosted(start, grown)


_UNIT = 2.0**24


def _stepped(tree: Tree, block: tuple) -> tuple:
    x, y, n, margin = block
    return x, y, n, margin + np.array(tree.value)[tree.ends(x)]


def _level_sums(tree: Tree, front: list[int], features: int, width: int, block: tuple) -> np.ndarray:
    """Gradients, their slopes and rows by node of ``front``, feature and bin."""
    x, y, n, margin = block
    place = np.full(len(tree.feature), -1)
    place[front] = np.arange(len(front))
    node = place[tree.ends(x)]
    take = node >= 0
    x, y, n, node = x[take], y[take], n[take], node[take]
    p = 1 / (1 + np.exp(-margin[take]))
    cell = ((node[:, None] * features + np.arange(features)) * width + x).ravel()
    parts = (np.rint((p - y) * _UNIT) * n, np.rint(np.maximum(p * (1 - p), 1e-6) * _UNIT) * n, n)
    size = len(front) * features * width
    return np.stack([np.bincount(cell, np.repeat(w, features), size) for w in parts], axis=1).astype(np.int64)


def paths(model: Boosted) -> list[tuple[tuple[int, bool, float], ...]]:
    """The conjunctions that lead from the roots to every inner node and leaf, each once:
    (feature, whether it must be above, bound)."""
    found: dict[tuple, None] = {}

    def walk(t: Tree, node: int, path: tuple) -> None:
        if path:
            found.setdefault(tuple(sorted(path)))
        if t.feature[node] >= 0:
            walk(t, t.left[node], (*path, (t.feature[node], False, t.bound[node])))
            walk(t, t.right[node], (*path, (t.feature[node], True, t.bound[node])))

    for t in model.trees:
        walk(t, 0, ())
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression (accelerated proximal
    gradient); x holds 0/1 rules."""
    n, m = x.shape
    w, b = np.zeros(m), 0.0
    vw, vb, t = w.copy(), b, 1.0
    size = 4 * n / max(1e-9, np.linalg.norm(np.c_[x, np.ones(n)], 2) ** 2) if n else 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(x @ vw + vb))) - y
        step = vw - size * (x.T @ r) / n
        new_w = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        new_b = vb - size * r.sum() / n
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return float(b), w
