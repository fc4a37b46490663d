"""Gradient-boosted trees in numpy, with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in flat arrays: a leaf points at itself, so every row walks `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """The log odds of each row; a feature goes left where it is at most the threshold."""
        if not len(self.roots) or not len(rows):
            return np.full(len(rows), self.base)
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        for _ in range(self.depth):
            seen = np.take_along_axis(rows, self.feature[at], axis=1)
            at = np.where(seen <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def fit(rows: np.ndarray, labels: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """A forest for labels 0 and 1 under the logistic loss, by histogram splits on second-order gains.

    monotone has +1, -1 or 0 for each feature: along such a feature the margin never falls, or never
    rises. A split against that is not taken, and the children are held on their sides of its midpoint.
    With one class only, or no rows, the forest has no trees and is never sure: it says the smoothed share.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(labels) and 0 < labels.sum() < len(labels):
        cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(rows.shape[1])]
        codes = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(rows), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = labels - p, p * (1 - p)
            roots.append(len(nodes))
            margin += _grow(nodes, codes, cuts, gradient, weight, monotone, depth, rate, ridge, least)
    table = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Forest(whole[0], table[:, 1].copy(), whole[1], whole[2], table[:, 4].copy(), np.array(roots, dtype=np.int64), depth, base)


def _grow(nodes: list, codes: np.ndarray, cuts: list, gradient: np.ndarray, weight: np.ndarray, monotone: np.ndarray, depth: int, rate: float, ridge: float, least: float) -> np.ndarray:
    """Adds a tree to nodes; the values that it gives the rows it was grown on."""
    given = np.zeros(len(codes))

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + ridge), low, high))

    def node(at: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[at].sum(), weight[at].sum()
        here, value = len(nodes), leaf(g, h, low, high)
        nodes.append([0, np.inf, here, here, rate * value])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(codes.shape[1]) if level < depth else ():
            if not len(cuts[f]):
                continue
            size = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(codes[at, f], gradient[at], size))[:-1]
            hl = np.cumsum(np.bincount(codes[at, f], weight[at], size))[:-1]
            a, b = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
            gain = gl * a - (hl + ridge) * a * a / 2 + (g - gl) * b - (h - hl + ridge) * b * b / 2 - (g * value - (h + ridge) * value * value / 2)
            gain[(hl < least) | (h - hl < least) | (monotone[f] * (b - a) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(a[k]), float(b[k]))
        _, f, k, a, b = best
        if f < 0:
            given[at] = rate * value
            return here
        middle, side = (a + b) / 2, codes[at, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[f]), ((low, high), (low, high)))
        nodes[here][:2] = [f, cuts[f][k]]
        nodes[here][2] = node(at[side], level + 1, *bounds[0])
        nodes[here][3] = node(at[~side], level + 1, *bounds[1])
        return here

    node(np.arange(len(codes)), 0, -np.inf, np.inf)
    return given
