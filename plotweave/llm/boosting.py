"""Gradient-boosted trees for a yes/no label, in numpy: histograms, monotone features, flat nodes.

The fit runs on a bounded sample whose size the callers document. The result is a set of flat node
arrays, so a batch is scored by a few gathers per level, and a tree can be spelled as SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

import numpy as np


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf points at itself and has its value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def sql(self, names: Sequence[str]) -> list[str]:
        """One SQL expression per tree."""

        def spell(node: int) -> str:
            if self.left[node] == node:
                return f"{self.value[node]!r}D".replace("np.float64(", "").replace(")", "")
            test = f"{names[self.feature[node]]} <= {float(self.threshold[node])!r}D"
            return f"CASE WHEN {test} THEN {spell(self.left[node])} ELSE {spell(self.right[node])} END"

        return [spell(root) for root in self.roots]


def fit_forest(
    x: np.ndarray, y: np.ndarray, signs: Sequence[int] | None = None, trees: int = 40, depth: int = 4,
    rate: float = 0.2, bins: int = 64, smoothing: float = 1.0, least: int = 8,
) -> Forest:
    """Fit on rows `x` and labels `y` of 0 and 1.

    `signs` holds 1, -1 or 0 per feature: the score never falls, never rises, or is free as the
    feature grows. A split that would break this is not taken, and the midpoint of a split on such
    a feature bounds the leaves on both sides below it. No rows or one label only give the base rate.
    """
    n, width = x.shape
    signs = np.zeros(width, int) if signs is None else np.asarray(signs)
    share = (y.sum() + 1.0) / (n + 2.0)
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            step = np.zeros(n)
            roots.append(_grow(nodes, cuts, binned, p - y, p * (1 - p), signs, depth, rate, smoothing, least, step))
            margin += step
    table = np.array(nodes, float).reshape(-1, 5)
    return Forest(
        table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4],
        np.array(roots, np.int64), depth, base,
    )


def _grow(nodes, cuts, binned, grad, hess, signs, depth, rate, smoothing, least, step) -> int:
    """Add one tree to the node list; `step` receives its value per row."""

    def leaf(rows, low, high):
        value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + smoothing), low, high))
        step[rows] = rate * value
        nodes.append([0, 0.0, len(nodes), len(nodes), rate * value])
        return len(nodes) - 1

    def build(rows, level, low, high):
        best = _best_split(cuts, binned[rows], grad[rows], hess[rows], signs, low, high, smoothing, least) if level < depth else None
        if best is None:
            return leaf(rows, low, high)
        feature, cut, middle = best
        at = len(nodes)
        nodes.append([feature, cuts[feature][cut], at, at, 0.0])
        goes_left = binned[rows, feature] <= cut
        rising, falling = signs[feature] > 0, signs[feature] < 0
        nodes[at][2] = build(rows[goes_left], level + 1, middle if falling else low, middle if rising else high)
        nodes[at][3] = build(rows[~goes_left], level + 1, middle if rising else low, middle if falling else high)
        return at

    return build(np.arange(len(grad)), 0, -np.inf, np.inf)


def _best_split(cuts, binned, grad, hess, signs, low, high, smoothing, least):
    def gain(g, h, v):
        return -(g * v + 0.5 * (h + smoothing) * v * v)

    total_g, total_h, n = grad.sum(), hess.sum(), len(grad)
    worth = gain(total_g, total_h, np.clip(-total_g / (total_h + smoothing), low, high))
    best, most = None, 1e-6
    for f, sign in enumerate(signs):
        size = len(cuts[f]) + 1
        if size < 2:
            continue
        g = np.cumsum(np.bincount(binned[:, f], grad, size))[:-1]
        h = np.cumsum(np.bincount(binned[:, f], hess, size))[:-1]
        c = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
        left = np.clip(-g / (h + smoothing), low, high)
        right = np.clip(-(total_g - g) / (total_h - h + smoothing), low, high)
        score = gain(g, h, left) + gain(total_g - g, total_h - h, right) - worth
        score[(c < least) | (n - c < least) | (sign * (right - left) < 0)] = -np.inf
        at = int(np.argmax(score))
        if score[at] > most:
            best, most = (f, at, (left[at] + right[at]) / 2), score[at]
    return best
