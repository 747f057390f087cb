"""Gradient-boosted regression trees on a bounded sample, for the rule ensemble and for the quality rules.

The sample (a parameter of the callers) is the only thing fitted on the driver; scoring runs in the tasks.
Trees are grown on quantile bins with logistic loss. Where a feature is constrained (+1 rising, -1 falling), a split
whose sides disagree is refused and the midpoint of the sides' values bounds everything grown below, so that the
whole score is monotonic in the feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Node arrays of all trees; a leaf points at itself. ``roots`` holds the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; a value goes left where it is at most the threshold."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.15, monotone: dict[int, int] | None = None, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost ``rounds`` trees. Without rows, or with one class only, the result is a constant: the prior with one pseudo-row of each class."""
    monotone = monotone or {}
    prior = (float(np.sum(y)) + 1.0) / (len(y) + 2.0)
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < np.sum(y) < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_levels: int) -> int:
            me = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-total_g / (total_h + ridge), low, high))
            nodes.append([0, 0.0, me, me, rate * value])
            best = (1e-6, -1, -1, 0.0, 0.0)
            for f, c in enumerate(cuts) if left_levels else ():
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
                allowed = (hl >= least) & (hr >= least) & ((vr - vl) * monotone.get(f, 0) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            if best[1] >= 0:
                _, f, k, vl, vr = best
                middle, sign = (vl + vr) / 2, monotone.get(f, 0)
                goes_left = binned[rows, f] <= k
                a = grow(rows[goes_left], g, h, middle if sign < 0 else low, middle if sign > 0 else high, left_levels - 1)
                b = grow(rows[~goes_left], g, h, middle if sign > 0 else low, middle if sign < 0 else high, left_levels - 1)
                nodes[me] = [f, float(cuts[f][k]), a, b, rate * value]
            return me

        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-margin))
            first = len(nodes)
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, depth))
            margin += _of_tree(nodes, first, x, depth)
    table = np.array(nodes, dtype=float).reshape(-1, 5)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, dtype=int), base, depth)


def _of_tree(nodes: list[list[float]], root: int, x: np.ndarray, depth: int) -> np.ndarray:
    part = np.array(nodes[root:])
    at, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
    for _ in range(depth):
        at = np.where(x[rows, part[at, 0].astype(int)] <= part[at, 1], part[at, 2].astype(int) - root, part[at, 3].astype(int) - root)
    return part[at, 4]


#: Per feature the half-open interval (low, high] that a path allows.
Rule = tuple[tuple[int, float, float], ...]


def rules(trees: Trees) -> list[Rule]:
    """The conjunction of every path from a root to a node below it, each once."""
    found: dict[Rule, None] = {}

    def walk(node: int, box: dict[int, tuple[float, float]]) -> None:
        if box:
            found[tuple((f, low, high) for f, (low, high) in sorted(box.items()))] = None
        if trees.left[node] == node:
            return
        f, cut = int(trees.feature[node]), float(trees.threshold[node])
        low, high = box.get(f, (-np.inf, np.inf))
        walk(int(trees.left[node]), box | {f: (low, min(high, cut))})
        walk(int(trees.right[node]), box | {f: (max(low, cut), high)})

    for root in trees.roots:
        walk(int(root), {})
    return list(found)


def satisfied(found: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(found)), dtype=float)
    for k, rule in enumerate(found):
        for f, low, high in rule:
            out[:, k] *= (x[:, f] > low) & (x[:, f] <= high)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean logistic loss + penalty * sum of |weights| (accelerated proximal gradient)."""
    n, k = r.shape
    prior = (float(y.sum()) + 1.0) / (n + 2.0)
    b, w = float(np.log(prior / (1 - prior))), np.zeros(k)
    if not n or not k or y.min() == y.max():
        return b, w
    a = np.hstack([np.ones((n, 1)), r])
    vector = np.ones(k + 1)
    for _ in range(30):  # largest eigenvalue, for the step
        vector = a.T @ (a @ vector)
        vector /= np.linalg.norm(vector)
    step = 4.0 * n / float(vector @ (a.T @ (a @ vector)))
    theta = np.concatenate([[b], w])
    ahead, t = theta.copy(), 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-(a @ ahead)))
        new = ahead - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, theta, t = new + (t - 1) / t_new * (new - theta), new, t_new
    return float(theta[0]), theta[1:]
