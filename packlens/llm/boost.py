"""Gradient-boosted regression trees for two classes, in numpy, with a calibrated probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Boosted:
    """Trees of a fixed depth as arrays (trees x inner nodes, trees x leaves), then a logistic calibration."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    slope: float
    shift: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _tree(x: np.ndarray, pull: np.ndarray, weight: np.ndarray, depth: int, shrink: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree by second-order gains over quantile bins, level by level."""
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for at in range(inner):
        own = np.flatnonzero(node == at)
        best = (1e-6, 0, np.inf)
        if len(own) >= 20:
            g, h = pull[own], weight[own]
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in range(x.shape[1]):
                v = x[own, f]
                for c in np.unique(np.quantile(v, np.linspace(0, 1, BINS)[:-1], method="lower")):
                    left = v <= c
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                    if gain > best[0]:
                        best = (gain, f, c)
        feature[at], cut[at] = best[1], best[2]
        node[own] = 2 * at + 1 + (x[own, best[1]] > best[2])
    leaf = np.zeros(inner + 1)
    for k in range(inner + 1):
        own = node == inner + k
        leaf[k] = shrink * pull[own].sum() / (weight[own].sum() + 1)
    return feature, cut, leaf


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, shrink: float = 0.3, precision: float = 0.99, seed: int = 1) -> Boosted:
    """Three quarters of the rows grow the trees; the rest calibrate them and set the least threshold of that precision."""
    order = np.random.default_rng(seed).permutation(len(y))
    grow, rest = order[: len(order) * 3 // 4], order[len(order) * 3 // 4 :]
    share = np.clip(y[grow].mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    z, parts = np.full(len(grow), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        part = _tree(x[grow], y[grow] - p, p * (1 - p), depth, shrink)
        parts.append(part)
        one = Boosted(part[0][None], part[1][None], part[2][None], 0.0, 1.0, 0.0, 0.5)
        z = z + one.margin(x[grow])
    raw = Boosted(*(np.stack([p[i] for p in parts]) for i in range(3)), start, 1.0, 0.0, 0.5)
    m, target = raw.margin(x[rest]), y[rest]
    slope, shift = 1.0, 0.0
    for _ in range(200):  # logistic calibration by gradient descent
        wrong = 1 / (1 + np.exp(-(slope * m + shift))) - target
        slope -= 0.05 * (wrong * m).mean()
        shift -= 0.05 * wrong.mean()
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    threshold = 0.95
    for c in np.unique(np.round(p, 3)):
        taken = p >= c
        if c >= 0.5 and taken.any() and target[taken].mean() >= precision:
            threshold = float(c)
            break
    return Boosted(raw.feature, raw.cut, raw.leaf, start, float(slope), float(shift), threshold)
