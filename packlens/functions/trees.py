"""Regression trees as arrays: grown to full depth over the rows of one task, walked, and split by histograms.

A tree is two arrays in level order: ``split``, the feature of an inner node or -1 for a leaf, and ``value``,
the threshold of an inner node (rows at or below it go left) or the mean label of a leaf. The two children of
the k-th inner node are nodes 2k+1 and 2k+2. Features are the rows of ``x``, so that one feature lies together.

Splits are chosen by the drop of squared error. Labels are taken as whole multiples of a small step for that, so
sums are exact and the same rows give the same tree in whatever order they come.
"""

from __future__ import annotations

import numpy as np


def steps(y: np.ndarray, centre: float, scale: float) -> np.ndarray:
    """Labels as whole numbers of steps from the centre."""
    return np.rint((y - centre) * scale)


def step_scale(count: int, reach: float) -> float:
    """Steps a unit, the most for which sums over ``count`` labels, up to ``reach`` from the centre, stay exact in doubles and a label in 31 bits."""
    return 2.0 ** np.floor(np.log2(2.0**51 / (max(count, 2**21) * max(reach, 1e-9))))


def walk(split: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    found = np.zeros(x.shape[1], np.int64)
    if split[0] < 0:
        return found
    left = 2 * np.cumsum(split >= 0) - 1
    rows, at = np.arange(x.shape[1]), found.copy()
    while rows.size:
        at = left[at] + (x[split[at], rows] > value[at])
        inner = split[at] >= 0
        found[rows[~inner]] = at[~inner]
        rows, at = rows[inner], at[inner]
    return found


def _ranked(x: np.ndarray) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Features that can split, their rows in order of value, and each row's rank.

    A feature that orders the rows as an earlier one does is left out: it has the same splits.
    """
    features, orders, ranks = [], [], []
    for f, values in enumerate(x):
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        rank = np.empty(len(values), np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] > 0 and not any(np.array_equal(rank, r) for r in ranks):
            features.append(f)
            orders.append(order)
            ranks.append(rank)
    return features, orders, ranks


def _best(order: np.ndarray, rank: np.ndarray, drawn: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bounds: tuple[np.ndarray, ...]):
    """For each node the best score of a split by one feature, -1 without any, and its last row on the left.

    ``order`` has the rows of a node together, by value; ``bounds`` has the sums of weights and labels before and up to
    the end of each row's node. The score is what the squared error falls by, but for a constant.
    """
    pair, r = drawn[order].view(np.int32).reshape(-1, 2), rank[order]
    before_w, until_w, before_s, until_s = bounds
    nl = np.cumsum(pair[:, 1], dtype=np.float64)
    sl = np.cumsum(np.multiply(pair[:, 0], pair[:, 1], dtype=np.float64))
    nr, sr = until_w - nl, until_s - sl
    nl -= before_w
    sl -= before_s
    ends = starts + sizes - 1
    nr[ends] = 1.0
    sl *= sl
    sr *= sr
    sl /= nl
    sr /= nr
    sl += sr
    sl[:-1][r[1:] == r[:-1]] = -1.0
    sl[ends] = -1.0
    best = np.maximum.reduceat(sl, starts)
    hits = np.flatnonzero(sl == np.repeat(best, sizes))
    return best, hits[np.searchsorted(hits, starts)]


def grow(x: np.ndarray, y: np.ndarray, q: np.ndarray, w: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The tree over rows with labels ``y``, the same in steps ``q``, and weights ``w``: every feature at every
    split, nodes split until their labels are equal or no feature parts them, or down to ``depth``."""
    # A row's label and weight in one word, which is read once.
    drawn = np.stack([q, w], axis=1).astype(np.int32).view(np.int64).ravel()
    w = w.astype(np.float64)
    wq, wy = w * q, w * y
    features, orders, ranks = _ranked(x)
    splits, values = [], []
    count, total = np.array([w.sum()]), np.array([wq.sum()])
    mean = np.array([wy.sum() / w.sum()])
    open_ = np.array([bool(features) and y.min() < y.max()])
    starts, sizes = np.zeros(1, np.int64), np.array([len(y)], np.int64)
    codes = np.array(ranks, np.int32).reshape(len(features), len(y))
    side = np.empty(len(y), np.int8)
    level = 0
    while True:
        if depth is not None and level >= depth:
            open_[:] = False
        split, value = np.full(len(mean), -1, np.int8), mean
        at = np.flatnonzero(open_)
        if at.size:
            best, chosen = np.full(at.size, -1.0), np.zeros(at.size, np.int64)
            last, after = np.zeros(at.size, np.int64), np.zeros(at.size, np.int64)
            until = np.cumsum(count[at]), np.cumsum(total[at])
            bounds = tuple(np.repeat(v, sizes) for u, t in zip(until, (count[at], total[at]), strict=True) for v in (u - t, u))
            for f, order in enumerate(orders):
                score, place = _best(order, ranks[f], drawn, starts, sizes, bounds)
                better = score > best
                best[better], chosen[better] = score[better], f
                last[better] = order[place[better]]
                after[better] = order[place[better] + 1]
            parted = best >= 0
            kind = np.asarray(features)[chosen]
            low, high = x[kind, last], x[kind, after]
            middle = low / 2 + high / 2
            middle = np.where((middle >= low) & (middle < high), middle, low)
            split[at[parted]] = kind[parted]
            value = mean.copy()
            value[at[parted]] = middle[parted]
        splits.append(split)
        values.append(value)
        if not at.size or not parted.any():
            break
        # The rows of the parted nodes, each with its child; children are numbered in level order.
        node = np.repeat(np.arange(at.size), sizes)
        keep = parted[node]
        rows, node = orders[0][keep], node[keep]
        right = codes[chosen[node], rows] > codes[chosen[node], last[node]]
        child = 2 * (np.cumsum(parted) - 1)[node] + right
        n = 2 * int(parted.sum())
        held = np.bincount(child, minlength=n)
        count, total = np.bincount(child, w[rows], n), np.bincount(child, wq[rows], n)
        mean = np.bincount(child, wy[rows], n) / count
        some = np.empty(n, np.int64)
        some[child] = rows
        open_ = np.bincount(child[y[rows] != y[some[child]]], minlength=n) > 0
        side[orders[0]] = 2
        side[rows] = np.where(open_[child], right, 2)
        sizes = held[open_]
        starts = np.cumsum(sizes) - sizes
        to_left = np.repeat(np.flatnonzero(open_) % 2 == 0, sizes)
        places = np.flatnonzero(to_left), np.flatnonzero(~to_left)
        for f, order in enumerate(orders):
            s = side[order]
            orders[f] = np.empty(to_left.size, np.int64)
            for k, place in enumerate(places):
                orders[f][place] = order[s == k]
        level += 1
    return np.concatenate(splits), np.concatenate(values)
