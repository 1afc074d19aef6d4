"""Cosine scores of blocks of vectors, in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

HIT_SCHEMA = "qid long, chunk_id long, score double"
# Scores are compared at ten places, so equal vectors tie whatever the order of summation.
SCORE_PLACES = 10
# Products of unit vectors in single precision are off by at most this, times the dimensions and a few more.
SINGLE_SLACK = 2.0**-23
# Where more of a block's pairs than this are left, the block is multiplied whole.
DENSE_SHARE = 1 / 32
# Queries that meet a block of vectors at once, and pairs that are multiplied one by one at once.
QUERY_BLOCK = 1024
PAIRS = 1 << 15


def unit(vectors) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays zero and scores 0."""
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns per row, by score and then the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def block_best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """k best of one block of vectors (ids ascending) for each query row."""
    scores = np.round(queries @ vectors.T, SCORE_PLACES)
    if scores.shape[1] <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above = scores > kth
    level = scores == kth
    room = k - above.sum(axis=1, keepdims=True)
    rows, columns = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))
    shape = (scores.shape[0], k)
    return scores[rows, columns].reshape(shape), ids[columns].reshape(shape)


def improve(
    scores: np.ndarray, found: np.ndarray, queries: np.ndarray, near: np.ndarray, vectors: np.ndarray, ids: np.ndarray, floor=-np.inf
) -> None:
    """Puts the best of a block of vectors (ids ascending) into the k best so far of each query row, in place.

    ``near`` holds the queries in single precision. Its products are off by less than the slack, so pairs that
    stay below a row's k-th score, or its ``floor``, by more are out; only what is left is multiplied in double
    precision.
    """
    k = scores.shape[1]
    rough = near @ vectors.astype(np.float32).T
    reach = np.maximum(scores[:, k - 1], floor) - 10.0**-SCORE_PLACES - SINGLE_SLACK * (vectors.shape[1] + 8)
    # A vector that holds no number must not hide the others of its block.
    rows = np.flatnonzero(~(rough.max(axis=1) < reach))
    open_ = rough[rows] >= reach[rows, None]
    some = open_.any(axis=1)
    rows, open_ = rows[some], open_[some]
    if not len(rows):
        return
    if open_.mean() > DENSE_SHARE:
        new_scores, new_ids = block_best(queries[rows], vectors, ids, k)
        both = np.concatenate([scores[rows], new_scores], axis=1), np.concatenate([found[rows], new_ids], axis=1)
        scores[rows], found[rows] = best(*both, k)
        return
    at, columns = np.nonzero(open_)
    exact = np.empty(len(at))
    for i in range(0, len(at), PAIRS):
        part = slice(i, i + PAIRS)
        exact[part] = np.einsum("ij,ij->i", queries[rows[at[part]]], vectors[columns[part]])
    who = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
    all_scores = np.concatenate([scores[rows].ravel(), np.round(exact, SCORE_PLACES)])
    all_ids = np.concatenate([found[rows].ravel(), ids[columns]])
    order = np.lexsort((all_ids, -all_scores, who))
    starts = np.searchsorted(who[order], np.arange(len(rows)))
    first = order[starts[:, None] + np.arange(k)]
    scores[rows], found[rows] = all_scores[first], all_ids[first]


def running_best(qids: np.ndarray, queries: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """k best per query over all blocks (ids ascending, units); memory is k rows per query and one score block."""
    scores = np.full((len(qids), k), -np.inf)
    found = np.full((len(qids), k), np.iinfo(np.int64).max)
    near = queries.astype(np.float32)
    for ids, vectors in blocks:
        for i in range(0, len(qids), QUERY_BLOCK):
            part = slice(i, i + QUERY_BLOCK)
            improve(scores[part], found[part], queries[part], near[part], vectors, ids)
    rows, columns = np.nonzero(scores > -np.inf)
    return pd.DataFrame({"qid": qids[rows], "chunk_id": found[rows, columns], "score": scores[rows, columns]})
