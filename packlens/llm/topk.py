"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Vectors are integers, one per component. Queries form blocks, candidates slices, and each block
meets each slice in one task: query rows are sent to every slice, candidate rows to every block, by
one shuffle on (block, slice). There the candidates lie in vertical layout, a row of the matrix for
each dimension. A query takes the dimensions in the order of its own weight, a few at a time. After
each step a candidate's score lies within the product of the remaining masses (Cauchy-Schwarz) of
what has been added up; candidates whose upper end is below the k-th best lower end are dropped and
the rest is compacted. What is left at the last dimension has exact scores. A task gives k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BLOCK = 4096
SLICE = 8192
STEP = 8
#: Whole numbers are exact in doubles up to here. A vector with a larger component takes no part: its product with itself is no long.
LARGEST = 1 << 53
_LONG = np.iinfo(np.int64)


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as array<bigint>; null where the vector can take no part."""
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * factor))
    usable = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LARGEST / factor)
    )
    return F.when(usable, F.transform(values, lambda x: x.cast("bigint")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest inner products of each query, ties to the smaller key.

    ``vector`` is an array of whole numbers. A query meets every candidate but the row of its own key. Null keys and
    null vectors take no part; a shorter vector counts as filled with zeros; of several rows with
    one key the least vector counts. Queries with no candidate at all give no row. A product beyond
    the range of a long is given, and ranked, as the end of that range.
    """
    own = lambda df: df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked, offered = own(queries), own(vectors)
    size = F.coalesce(F.max(F.size("v")), F.lit(0))
    (n_asked, wide_a), (n_offered, wide_o) = asked.agg(F.count("*"), size).first(), offered.agg(F.count("*"), size).first()
    blocks, slices, wide = max(1, -(-n_asked // QUERY_BLOCK)), max(1, -(-n_offered // SLICE)), max(1, wide_a, wide_o)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    cells = asked.select(part(blocks).alias("block"), spread(slices).alias("slice"), F.lit(0).alias("side"), "id", "v").unionByName(
        offered.select(spread(blocks).alias("block"), part(slices).alias("slice"), F.lit(1).alias("side"), "id", "v")
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            (q_ids, q), (c_ids, c) = (_packed(rows, side, wide) for side in (0, 1))
            if len(q_ids) and len(c_ids):
                yield _found(q_ids, q, c_ids, np.ascontiguousarray(c.T), k)

    best = cells.repartition("block", "slice").sortWithinPartitions("block", "slice", "side", "id", "v")
    found = best.mapInArrow(searched, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one (block, slice) after another; they come sorted."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = (int(keys[0, s]), int(keys[1, s]))
            if held and now != last:
                yield held
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield held


def _packed(rows: list[pa.RecordBatch], side: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors (n x wide) of one side; the first row of a key counts."""
    parts = [b.filter(pa.compute.equal(b.column(2), side)) for b in rows]
    ids = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts])
    out = np.zeros((len(ids), wide))
    at = 0
    for p in parts:
        lists = p.column(4)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[at + row, column] = values
        at += len(lengths)
    ids, first = np.unique(ids, return_index=True)
    return ids, out[first]


def _found(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, columns: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best candidates of each query; ``columns`` is dimensions x candidates, ``c_ids`` ascending."""
    masses = (columns**2).sum(axis=0)
    asked, named, scores = [], [], []
    for qid, x in zip(q_ids, q, strict=True):
        for row, score in branch_and_bound(x, columns, masses, k, int(np.searchsorted(c_ids, qid)) if qid in c_ids else -1):
            asked.append(qid)
            named.append(c_ids[row])
            scores.append(score)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (asked, named, scores)], ["query_id", "vec_id", "score"])


def branch_and_bound(x: np.ndarray, columns: np.ndarray, masses: np.ndarray, k: int, skip: int = -1) -> list[tuple[int, int]]:
    """(row, score) of the k candidates of highest inner product with ``x``, ties to the smaller row.

    Masses and partial sums of integers are exact in doubles up to 2^53 only; the bounds carry a
    margin for what lies beyond, and the final scores are computed in whole numbers of any size.
    """
    largest = float((x**2).sum()) * float(masses.max(initial=0.0))
    # What is left of a mass after subtractions is known to a share of the whole mass.
    slack = 1e-6 * np.sqrt(largest) if largest > 2.0**100 else 0.0
    order = np.argsort(-np.abs(x), kind="stable")
    alive = np.arange(columns.shape[1])
    if skip >= 0:
        alive = np.delete(alive, skip)
    sums, rest, own = np.zeros(len(alive)), masses[alive].copy(), float((x**2).sum())
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        part = columns[np.ix_(dims, alive)]
        sums += x[dims] @ part
        rest -= (part**2).sum(axis=0)
        own -= float((x[dims] ** 2).sum())
        if len(alive) > k and at + STEP < len(order):
            reach = np.sqrt(np.maximum(rest, 0) * max(own, 0.0))
            reach += 1 + slack + 1e-9 * (np.abs(sums) + reach)
            # Products beyond a long are equal to its ends, so no bound may tell them apart.
            low = min(np.partition(sums - reach, len(alive) - k)[len(alive) - k], 2.0**63)
            keep = (sums + reach >= low) | (low <= -(2.0**63))
            alive, sums, rest = alive[keep], sums[keep], rest[keep]
    if largest < 2.0**122:
        exact = x.astype(np.int64) @ columns[:, alive].astype(np.int64)
        best = np.lexsort((alive, -exact))[:k]
        return [(int(alive[i]), int(exact[i])) for i in best]
    whole = [int(v) for v in x]
    products = ((int(row), sum(a * int(b) for a, b in zip(whole, columns[:, row], strict=True))) for row in alive)
    scored = sorted((-min(_LONG.max, max(_LONG.min, p)), row) for row, p in products)[:k]
    return [(row, -score) for score, row in scored]
