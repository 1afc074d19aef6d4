"""Exact vector search through an index of pivots.

Stored vectors are grouped around sampled centres, each vector at its nearest one. By the triangle
inequality of angles a vector at angle a from a centre is at least ``|a - b|`` from a query at angle b,
so a group whose angles all lie too far from b holds none of the query's best. A vector also lies on its own
centre's side of the plane midway between that and any other centre, so it is as far from a query on the other
side as the plane is at least. A query first looks into
one bin of its nearest group, which gives a score to reach, and then only into those bins that may
still reach it; inside a bin, the same bounds are applied to short runs of vectors ordered by angle. A query
that finds itself thus looks into one group, about, whatever the number of vectors.

Groups are packed into bins of bounded bytes; a group beyond a bin, such as thousands of copies of one
vector, is sliced over many. The queries that look into one bin are cut into blocks of bounded bytes.
Centres and the facts of their groups are all that the driver holds: at most ``MOST_CENTRES`` of them,
and no more bytes of centres than may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from packlens.functions.vectors import improve, unit
from packlens.settings import BLOCK_BYTES, BROADCAST_BYTES
from packlens.sources.sinks import staged

MOST_CENTRES = 1024
# Vectors looked at for each centre that is chosen.
SAMPLED = 4
# A bin holds as many rows at least, so that a first look finds k of them.
LEAST_ROWS = 32
RUN = 256
QUERY_ROWS = 1024
RAW_SCHEMA = "qid long, chunk_id long, score double, compared long"
# Angles near zero are exact to about 1e-8; scores are compared at ten places.
ANGLE_SLACK = 1e-6
SCORE_SLACK = 1e-9
NO_FLOOR = -2.0


class Pivots(NamedTuple):
    """Centres, then for each group least and largest angle, first bin and number of bins.

    The group after those of the centres holds the vectors without a direction.
    """

    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    bins: np.ndarray


class Index(NamedTuple):
    """Stored vectors with group, angle and bin, and what they are grouped around."""

    rows: DataFrame
    pivots: Pivots
    block_bytes: int


def _cosines(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(vectors) or not len(centres):
        return np.zeros((len(vectors), len(centres)))
    return np.clip(vectors @ centres.T, -1.0, 1.0)


def _far_apart(units: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` of the vectors, each the one farthest from those before it; no two alike."""
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < wanted and nearest.min() < 1.0 - SCORE_SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def score_bound(angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest cosine with a query at ``angle`` from a centre of vectors at ``low`` to ``high`` from it."""
    return np.cos(np.maximum(np.maximum(low - angle, angle - high) - ANGLE_SLACK, 0.0))


def side_bound(cosines: np.ndarray, centres: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The largest cosine of each query with a vector of each of the groups, from the plane midway between their centres.

    ``cosines`` holds those of the queries with all centres, no two of which are alike.
    """
    if not cosines.size or not len(groups):
        return np.ones((len(cosines), len(groups)))
    home = cosines.argmax(axis=1)
    width = np.sqrt(np.maximum(2.0 - 2.0 * (centres @ centres[groups].T), SCORE_SLACK))[home]
    gap = np.take_along_axis(cosines, home[:, None], 1) - cosines[:, groups]
    return np.cos(np.maximum(np.arcsin(np.minimum(gap / width, 1.0)) - ANGLE_SLACK, 0.0))


def index(vectors: DataFrame, block_bytes: int = BLOCK_BYTES) -> Index:
    """The index of ``vectors`` (chunk_id, embedding); further columns are dropped."""
    spark = vectors.sparkSession
    source = vectors.select("chunk_id", "embedding")
    rows, width = source.agg(F.count("*"), F.max(F.size("embedding"))).first()
    row_bytes = 8 * max(width or 0, 1)
    wanted = min(MOST_CENTRES, ceil(sqrt(rows)))
    most = max(1, min(SAMPLED * wanted, BROADCAST_BYTES // row_bytes))
    # The least hashed ids: a sample that any partitioning gives alike. A zero vector, or one that holds no number, has no direction.
    pointing = source.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: F.abs(x) < float("inf")))
    sample = pointing.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("embedding").limit(most).collect()
    centres = _far_apart(unit([r[0] for r in sample]), wanted) if sample else np.zeros((0, width or 0))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            group, angle = np.full(len(batch), len(centres)), np.zeros(len(batch))
            for start in range(0, len(batch) if len(centres) else 0, QUERY_ROWS):
                units = unit(batch["embedding"].iloc[start : start + QUERY_ROWS])
                cosines = units @ centres.T
                alive = units.any(axis=1) & np.isfinite(units).all(axis=1)
                part = slice(start, start + len(units))
                group[part] = np.where(alive, cosines.argmax(axis=1), len(centres))
                angle[part] = np.where(alive, np.arccos(np.clip(cosines.max(axis=1), -1.0, 1.0)), 0.0)
            yield batch.assign(grp=group.astype("int32"), angle=angle)

    kind = dict(source.dtypes)["embedding"]
    placed = staged(source.mapInPandas(place, f"chunk_id long, embedding {kind}, grp int, angle double"), "placed-vectors")
    facts = placed.groupBy("grp").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    known = _packed(centres, facts, max(LEAST_ROWS, block_bytes // row_bytes))
    table = [(g, int(known.first[g]), int(known.bins[g])) for g in range(len(known.bins)) if known.bins[g]]
    places = F.broadcast(spark.createDataFrame(table, "grp int, first long, bins long"))  # MOST_CENTRES + 1 rows at most
    binned = placed.join(places, "grp").withColumn("bin", F.col("first") + F.pmod(F.xxhash64("chunk_id"), "bins"))
    return Index(binned.drop("first", "bins"), known, block_bytes)


def _packed(centres: np.ndarray, facts: list, room: int) -> Pivots:
    """Groups of at most ``room`` rows share bins with their neighbours in number; larger ones get bins of their own."""
    groups = len(centres) + 1
    low, high = np.zeros(groups), np.zeros(groups)
    first, bins = np.zeros(groups, dtype=np.int64), np.zeros(groups, dtype=np.int64)
    at, used = 0, 0
    for row in sorted(facts, key=lambda r: r["grp"]):
        g, n = row["grp"], row["n"]
        low[g], high[g] = row["low"], row["high"]
        if used and used + n > room:
            at, used = at + 1, 0
        bins[g] = -(-n // room)
        first[g] = at
        used += n
        if bins[g] > 1:
            at, used = at + int(bins[g]), 0
    return Pivots(centres, low, high, first, bins)


def _group_bounds(known: Pivots, queries: np.ndarray) -> np.ndarray:
    """Bound of each query for each group, -inf for empty ones. A zero vector scores 0 with everything."""
    bounds = np.zeros((len(queries), len(known.bins)))
    cosines = _cosines(queries, known.centres)
    bounds[:, :-1] = np.minimum(score_bound(np.arccos(cosines), known.low[:-1], known.high[:-1]), side_bound(cosines, known.centres, np.arange(len(known.centres))))
    bounds[~queries.any(axis=1)] = 0.0
    bounds[:, known.bins == 0] = -np.inf
    return bounds


def _home(known: Pivots, qids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The bin in which each query looks first: one of the nearest group that is not empty."""
    near = np.full((len(queries), len(known.bins)), -1.0)
    near[:, :-1] = _cosines(queries, known.centres)
    near[:, known.bins == 0] = -np.inf
    group = near.argmax(axis=1)
    return known.first[group] + qids % known.bins[group]


def _routes(queries: DataFrame, found: Index, name: str, floor: bool) -> DataFrame:
    """(qid, embedding, floor, bins): the first bin of each query, or, with a floor known, all others worth a look."""
    shared = queries.sparkSession.sparkContext.broadcast(found.pivots)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            bins = []
            for start in range(0, len(batch), QUERY_ROWS):
                part = batch.iloc[start : start + QUERY_ROWS]
                units = unit(part["embedding"])
                home = _home(known, part["qid"].to_numpy(dtype=np.int64), units)
                if not floor:
                    bins += [[b] for b in home]
                    continue
                worth = _group_bounds(known, units) + SCORE_SLACK >= part["floor"].to_numpy()[:, None]
                for own, row in zip(home, worth, strict=True):
                    groups = np.flatnonzero(row)
                    spans = [np.arange(known.first[g], known.first[g] + known.bins[g]) for g in groups]
                    every = np.unique(np.concatenate(spans)) if spans else np.zeros(0, dtype=np.int64)
                    bins.append(every[every != own])
            yield batch.assign(bins=bins)

    kind = dict(queries.dtypes)["embedding"]
    return staged(queries.mapInPandas(route, f"qid long, embedding {kind}, floor double, bins array<long>"), name)


def _look(routes: DataFrame, found: Index, k: int) -> DataFrame:
    """k best per query and bin that reach the query's floor, and one row per task with the pairs compared."""
    width = routes.agg(F.max(F.size("embedding"))).first()[0] or 1
    room = max(1, found.block_bytes // (8 * width))
    asked = routes.select("qid", "embedding", "floor", F.explode("bins").alias("bin"))
    # One row per bin: a bin's vectors go only where a block of its queries waits for them. Few bins are cut for all cores.
    counts = staged(asked.groupBy("bin").agg(F.count("*").alias("n")), "waiting-counts")
    each = (counts.agg(F.sum("n")).first()[0] or 0) / routes.sparkSession.sparkContext.defaultParallelism
    room = float(min(room, max(each, LEAST_ROWS)))
    waiting = counts.select("bin", F.ceil(F.col("n") / F.lit(room)).alias("blocks"))
    block = F.pmod(F.xxhash64("qid"), "blocks").alias("block")
    left = asked.join(waiting, "bin").select("bin", block, "qid", "embedding", "floor")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    right = found.rows.join(waiting, "bin").select("bin", every, "chunk_id", "embedding", "grp", "angle")
    shared = routes.sparkSession.sparkContext.broadcast(found.pivots.centres)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        centres = shared.value
        out, compared = [], 0
        if len(left) and len(right):
            runs = _runs(right)
            for start in range(0, len(left), QUERY_ROWS):
                part, pairs = _look_in(left.iloc[start : start + QUERY_ROWS], runs, centres, k)
                out.append(part)
                compared += pairs
        out.append(pd.DataFrame({"qid": [None], "chunk_id": [None], "score": [None], "compared": [compared]}))
        return pd.concat([frame.astype({"qid": "Int64", "chunk_id": "Int64", "score": "Float64", "compared": "Int64"}) for frame in out])

    # A number of its own keeps the adaptive plan from joining these few rows with much work into one task.
    tasks = int(routes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(tasks, "bin", "block").groupBy("bin", "block") for side in (left, right))
    return left.cogroup(right).applyInPandas(meet, RAW_SCHEMA)


def _runs(stored: pd.DataFrame) -> list[tuple[int, float, float, np.ndarray, np.ndarray]]:
    """Group, least and largest angle, ids in order and units of each run of vectors at like angles."""
    stored = stored.sort_values(["grp", "angle", "chunk_id"], kind="stable")
    runs = []
    for group, rows in stored.groupby("grp"):
        for start in range(0, len(rows), RUN):
            run = rows.iloc[start : start + RUN]
            ends = float(run["angle"].iloc[0]), float(run["angle"].iloc[-1])
            run = run.sort_values("chunk_id", kind="stable")
            runs.append((int(group), *ends, run["chunk_id"].to_numpy(dtype=np.int64), unit(run["embedding"])))
    return runs


def _look_in(asked: pd.DataFrame, runs: list, centres: np.ndarray, k: int) -> tuple[pd.DataFrame, int]:
    qids, floor = asked["qid"].to_numpy(dtype=np.int64), asked["floor"].to_numpy(dtype=np.float64)
    queries = unit(asked["embedding"])
    single = queries.astype(np.float32)
    groups = np.array([r[0] for r in runs])
    pointing = groups < len(centres)
    bounds = np.zeros((len(queries), len(runs)))
    names, place = np.unique(groups[pointing], return_inverse=True)
    cosines = _cosines(queries, centres)
    angles = np.arccos(cosines[:, names])[:, place]
    band = score_bound(angles, np.array([r[1] for r in runs])[pointing], np.array([r[2] for r in runs])[pointing])
    bounds[:, pointing] = np.minimum(band, side_bound(cosines, centres, names)[:, place])
    bounds[~queries.any(axis=1)] = 0.0
    scores = np.full((len(queries), k), -np.inf)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    compared = 0
    # Each query's likeliest run comes first, so that it has a score to reach before it meets the others.
    likeliest = bounds.argmax(axis=1)
    for near, r in [(True, r) for r in np.unique(likeliest)] + [(False, r) for r in range(len(runs))]:
        _, _, _, run_ids, units = runs[r]
        reach = np.maximum(floor, scores[:, k - 1]) - SCORE_SLACK
        open_ = np.flatnonzero(((likeliest == r) == near) & (bounds[:, r] >= reach))
        if not len(open_):
            continue
        compared += len(open_) * len(run_ids)
        better, their = scores[open_], ids[open_]
        improve(better, their, queries[open_], single[open_], units, run_ids, floor[open_])
        scores[open_], ids[open_] = better, their
    rows, columns = np.nonzero((scores > -np.inf) & (scores >= floor[:, None]))
    found = {"qid": qids[rows], "chunk_id": ids[rows, columns], "score": scores[rows, columns]}
    return pd.DataFrame(found).assign(compared=0), compared


def search(queries: DataFrame, found: Index, k: int) -> DataFrame:
    """Best k of each query among the bins it looked into, k at most for each bin; see ``hits`` and ``pairs_compared``.

    ``queries`` holds (qid, embedding). Every vector that belongs to the k best is among the rows.
    """
    plain = queries.select("qid", "embedding")
    if not found.pivots.bins.any():
        return queries.sparkSession.createDataFrame([], RAW_SCHEMA)
    first = staged(_look(_routes(plain.withColumn("floor", F.lit(NO_FLOOR)), found, "first-bins", False), found, k), "first-look")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    reached = hits(first).withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select("qid", F.col("score").alias("floor"))
    known = plain.join(reached, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
    return first.unionByName(_look(_routes(known, found, "further-bins", True), found, k))


def hits(looked: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) of what ``search`` found."""
    return looked.where(F.col("qid").isNotNull()).select("qid", "chunk_id", "score")


def pairs_compared(looked: DataFrame) -> int:
    """How many pairs of query and vector were multiplied in full."""
    return looked.where(F.col("qid").isNull()).agg(F.sum("compared")).first()[0] or 0
