"""Exact vector retrieval: every query against every stored vector, k best kept.

Only k rows per query leave a task; the full score matrix never becomes rows. The smaller side is
broadcast if its size, which is checked, allows: queries over the vectors in place, or vectors over the
queries, each of which is then done in one task. Larger sides go through the index of
``pivots``, which leaves out what the triangle bound rules out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from packlens.functions.vectors import HIT_SCHEMA, running_best, unit
from packlens.functions.windows import interpolated, placed_counts
from packlens.operators import pivots
from packlens.settings import (
    BLOCK_BYTES,
    BROADCAST_BYTES,
    MIN_RELEVANCE,
    SELF_BROADCAST_BYTES,
    SELF_RETRIEVAL_FLOOR,
    TOP_K,
)
from packlens.sources.sinks import staged

# Vectors, and queries of a task, that meet at once.
STEP = 4096


def _blocks(ids: np.ndarray, vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most ``STEP`` vectors as (ids ascending, units)."""
    for i in range(0, len(ids), STEP):
        order = np.argsort(ids[i : i + STEP], kind="stable")
        yield ids[i : i + STEP][order], unit(vectors[i : i + STEP])[order]


def _matrix(rows: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and unit vectors of a side small enough to be broadcast, as two arrays."""
    known = rows.select(key, "embedding").toPandas().sort_values(key, kind="stable", ignore_index=True)
    ids = known[key].to_numpy(dtype=np.int64)
    return ids, unit(known["embedding"]) if len(ids) else np.zeros((0, 0))


def _scan(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Local best k of each partition of the vectors, the query matrix being broadcast."""
    qids, matrix = _matrix(queries, "qid")
    if not len(qids):
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA)
    shared = queries.sparkSession.sparkContext.broadcast((qids, matrix))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, matrix = shared.value
        blocks = (b for batch in batches for b in _blocks(batch["chunk_id"].to_numpy(dtype=np.int64), batch["embedding"].to_numpy()))
        yield running_best(qids, matrix, blocks, k)

    return vectors.select("chunk_id", "embedding").mapInPandas(scan, HIT_SCHEMA)


def _scan_queries(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Best k of each query among all vectors, which are broadcast: a query's rows come from one task."""
    shared = queries.sparkSession.sparkContext.broadcast(_matrix(vectors, "chunk_id"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, units = shared.value
        for batch in batches:
            for i in range(0, len(batch), STEP):
                asked = batch.iloc[i : i + STEP]
                blocks = ((ids[j : j + STEP], units[j : j + STEP]) for j in range(0, len(ids), STEP))
                yield running_best(asked["qid"].to_numpy(dtype=np.int64), unit(asked["embedding"]), blocks, k)

    return queries.select("qid", "embedding").mapInPandas(scan, HIT_SCHEMA)


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact k nearest vectors of each query by cosine: (qid, chunk_id, score, rank).

    ``queries`` holds (qid, embedding), ``vectors`` (chunk_id, embedding). Ties go to the
    smaller chunk id; rank is the citation number.
    """
    size = F.sum(F.size("embedding").cast("bigint") * 8)
    query_bytes = queries.agg(size.alias("b")).first()["b"] or 0
    vector_bytes = vectors.agg(size.alias("b")).first()["b"] or 0
    if vector_bytes <= min(query_bytes, broadcast_bytes):
        # Few queries are dealt over the cores; many have partitions enough.
        cores = queries.sparkSession.sparkContext.defaultParallelism
        hits = _scan_queries(queries.repartition(cores) if query_bytes <= broadcast_bytes else queries, vectors, k)
    elif query_bytes <= broadcast_bytes:
        hits = _scan(queries, vectors, k)
    else:
        hits = pivots.hits(pivots.search(queries, pivots.index(vectors, block_bytes), k))
    best_first = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def above_floor(hits: DataFrame, floor: float = MIN_RELEVANCE) -> DataFrame:
    """Candidates that clear the relevance floor, compared before rounding for display."""
    return hits.where(F.col("score") >= floor).withColumn("relevance", F.round("score", 4))


def candidate_scores(hits: DataFrame, floor: float = MIN_RELEVANCE) -> DataFrame:
    """Per query: all k candidate scores in rank order, and how many cleared the floor."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.round("score", 4).alias("relevance"))))
    return hits.groupBy("qid").agg(
        F.transform(ranked, lambda r: r["relevance"]).alias("scores"),
        F.count_if(F.col("score") >= floor).alias("n_kept"),
    )


def context_block(passages: DataFrame) -> DataFrame:
    """One numbered, source-tagged text per query from its at most k passages in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "source", "text")))
    numbered = F.transform(
        ordered,
        lambda p, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] (source: "), p["source"], F.lit(")\n"), p["text"]
        ),
    )
    return passages.groupBy("qid").agg(F.array_join(numbered, "\n\n").alias("context"))


def self_retrieval(chunks: DataFrame, queries: DataFrame, stored: DataFrame, floor: float = SELF_RETRIEVAL_FLOOR) -> DataFrame:
    """Does each chunk find itself by its own text? One problem per chunk, null when sound.

    ``chunks`` holds (chunk_id, text), ``queries`` the vectors of the texts as (qid, embedding)
    with qid = chunk_id, ``stored`` the vectors in the index. Identity is by text: an exact
    copy that wins is not a problem.
    """
    # Most vectors find themselves, which the index answers without comparing all with all.
    best = nearest(queries, stored, k=1, broadcast_bytes=SELF_BROADCAST_BYTES).select(
        F.col("qid").alias("chunk_id"), F.col("chunk_id").alias("best_id"), "score"
    )
    digest = F.sha2("text", 256)
    own = chunks.select("chunk_id", digest.alias("own_text"))
    other = chunks.select(F.col("chunk_id").alias("best_id"), digest.alias("best_text"))
    return (
        own.join(best, "chunk_id", "left")
        .join(other, "best_id", "left")
        .select(
            "chunk_id",
            "best_id",
            "score",
            F.when(F.col("best_id").isNull(), F.lit("retrieved nothing"))
            .when(~F.col("own_text").eqNullSafe(F.col("best_text")), F.lit("outranked"))
            .when(F.col("score") < floor, F.lit("weak"))
            .alias("problem"),
        )
    )


def relevance_summary(top1: DataFrame) -> DataFrame:
    """Top-1 relevance by class: n, min, first quartile, median, max.

    ``top1`` holds (answerable, relevance) with relevance rounded to 4 places, so the counts
    per score stay few. The quartile is the exclusive one, at (n + 1) / 4, and needs four values.
    """
    counts = top1.groupBy("answerable", "relevance").agg(F.count(F.lit(1)).alias("n"))
    placed = placed_counts(staged(counts, "relevance-counts"), ["answerable"], "relevance", ["n"])
    total = F.col("total_n")
    return placed.groupBy("answerable").agg(
        F.max(total).alias("n"),
        F.min("relevance").alias("min"),
        F.when(F.max(total) >= 4, interpolated((total + 1) / 4.0, "relevance", "n")).alias("p25"),
        interpolated((total + 1) / 2.0, "relevance", "n").alias("median"),
        F.max("relevance").alias("max"),
    )


def separability(top1: DataFrame) -> DataFrame:
    """Can one floor part the classes? Undefined where a class is empty."""
    ends = top1.agg(
        F.max(F.when(~F.col("answerable"), F.col("relevance"))).alias("unanswerable_max"),
        F.min(F.when(F.col("answerable"), F.col("relevance"))).alias("answerable_min"),
    )
    apart = F.col("unanswerable_max") < F.col("answerable_min")
    middle = (F.col("unanswerable_max") + F.col("answerable_min")) / 2.0
    return ends.withColumns({"separable": apart, "suggested_floor": F.when(apart, middle)})
