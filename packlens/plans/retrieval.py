"""Vector retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.operators import retrieval as ops
from packlens.plans.oracle_views import with_views
from packlens.settings import MIN_RELEVANCE, SELF_RETRIEVAL_FLOOR, TOP_K
from packlens.sources import passages as views


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return ops.nearest(views.vector_queries(spark, folder), views.vectors(spark, folder))


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 4).alias("relevance")
    )


def indexed_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of ``vector_topk`` through the index of pivots, whatever the sizes."""
    queries, vectors = views.vector_queries(spark, folder), views.vectors(spark, folder)
    return ops.nearest(queries, vectors, broadcast_bytes=-1).select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 4).alias("relevance")
    )


def retrieval_floor(spark: SparkSession, folder: str) -> DataFrame:
    scored = ops.candidate_scores(_hits(spark, folder))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        "qid",
        F.size("scores").cast("bigint").alias("n_candidates"),
        "n_kept",
        F.round(total, 6).alias("score_sum"),
        F.element_at("scores", 1).alias("best"),
    )


def context_block(spark: SparkSession, folder: str) -> DataFrame:
    kept = ops.above_floor(_hits(spark, folder))
    blocks = ops.context_block(kept.join(views.passages(spark, folder), "chunk_id"))
    return blocks.select("qid", F.length("context").cast("bigint").alias("n_chars"), F.md5("context").alias("digest"))


def index_self_check(spark: SparkSession, folder: str) -> DataFrame:
    # The index holds only the chunks that were written; the rest retrieve nothing.
    chunks = views.passages(spark, folder)
    queries = views.vectors(spark, folder).withColumnRenamed("chunk_id", "qid")
    checked = ops.self_retrieval(chunks, queries, views.corrupt_vectors(spark, folder))
    return checked.select(
        "chunk_id", "best_id", F.round("score", 4).alias("score"), F.coalesce("problem", F.lit("sound")).alias("verdict")
    )


def _top1(spark: SparkSession, folder: str) -> DataFrame:
    queries = views.vector_queries(spark, folder)
    best = ops.nearest(queries, views.vectors(spark, folder), k=1)
    return queries.select("qid", "answerable").join(best, "qid", "left").select(
        "answerable", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("relevance")
    )


def relevance_calibration(spark: SparkSession, folder: str) -> DataFrame:
    summary = ops.relevance_summary(_top1(spark, folder))
    return summary.select("answerable", "n", *[F.round(c, 5).alias(c) for c in ("min", "p25", "median", "max")])


def relevance_separability(spark: SparkSession, folder: str) -> DataFrame:
    apart = ops.separability(_top1(spark, folder))
    return apart.withColumn("suggested_floor", F.coalesce(F.round("suggested_floor", 4), F.lit(-1.0)))


QUERIES = {
    "vector_topk": vector_topk,
    "indexed_topk": indexed_topk,
    "retrieval_floor": retrieval_floor,
    "context_block": context_block,
    "index_self_check": index_self_check,
    "relevance_calibration": relevance_calibration,
    "relevance_separability": relevance_separability,
}

_TOP1 = """top1 AS (SELECT answerable, round(coalesce(score,0),4) AS relevance
    FROM vector_queries LEFT JOIN (SELECT * FROM hits WHERE rank = 1) USING (qid))"""

_TOPK = with_views(
    ["vector_queries", "hits"],
    f"SELECT qid, rank, chunk_id, round(score,4) AS relevance FROM hits WHERE rank <= {TOP_K}",
)

ORACLES = {
    "vector_topk": _TOPK,
    "indexed_topk": _TOPK,
    "retrieval_floor": with_views(
        ["vector_queries", "hits"],
        f"""SELECT qid, count(*) AS n_candidates, count(*) FILTER (WHERE score >= {MIN_RELEVANCE}) AS n_kept,
          round(sum(round(score,4)),6) AS score_sum, max(round(score,4)) AS best
        FROM hits WHERE rank <= {TOP_K} GROUP BY qid""",
    ),
    "context_block": with_views(
        ["vector_queries", "hits", "passages"],
        f"""n AS (SELECT qid, rank, source, text, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i
          FROM hits JOIN passages USING (chunk_id) WHERE rank <= {TOP_K} AND score >= {MIN_RELEVANCE}),
        b AS (SELECT qid, string_agg('[' || i || '] (source: ' || source || ')' || chr(10) || text,
          chr(10) || chr(10) ORDER BY i) AS context FROM n GROUP BY qid)
        SELECT qid, length(context) AS n_chars, md5(context) AS digest FROM b""",
    ),
    "index_self_check": with_views(
        ["corrupt_vectors", "passages"],
        f"""s AS (SELECT q.vec_id AS qid, v.chunk_id,
            round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]),0),10) AS score
          FROM embeddings q CROSS JOIN corrupt_vectors v),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) = 1)
        SELECT o.chunk_id, b.chunk_id AS best_id, round(score,4) AS score,
          CASE WHEN b.chunk_id IS NULL THEN 'retrieved nothing' WHEN o.text IS DISTINCT FROM w.text THEN 'outranked'
            WHEN score < {SELF_RETRIEVAL_FLOOR} THEN 'weak' ELSE 'sound' END AS verdict
        FROM passages o LEFT JOIN b ON b.qid = o.chunk_id LEFT JOIN passages w ON w.chunk_id = b.chunk_id""",
    ),
    "relevance_calibration": with_views(
        ["vector_queries", "hits"],
        f"""{_TOP1},
        r AS (SELECT answerable, relevance, row_number() OVER (PARTITION BY answerable ORDER BY relevance) AS i,
          count(*) OVER (PARTITION BY answerable) AS n FROM top1),
        e AS (SELECT answerable, max(n) AS n, min(relevance) AS min, max(relevance) AS max, median(relevance) AS median,
          max(relevance) FILTER (WHERE i = floor((n+1)/4e0)) AS lo, max(relevance) FILTER (WHERE i = floor((n+1)/4e0)+1) AS hi
          FROM r GROUP BY answerable)
        SELECT answerable, n, round(min,5) AS min, round(lo+(hi-lo)*((n+1)/4e0-floor((n+1)/4e0)),5) AS p25,
          round(median,5) AS median, round(max,5) AS max FROM e""",
    ),
    "relevance_separability": with_views(
        ["vector_queries", "hits"],
        f"""{_TOP1},
        e AS (SELECT max(relevance) FILTER (WHERE NOT answerable) AS unanswerable_max,
          min(relevance) FILTER (WHERE answerable) AS answerable_min FROM top1)
        SELECT *, unanswerable_max < answerable_min AS separable, CASE WHEN unanswerable_max < answerable_min
          THEN round((unanswerable_max+answerable_min)/2,4) ELSE -1 END AS suggested_floor FROM e""",
    ),
}
