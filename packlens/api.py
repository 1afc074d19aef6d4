"""The five callable tools, over whole tables: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.operators import answers, drift, evalgate, forest, retrieval, screening
from packlens.settings import DRIFT_SHARE, MIN_RELEVANCE, RECENT_LIMIT, TOP_K
from packlens.sources import golden, sinks


def search_docs(
    queries: DataFrame, vectors: DataFrame, passages: DataFrame, k: int = TOP_K, floor: float = MIN_RELEVANCE
) -> DataFrame:
    """Passages above the relevance floor for each query, without answering.

    ``queries`` (qid, embedding), ``vectors`` (chunk_id, embedding), ``passages`` (chunk_id,
    source, text). Per query: the kept passages in rank order, and all k candidate scores.
    """
    hits = sinks.staged(retrieval.nearest(queries, vectors, k), "hits")
    kept = answers.gather_passages(retrieval.above_floor(hits, floor), passages)
    scores = retrieval.candidate_scores(hits, floor).select("qid", F.col("scores").alias("candidate_scores"))
    empty = F.array().cast("array<struct<rank:int,source:string,text:string,relevance:double>>")
    return (
        queries.select("qid")
        .join(scores, "qid", "left")
        .join(kept, "qid", "left")
        .select(
            "qid",
            F.coalesce("kept", empty).alias("passages"),
            F.coalesce("candidate_scores", F.array().cast("array<double>")).alias("candidate_scores"),
            F.lit(floor).alias("relevance_floor"),
        )
    )


def ask_docs(
    questions: DataFrame,
    vectors: DataFrame,
    passages: DataFrame,
    attempts: DataFrame,
    keys: list[str],
    k: int = TOP_K,
    hits: DataFrame | None = None,
) -> DataFrame:
    """The answer to each question from logged model attempts, with all checks applied.

    ``questions`` holds the keys, question, query_id and embedding; questions of one query_id
    share one search. ``attempts`` holds the keys and (attempt, raw, status_code,
    error_module). ``hits`` may bring the results of a search made before.
    """
    screened = screening.screen_questions(questions.drop("embedding"))
    # Staged: the verdicts pick the vectors to search for and are joined to what was found.
    screened = sinks.staged(screened, "screened")
    if hits is None:
        # Refused questions cost no retrieval.
        wanted = screened.where("allowed").select(F.col("query_id").alias("qid")).distinct()
        known = questions.where(F.col("embedding").isNotNull()).select(F.col("query_id").alias("qid"), "embedding")
        queries = known.dropDuplicates(["qid"]).join(wanted, "qid", "left_semi")
        hits = retrieval.nearest(queries, vectors, k)
    kept = answers.gather_passages(retrieval.above_floor(hits), passages)
    return answers.assemble(screened, kept, answers.resolve_outputs(attempts, keys), keys, "query_id")


def predict_soh(
    requests: DataFrame, model: forest.Forest, version: str | None = None, log: str | None = None,
    key: str | None = None, batch: str | None = None,
) -> DataFrame:
    """Predicted state of health per request; with ``log`` the rows are stored there as well.

    With ``key``, the column that names a request, and ``batch`` the rows are stored exactly once: a batch that runs
    again replaces its own rows, with the same ids. Without them rows are appended.
    """
    scored = forest.score(model, requests, *([key] if key else []))
    if log and key and batch:
        sinks.commit_batch(sinks.prediction_log(scored, version, key, key=key, batch=batch), log, batch)
        return sinks.read_log(requests.sparkSession, log).where(F.col("batch").cast("string") == batch).drop("batch")
    if log:
        logged = sinks.staged(sinks.prediction_log(scored, version), "predictions")
        sinks.append_rows(logged, log)
        return logged
    return sinks.prediction_log(scored, version)


def drift_report(
    reference: DataFrame, requests: DataFrame, limit: int | None = RECENT_LIMIT, share: float = DRIFT_SHARE
) -> DataFrame:
    """One row: did the newest requests drift from the training inputs?"""
    columns = drift.drift_between(reference, drift.recent(requests, limit))
    return drift.drift_summary(columns, share).drop("current_rows")


def eval_gate(spark: SparkSession, results: str) -> DataFrame:
    """Violations of the release gate in a report file; none means it passes."""
    return evalgate.report_gate(golden.read_report(spark, results), golden.gates(spark))
