"""Evaluation roll-ups and the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from packlens.functions.numeric import mean_or_zero, ratio
from packlens.settings import JUDGED_METRICS, MIN_COVERAGE


def chunk_recall(items: DataFrame, expected: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """Share of each item's expected chunks found among its retrieved ones; 1 when none expected.

    Found means one retrieved chunk whose source ends with the expected one and which holds
    all required texts, whatever the case.
    """
    lowered = F.lower(F.col("r.text"))
    holds = F.endswith(F.col("r.source"), F.col("e.source")) & F.forall(
        F.col("e.must_contain"), lambda m: F.contains(lowered, F.lower(m))
    )
    pairs = expected.alias("e").join(retrieved.alias("r"), F.col(f"e.{key}") == F.col(f"r.{key}"), "left")
    found = pairs.groupBy(F.col(f"e.{key}").alias(key), F.col("e.position").alias("position")).agg(
        F.coalesce(F.bool_or(holds), F.lit(False)).alias("found")
    )
    share = found.groupBy(key).agg(F.avg(F.col("found").cast("int")).alias("recall"))
    return items.select(key).join(share, key, "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def rotten_truth(expected: DataFrame, corpus: DataFrame) -> DataFrame:
    """Expected texts that their source no longer holds, or whose source is gone.

    ``must_contain`` is a list of texts, all required, whatever their case; an empty list or an
    empty text in it is a fault of its own. Only the sources that are named are shuffled.
    """
    named = expected.select("source").distinct()
    texts = corpus.join(named, "source", "left_semi").select("source", F.lower("text").alias("_text"))
    wanted = F.col("must_contain")
    usable = F.coalesce((F.size(wanted) > 0) & F.forall(wanted, lambda m: F.coalesce(m != "", F.lit(False))), F.lit(False))
    held = F.forall(wanted, lambda m: F.contains(F.col("_text"), F.lower(m)))
    checked = expected.join(texts, "source", "left").withColumn(
        "problem",
        F.when(~usable, F.lit("no text required"))
        .when(F.col("_text").isNull(), F.lit("unknown source"))
        .when(~held, F.lit("text not found")),
    )
    return checked.where(F.col("problem").isNotNull()).drop("_text")


def composition(items: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of checks on a golden set: sizes, edge categories, unique ids, consistent classes, required texts."""
    edges = ("vague", "out_of_scope", "insufficient_context")
    empty = ~F.coalesce((F.size("must_contain") > 0) & F.forall("must_contain", lambda m: m != ""), F.lit(False))
    n_expected = expected.groupBy("qid").agg(F.count(F.lit(1)).alias("n_expected"), F.count_if(empty).alias("n_empty"))
    full = items.join(n_expected, "qid", "left").withColumn("n_expected", F.coalesce("n_expected", F.lit(0)))
    grounded = F.col("category").isin("factual", "synthesis")
    counted = full.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if("answerable").alias("n_answerable"),
        F.count_if(~F.col("answerable")).alias("n_unanswerable"),
        F.count_distinct("category").alias("n_categories"),
        F.count_distinct(F.when(F.col("category").isin(*edges), F.col("category"))).alias("n_edge_categories"),
        F.coalesce(F.sum("n_empty"), F.lit(0)).alias("n_empty_required"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("n_repeated_ids"),
        F.count_if(F.col("answerable") != grounded).alias("n_class_mismatch"),
        F.count_if(F.col("answerable") != (F.col("n_expected") > 0)).alias("n_expected_mismatch"),
    )
    return counted.withColumns(
        {
            "large_enough": (F.col("n_items") >= 20) & (F.col("n_answerable") >= 15) & (F.col("n_unanswerable") >= 5),
            "edge_categories": F.col("n_edge_categories") == 3,
            "ids_unique": F.col("n_repeated_ids") == 0,
        }
    )


def scored_items(records: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) that count: judged values of answered items, zeros of refused ones.

    Only answerable items are scored. A refusal of an answerable item scores zero on every
    judged metric; a NaN or absent value is left out and lowers the coverage.
    """
    answerable = records.where("answerable").select(*keys, "refused")
    zeros = answerable.where("refused").select(
        *keys, F.explode(F.array(*[F.lit(m) for m in JUDGED_METRICS])).alias("metric"), F.lit(0.0).alias("value")
    )
    values = judged.where(
        F.col("metric").isin(*JUDGED_METRICS) & F.col("value").isNotNull() & ~F.isnan("value")
    )
    kept = values.join(answerable.where(~F.col("refused")), keys, "left_semi")
    return zeros.unionByName(kept.select(*keys, "metric", "value"))


def roll_up(records: DataFrame, scores: DataFrame) -> DataFrame:
    """Every metric's score, with the number of items a judged one covers, and the counts.

    Columns: metric, score, scored (null for unjudged metrics), n_items, n_answerable,
    n_unanswerable, n_provider_errors. Reasons count as in the refusal rules: an unreadable
    output is no correct refusal; items that reached no model say nothing on validity.
    """
    facts = records.select(
        F.lit(True).alias("is_item"), "answerable", "refused", F.coalesce("refusal_reason", F.lit("")).alias("reason"), "recall"
    )
    values = scores.select("metric", "value")
    # Both tables shrink to the same single row, so one aggregation serves them together.
    together = facts.unionByName(values, allowMissingColumns=True)
    item, answerable, reason = F.col("is_item"), F.col("answerable"), F.col("reason")
    correct = (F.col("refused") & (reason != "invalid_output")).cast("int")
    valid = (reason != "invalid_output").cast("int")
    judged = {m: F.when(F.col("metric") == m, F.col("value")) for m in JUDGED_METRICS}
    totals = together.agg(
        F.count_if(item).alias("n_items"),
        F.count_if(item & answerable).alias("n_answerable"),
        F.count_if(item & ~answerable).alias("n_unanswerable"),
        F.count_if(item & (reason == "provider_error")).alias("n_provider_errors"),
        mean_or_zero(F.when(answerable, F.col("recall"))).alias("retrieval_recall"),
        mean_or_zero(F.when(~answerable, correct)).alias("refusal_accuracy"),
        mean_or_zero(F.when(reason != "provider_error", valid)).alias("output_validity"),
        *[mean_or_zero(v).alias(m) for m, v in judged.items()],
        *[F.count(v).alias(f"scored_{m}") for m, v in judged.items()],
    )
    unjudged = ("retrieval_recall", "refusal_accuracy", "output_validity")
    lines = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(m).alias("score"),
            (F.col(f"scored_{m}") if m in judged else F.lit(None).cast("bigint")).alias("scored"),
        )
        for m in (*JUDGED_METRICS, *unjudged)
    ]
    counts = ("n_items", "n_answerable", "n_unanswerable", "n_provider_errors")
    return totals.select(F.explode(F.array(*lines)).alias("m"), *counts).select("m.*", *counts)


def gate_violations(scores: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates not met. A metric that is missing counts as 0 and fails."""
    joined = gates.join(scores.select("metric", "score"), "metric", "left")
    actual = F.coalesce("score", F.lit(0.0))
    return joined.where(actual < F.col("threshold")).select(
        "metric", actual.alias("actual"), "threshold", F.lit("score").alias("kind")
    )


def coverage_violations(scores: DataFrame, minimum: float = MIN_COVERAGE) -> DataFrame:
    """Judged metrics that scored too small a share of the answerable items."""
    share = ratio(F.col("scored"), F.col("n_answerable"))
    judged = scores.where(F.col("scored").isNotNull() & (F.col("n_answerable") > 0))
    return judged.where(share < minimum).select(
        "metric", share.alias("actual"), F.lit(minimum).alias("threshold"), F.lit("coverage").alias("kind")
    )


def release_gate(scores: DataFrame, gates: DataFrame) -> DataFrame:
    """All violations; no rows means the gate passes."""
    return gate_violations(scores, gates).unionByName(coverage_violations(scores))


def report_gate(report: DataFrame | None, gates: DataFrame) -> DataFrame:
    """Violations of a report read from a file; a missing file fails as such."""
    if report is None:
        return gates.sparkSession.createDataFrame(
            [("report", 0.0, 1.0, "missing")], "metric string, actual double, threshold double, kind string"
        )
    scores = report.select(F.explode("scores").alias("metric", "score"))
    covered = report.select("n_answerable", F.explode("coverage").alias("metric", "scored"))
    return gate_violations(scores, gates).unionByName(coverage_violations(covered))


def published_scores(records: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per item what is published: judged values, and recall or whether it was refused.

    Here any refusal of an unanswerable item counts, unlike in the roll-up.
    """
    own = records.select(
        *keys,
        F.when(F.col("answerable"), F.lit("retrieval_recall")).otherwise(F.lit("refused_correctly")).alias("metric"),
        F.when(F.col("answerable"), F.col("recall")).otherwise(F.col("refused").cast("double")).alias("value"),
    )
    return scores.select(*keys, "metric", "value").unionByName(own)


def average_precision(ranked: DataFrame, key: str) -> DataFrame:
    """Rank-aware precision of each query's at most k results: (key, rank, relevant) rows."""
    upto = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = F.sum(F.col("relevant").cast("int")).over(upto)
    placed = ranked.withColumn("_precision", F.when(F.col("relevant"), hits / F.col("rank")))
    return placed.groupBy(key).agg(mean_or_zero(F.col("_precision")).alias("context_precision"))
