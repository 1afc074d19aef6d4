"""Battery cell jobs: features, labels, metrics, validity, serviceability, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packlens.functions.numeric import stress_features
from packlens.sources.cells import RAW_INPUTS

# The column order a trained model reads.
FEATURES = (*RAW_INPUTS, "equivalent_full_cycles", "temperature_stress", "calendar_stress")


def with_features(cells: DataFrame, *keep: str) -> DataFrame:
    """The feature columns, in model order and all doubles, next to the columns to keep.

    Training and scoring both use this projection.
    """
    derived = stress_features()
    ordered = [derived.get(name, F.col(name)).cast("double").alias(name) for name in FEATURES]
    return cells.select(*keep, *ordered)


def regression_metrics(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 in one pass. Of a constant truth, R2 is 1 if it is met exactly, else 0."""
    error = F.col(truth) - F.col(predicted)
    spread = F.var_pop(truth) * F.count(truth)
    missed = F.sum(error * error)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread == 0, F.when(missed == 0, 1.0).otherwise(0.0)).otherwise(F.lit(1.0) - missed / spread).alias("r2"),
    )


def reasons(*checks: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks]), lambda r: r.isNotNull())


def score_request_problems() -> Column:
    """Fields that are missing, no number, or out of range: all five are required."""

    def fails(name: str, holds: Column | None = None) -> tuple[str, Column]:
        known = F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
        return name, ~F.coalesce(known if holds is None else known & holds, F.lit(False))

    return reasons(
        fails("cycle_count", F.col("cycle_count") >= 0),
        fails("avg_temperature_c"),
        fails("avg_dod", F.col("avg_dod").between(0, 1)),
        fails("avg_c_rate", F.col("avg_c_rate") >= 0),
        fails("calendar_age_days", F.col("calendar_age_days") >= 0),
    )


def question_problems(text: str, k: str) -> Column:
    """A question needs a text and a k from 1 to 20; null fails both."""
    return reasons(
        ("question", ~F.coalesce(F.length(text) >= 1, F.lit(False))), ("k", ~F.coalesce(F.col(k).between(1, 20), F.lit(False)))
    )


def serviceability(scored: DataFrame, limits: DataFrame, on: str) -> DataFrame:
    """Keep or retire each cell by the end-of-life limit documented for its site.

    Cells of a site without a limit stay, with a null margin and decision.
    """
    margin = F.col("predicted_soh") - F.col("eol_threshold")
    return scored.join(limits, on, "left").withColumns(
        {"margin": margin, "retire": F.col("predicted_soh") < F.col("eol_threshold")}
    )


def latest_versions(registry: DataFrame) -> DataFrame:
    """Newest version of each model: versions are text, compared as whole numbers."""
    number = F.col("version").cast("bigint")
    return registry.groupBy("model").agg(
        F.max_by("version", number).alias("version"),
        F.max_by("run_id", number).alias("run_id"),
        F.count(F.lit(1)).alias("n_versions"),
    )


def split_train_test(cells: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Mark test rows by a hash of the key: repeatable on any partitioning, without a shuffle."""
    buckets = 1000
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))
    return cells.withColumn("is_test", bucket < int(round(share * buckets)))


def row_count(spark, name: str) -> int:
    """Rows of a catalog table, 0 where it does not exist."""
    return spark.table(name).count() if spark.catalog.tableExists(name) else 0
