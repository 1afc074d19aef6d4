"""Writers. Everything staged goes below the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from packlens.session import staging_path


def replace_table(spark: SparkSession, rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Overwrite the table at ``path`` (a fresh one below the shared folder by default)."""
    path = path or staging_path(spark, name)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: computed once, however often it is read."""
    return replace_table(rows.sparkSession, rows, name)


def replace_counted(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Overwrite the table at ``path`` and return the rows written, counted on the way."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return int(seen.get["n"])


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def log_id(key: Column, version: str, batch: str) -> Column:
    """A positive id that the request, the model version and the batch fix: 60 bits of their digest."""
    name = F.concat_ws("|", key.cast("string"), F.lit(version), F.lit(batch))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def prediction_log(scored: DataFrame, version: str | None = None, *keep: str, key: str | None = None, batch: str = "") -> DataFrame:
    """Scored requests in the log's shape: an id, doubles, the model version as text, a time of writing.

    With ``key``, the column that names a request, ids are the same whenever a task or batch runs again. Without
    one they are drawn at random from 2^63 numbers, so that jobs that append side by side need no common counter.
    """
    drawn = F.abs(F.xxhash64(F.uuid())) if key is None else log_id(F.col(key), version or "unknown", batch)
    inputs = ("cycle_count", "avg_temperature_c", "avg_dod", "avg_c_rate", "calendar_age_days")
    return scored.select(
        drawn.alias("id"),
        F.current_timestamp().alias("created_at"),
        *[F.col(c).cast("double").alias(c) for c in inputs],
        F.col("predicted_soh").cast("double").alias("predicted_soh"),
        F.lit(version or "unknown").alias("model_version"),
        *keep,
    )


def commit_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Store the rows of one batch of a log in the batch's own folder, which a second run replaces.

    So a batch is in the log once, however often it ran; other batches are not touched.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of batches, each id once: the same request in two batches has two ids."""
    return spark.read.option("basePath", path).parquet(path).dropDuplicates(["id"])


def write_report(report: DataFrame, path: str) -> None:
    """A (nested) report as JSON lines."""
    report.write.mode("overwrite").json(path)


def as_json(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Each row as one JSON string; characters outside ASCII are kept as they are."""
    return rows.select(F.to_json(F.struct("*")).alias(column))
