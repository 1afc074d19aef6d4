"""Access-log summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from packlens.functions.windows import interpolated, placed_counts
from packlens.sources.sinks import staged


def access_counts(log: DataFrame, period: str) -> DataFrame:
    """Requests and server errors per (endpoint, period, latency): the log, pre-aggregated.

    Latencies are logged to a fixed number of places, so this is small next to the log.
    """
    return log.groupBy("endpoint", period, "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 500).alias("n_errors")
    )


def access_rollup(counts: DataFrame, period: str) -> DataFrame:
    """Requests, errors and exact latency figures per endpoint and period."""
    keys = ["endpoint", period]
    placed = placed_counts(staged(counts, "latency-counts"), keys, "duration_ms", ["n", "n_errors"])
    total = F.col("total_n")
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n_requests"),
        F.sum("n_errors").alias("n_errors"),
        (F.sum(F.col("duration_ms") * F.col("n")) / F.sum("n")).alias("mean_ms"),
        interpolated((total - 1) * 0.5 + 1, "duration_ms", "n").alias("p50_ms"),
        interpolated((total - 1) * 0.95 + 1, "duration_ms", "n").alias("p95_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


SESSION_SLICE = "1 day"


def caller_sessions(log: DataFrame, gap: str = "30 minutes", slice_width: str = SESSION_SLICE) -> DataFrame:
    """(caller, session_start, session_end, n_requests, n_errors, total_ms): runs of a caller's requests with no
    pause longer than ``gap``; a session ends ``gap`` after its last request.

    A caller's log is cut into time slices. Sessions are found within each slice; then one row per slice tells
    whether its first session goes on from the slice before, and since when. So a caller with any share of the log
    is spread over its slices. Requests without a time belong to no session; a null caller is a caller.
    """
    length = F.expr(f"interval {gap}")
    rows = log.where(F.col("ts").isNotNull()).withColumn("_slice", F.window("ts", slice_width)["start"])
    within = Window.partitionBy("caller", "_slice").orderBy("ts")
    opens = F.lag("ts").over(within).isNull() | (F.col("ts") > F.lag("ts").over(within) + length)
    local = (
        rows.withColumn("_opens", opens.cast("int"))
        .withColumn("_number", F.sum("_opens").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("caller", "_slice", "_number")
        .agg(
            F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("n_requests"),
            F.count_if(F.col("status_code") >= 500).alias("n_errors"), F.sum("duration_ms").alias("total_ms"),
        )
    )
    local = staged(local, "slice-sessions")
    slices = local.groupBy("caller", "_slice").agg(
        F.min("_first").alias("_from"), F.max("_last").alias("_to"), F.max("_first").alias("_newest"), F.max("_number").alias("_sessions")
    )
    ordered = Window.partitionBy("caller").orderBy("_slice")
    before = F.lag("_to").over(ordered)
    apart = before.isNull() | (F.col("_from") > before + length)
    # The start of a slice's last session, where it lies in the slice; a slice of one session that goes on has none.
    starts = F.when(F.col("_apart") | (F.col("_sessions") > 1), F.col("_newest"))
    carried = F.last(starts, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    joined = slices.withColumn("_apart", apart).withColumn("_carried", carried).where("not _apart").select("caller", "_slice", F.lit(1).alias("_number"), "_carried")
    renamed = joined.withColumnsRenamed({c: f"_of{c}" for c in ("caller", "_slice", "_number")})
    same: Column = F.lit(True)
    for c in ("caller", "_slice", "_number"):
        same = same & local[c].eqNullSafe(renamed[f"_of{c}"])
    return (
        local.join(renamed, same, "left")
        .groupBy("caller", F.coalesce("_carried", "_first").alias("session_start"))
        .agg((F.max("_last") + length).alias("session_end"), *[F.sum(c).alias(c) for c in ("n_requests", "n_errors", "total_ms")])
    )
