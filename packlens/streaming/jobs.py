"""Structured Streaming forms of the batch jobs.

Each takes a streaming DataFrame and gives one back, or a started query. The batch functions
do the work; what is added here is the event time, the state and the sink.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from packlens.operators import drift, forest, ratelimit, screening
from packlens.sources.sinks import commit_batch, prediction_log, staged


def read_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder's table as a stream of its files. The schema is taken from the table."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # File names only match as a pattern: a stream takes folders or patterns, not one file.
    return reader.parquet(path + "*")


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there to parquet files, exactly once across restarts."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def screen(questions: DataFrame, text: str = "question") -> DataFrame:
    """Screening needs no state."""
    return screening.screen_questions(questions, text)


def score(requests: DataFrame, model: forest.Forest, version: str, path: str, checkpoint: str, *keep: str) -> StreamingQuery:
    """Store scored requests in the shape of the prediction log, next to the columns to keep; the first one names a request.

    A batch is scored as a table and stored in a folder of its own, which it replaces if it runs again.
    """

    def store(batch: DataFrame, number: int) -> None:
        scored = forest.score(model, batch, *keep)
        commit_batch(prediction_log(scored, version, *keep, key=keep[0] if keep else None, batch="stream"), path, str(number))

    return requests.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_rollup(log: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Requests and errors per endpoint and tumbling window.

    Rows later than ``lateness`` behind the newest are left out of closed windows; the limit
    is a choice of this job. Use update or complete mode to see windows still open.
    """
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("window"), "endpoint")
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.count_if(F.col("status_code") >= 500).alias("n_errors"),
            F.sum("duration_ms").alias("total_ms"),
        )
    )


#: Size of a latency sketch, and the share by which the rank of its quantiles may be off (99 of 100 sketches of that size).
SKETCH_SIZE, RANK_ERROR = 800, 0.01


def access_latency(log: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """A mergeable sketch of the latencies per endpoint and tumbling window, as the state of the stream.

    Its quantiles are off by ``RANK_ERROR`` of the rank at most; sketches of neighbouring windows merge.
    """
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("window"), "endpoint")
        .agg(F.count(F.lit(1)).alias("n_requests"), F.kll_sketch_agg_double("duration_ms", F.lit(SKETCH_SIZE)).alias("latencies"))
    )


def with_attempts(questions: DataFrame, attempts: DataFrame, keys: list[str], wait: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Each question with its model attempts, one row for each, as both arrive; a question to which none came in time
    comes out once without, when the watermark shows that none can come any more.

    ``questions`` has the keys and ``asked_at``, ``attempts`` the keys and ``tried_at``. Both sides stay in the state
    for ``wait`` and ``lateness`` only.
    """
    asked = questions.withWatermark("asked_at", lateness)
    tried = attempts.withColumnsRenamed({k: f"_of_{k}" for k in keys}).withWatermark("tried_at", lateness)
    same = (F.col("tried_at") >= F.col("asked_at")) & (F.col("tried_at") <= F.col("asked_at") + F.expr(f"interval {wait}"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return asked.join(tried, same, "leftOuter").drop(*[f"_of_{k}" for k in keys])


def caller_sessions(log: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Requests per caller and session; a session ends after ``gap`` without a request.

    In append mode a session comes out once, when the watermark has passed its end; sessions that are still
    open stay in the state.
    """
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("session"), "caller")
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.count_if(F.col("status_code") >= 500).alias("n_errors"),
            F.sum("duration_ms").alias("total_ms"),
        )
    )


def keep_value_counts(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Per-day value counts of the requests, one folder per batch.

    A batch that runs again overwrites its own folder, so nothing is counted twice. Drift is
    then computed from the counts with the batch function.
    """

    def store(batch: DataFrame, number: int) -> None:
        days = batch.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
        counts = drift.value_counts(days, "current", ["day"])
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        requests.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rate_limit_in_order(events: DataFrame, path: str, checkpoint: str, lateness_micros: int) -> StreamingQuery:
    """Verdicts in the order of the requests' times, however they arrive, in folders below ``path``.

    Requests are held until one came that is ``lateness_micros`` later, then replayed with the time slices of the batch
    form: a caller with any share of a batch is cut into slices. A request that comes later still counts as made at
    its caller's last one. Each batch keeps what it holds and the buckets in folders of its own, made from those of
    the batch before, so a batch that runs again changes nothing. ``close_in_order`` decides on what is held at the end.
    """
    schema = events.schema

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting, buckets = _held(spark, path, number - 1, schema)
        rows = staged(waiting.unionByName(batch.select(waiting.columns)), "arrived")
        newest = rows.agg(F.max("at_micros")).first()[0]
        ready = F.coalesce(F.col("at_micros") <= F.lit((newest or 0) - lateness_micros), F.lit(True))
        _decide(rows.where(ready), rows.where(~ready), buckets, path, number)

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close_in_order(spark: SparkSession, path: str, last_batch: int, schema: StructType) -> DataFrame:
    """Decides on the requests still held after ``last_batch``, as the batch that follows; all verdicts of the feed."""
    waiting, buckets = _held(spark, path, last_batch, schema)
    _decide(waiting, waiting.limit(0), buckets, path, last_batch + 1)
    return spark.read.option("basePath", f"{path}/verdicts").parquet(f"{path}/verdicts").drop("batch")


def _held(spark: SparkSession, path: str, number: int, schema: StructType) -> tuple[DataFrame, DataFrame]:
    if number < 0:
        return spark.createDataFrame([], schema), spark.createDataFrame([], ratelimit.BUCKETS)
    return spark.read.schema(schema).parquet(f"{path}/waiting/batch={number}"), spark.read.schema(ratelimit.BUCKETS).parquet(f"{path}/buckets/batch={number}")


def _decide(ready: DataFrame, waiting: DataFrame, buckets: DataFrame, path: str, number: int) -> None:
    verdicts, after = ratelimit.replay_from(ready, buckets)
    for name, rows in (("verdicts", verdicts), ("buckets", after), ("waiting", waiting)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


BUCKET_STATE = "tokens long, at_micros long"
VERDICTS = "event_id long, scope string, caller string, allowed boolean, tokens_left long, retry_micros long"
IDLE_MILLIS = 3_600_000


def _bucket(
    key: tuple, rows: Iterator[pd.DataFrame], state: GroupState, forget: bool
) -> Iterator[pd.DataFrame]:
    """Requests of one (scope, caller) against its bucket."""
    if state.hasTimedOut:
        state.remove()
        return
    scope, caller = key
    tokens, last = state.get if state.exists else (None, None)
    verdicts = []
    arrived = pd.concat(list(rows)).sort_values(["at_micros", "event_id"], kind="stable")
    for event, at, limit in zip(
        arrived["event_id"].tolist(), arrived["at_micros"].tolist(), arrived["per_minute"].tolist()
    ):
        if tokens is None:
            tokens, last = limit * ratelimit.TOKEN, at
        allowed, tokens, wait = ratelimit.take(tokens, at - last, limit)
        last = max(last, at)  # a late request does not turn the clock back
        verdicts.append((event, scope, caller, allowed, tokens, wait))
    state.update((tokens, last))
    if forget:
        state.setTimeoutDuration(IDLE_MILLIS)
    yield pd.DataFrame(verdicts, columns=["event_id", "scope", "caller", "allowed", "tokens_left", "retry_micros"])


def rate_limit(events: DataFrame, forget_idle: bool = False) -> DataFrame:
    """Verdicts on requests as they arrive.

    With ``forget_idle`` a caller not seen for an hour is dropped from the state, which gives
    it the full bucket it would have. Leave it off for runs that are to end by themselves: a
    pending timeout asks for another batch for ever.
    """
    limited = events.where(F.col("per_minute") > 0)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_idle else GroupStateTimeout.NoTimeout
    return limited.groupBy("scope", "caller").applyInPandasWithState(
        partial(_bucket, forget=forget_idle), VERDICTS, BUCKET_STATE, "append", timeout
    )
