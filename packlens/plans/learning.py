"""Model queries and the streaming twins of batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.operators import drift, forest
from packlens.operators.cells import latest_versions
from packlens.plans import answering, degradation, operations
from packlens.session import staging_path
from packlens.sources import cells as views, logs, replies
from packlens.sources.passages import PLANTED_QUESTION
from packlens.sources.tables import spread
from packlens.streaming import jobs

# Fewer partitions than the library's default; trees and their depth are the library's.
PARTITIONS = 16
# Where this application recorded the run of a data folder.
_RECORDED: dict[tuple[str, str], str] = {}


def _runs(spark: SparkSession, folder: str) -> str:
    """Folder of the recorded runs; trains and records one where this application has none yet."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _RECORDED:
        path = staging_path(spark, "models")
        forest.record_training(spark, spread(views.labelled_cells(spark, folder)), path, partitions=PARTITIONS)
        _RECORDED[key] = path
    return _RECORDED[key]


def _newest_run(spark: SparkSession, folder: str) -> DataFrame:
    runs = spark.read.schema(forest.RUN_SCHEMA).parquet(f"{_runs(spark, folder)}/runs")
    return runs.join(latest_versions(runs).select("model", "version"), ["model", "version"])


def rf_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _newest_run(spark, folder).select(F.col("n_test").alias("n"), *[F.round(m, 4).alias(m) for m in ("mae", "rmse", "r2")])


def recorded_run(spark: SparkSession, folder: str) -> DataFrame:
    """The newest recorded run as it is read back."""
    return _newest_run(spark, folder).select("model", "version", "trees", "depth", "n_train", "n_test", F.size("features").alias("n_features"))


def batch_scores(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = forest.load_latest(spark, _runs(spark, folder))
    scored = forest.score(model, views.score_requests(spark, folder), "event_id")
    return scored.select("event_id", F.round("predicted_soh", 4).alias("predicted_soh"))


def _finished(query, spark: SparkSession, path: str) -> DataFrame:
    query.awaitTermination()
    return spark.read.parquet(path)


def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    model, version = forest.load_latest(spark, _runs(spark, folder))
    rows = jobs.read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = staging_path(spark, "prediction-log")
    requests = rows.selectExpr(*views.REQUEST_EXPRESSIONS)
    log = _finished(jobs.score(requests, model, version, path, staging_path(spark, "state"), "event_id"), spark, path)
    return log.select("event_id", F.round("predicted_soh", 4).alias("predicted_soh"), "model_version")


def stream_screening(spark: SparkSession, folder: str) -> DataFrame:
    rows = jobs.read_table(spark, folder, "conversations").where("role = 'user'")
    asked = rows.select("conv_id", "turn", F.expr(PLANTED_QUESTION).alias("question"))
    path = staging_path(spark, "screened")
    screened = jobs.screen(asked).select("conv_id", "turn", "reason", "intent", "estimated_tokens")
    return _finished(jobs.append_files(screened, path, staging_path(spark, "state")), spark, path)


def stream_drift_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The daily drift report from counts that a stream stored."""
    rows = jobs.read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = staging_path(spark, "day-counts")
    requests = rows.selectExpr(*views.REQUEST_EXPRESSIONS)
    query = jobs.keep_value_counts(requests, path, staging_path(spark, "state"))
    current = _finished(query, spark, path).drop("batch")
    reference = drift.value_counts(views.cell_samples(spark, folder), "reference")
    return degradation.daily_report(reference, current)


def stream_access_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Daily requests and errors per endpoint, every window closed or still open.

    Each batch stores the windows it changed; a window counts as its last batch left it.
    """
    rows = jobs.read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = staging_path(spark, "access")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        jobs.access_rollup(logs.access_of(rows))
        .writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", staging_path(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    figures = F.struct("n_requests", "n_errors", "total_ms")
    rolled = _finished(query, spark, path).groupBy("window", "endpoint").agg(F.max_by(figures, "batch").alias("last"))
    return rolled.select(
        "endpoint",
        F.date_format("window.start", "yyyy-MM-dd").alias("day"),
        "last.n_requests",
        "last.n_errors",
        F.round("last.total_ms", 4).alias("total_ms"),
    )


def stream_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the stream's median and 95th percentile per endpoint and day are within the sketch's bound of the log's own."""
    rows = jobs.read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = staging_path(spark, "latency")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        jobs.access_latency(logs.access_of(rows)).writeStream.foreachBatch(store).outputMode("update")
        .option("checkpointLocation", staging_path(spark, "state")).trigger(availableNow=True).start()
    )
    rolled = _finished(query, spark, path).groupBy("window", "endpoint").agg(F.max_by(F.struct("n_requests", "latencies"), "batch").alias("last"))
    shares = {"p50": 0.5, "p95": 0.95}
    figures = rolled.select(
        "endpoint", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "last.n_requests",
        *[F.kll_sketch_get_quantile_double("last.latencies", F.lit(share)).alias(name) for name, share in shares.items()],
    )
    log = logs.access_log(spark, folder).select("endpoint", F.date_format("ts", "yyyy-MM-dd").alias("day"), "duration_ms")
    keys = ["endpoint", "day"]
    joined = log.join(figures, keys)
    ranks = [F.avg((F.col("duration_ms") <= F.col(n)).cast("int")).alias(f"_upto_{n}") for n in shares]
    below = [F.avg((F.col("duration_ms") < F.col(n)).cast("int")).alias(f"_below_{n}") for n in shares]
    near = [
        ((F.col(f"_upto_{n}") >= share - jobs.RANK_ERROR) & (F.col(f"_below_{n}") <= share + jobs.RANK_ERROR)).alias(f"{n}_near") for n, share in shares.items()
    ]
    return joined.groupBy(*keys, "n_requests").agg(*ranks, *below).select(*keys, "n_requests", *near)


def stream_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of all questions whose attempts came as a second feed. A last row in both feeds, of no
    conversation, moves the time on, so that questions without an attempt do not stay open."""
    keys = answering.KEYS
    # From 2024 on: a stream's first watermark is 1970, and what is not after it is late.
    second = F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60
    asked_at, tried_at = F.timestamp_seconds(second), F.timestamp_seconds(second + F.col("attempt"))
    asked = replies.question_rows(spark, folder).withColumn("asked_at", asked_at)
    tried = replies.attempts(spark, folder).withColumn("tried_at", tried_at)
    path, last = staging_path(spark, "feeds"), F.timestamp_seconds(F.lit(4_102_444_800))
    for name, rows, time in (("asked", asked, "asked_at"), ("tried", tried, "tried_at")):
        rows.write.parquet(f"{path}/{name}")
        given = {"conv_id": F.lit(-1), "turn": F.lit(-1), time: last}
        end = spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
        end.write.mode("append").parquet(f"{path}/{name}")
    feed = {name: spark.readStream.schema(rows.schema).parquet(f"{path}/{name}") for name, rows in (("asked", asked), ("tried", tried))}
    out = staging_path(spark, "waited")
    held = _finished(jobs.append_files(jobs.with_attempts(feed["asked"], feed["tried"], keys), out, staging_path(spark, "state")), spark, out).where("conv_id >= 0")
    known = held.select(asked.drop("asked_at").columns).dropDuplicates(keys)
    attempts = held.where("attempt is not null").select(tried.drop("tried_at").columns)
    return answering.answer_rows(answering.answered(spark, folder, known, attempts))


def stream_caller_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that ended an hour or more before the newest request, each stored once when it closed."""
    rows = jobs.read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = jobs.caller_sessions(logs.access_of(rows), operations.SESSION_GAP)
    path = staging_path(spark, "sessions")
    stored = _finished(jobs.append_files(closed, path, staging_path(spark, "state")), spark, path)
    return operations.session_rows(stored.withColumns({"session_start": F.col("session.start"), "session_end": F.col("session.end")}))


def stream_rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    rows = jobs.read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = staging_path(spark, "verdicts")
    verdicts = jobs.rate_limit(logs.rate_events_of(rows))
    return _finished(jobs.append_files(verdicts, path, staging_path(spark, "state")), spark, path)


def stream_rate_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The verdicts on requests that arrive minute by minute, out of order by up to twenty seconds."""
    rows, late = logs.rate_events(spark, folder), 20_000_000
    arrivals = logs.in_minutes(rows, late, staging_path(spark, "parts"))
    path, out, state = (staging_path(spark, name) for name in ("arrivals", "verdicts", "state"))
    numbers = sorted(r["part"] for r in arrivals.select("part").distinct().collect())  # the minutes of the log
    last = -1
    # A batch takes in all files of two minutes, however many tasks wrote them.
    for i in range(0, len(numbers), 2):
        arrivals.where(F.col("part").isin(numbers[i : i + 2])).drop("part").write.mode("append").parquet(path)
        query = jobs.rate_limit_in_order(spark.readStream.schema(rows.schema).parquet(path), out, state, late)
        query.awaitTermination()
        last = query.lastProgress["batchId"]
    return jobs.close_in_order(spark, out, last, rows.schema)


QUERIES = {
    "rf_metrics": rf_metrics,
    "recorded_run": recorded_run,
    "batch_scores": batch_scores,
    "stream_scores": stream_scores,
    "stream_screening": stream_screening,
    "stream_drift_daily": stream_drift_daily,
    "stream_access_rollup": stream_access_rollup,
    "stream_caller_sessions": stream_caller_sessions,
    "stream_latency": stream_latency,
    "stream_answers": stream_answers,
    "stream_rate_limit": stream_rate_limit,
    "stream_rate_in_order": stream_rate_in_order,
}

ORACLES = {
    "stream_screening": f"""SELECT conv_id, turn, reason, intent, estimated_tokens
        FROM ({answering.ORACLES['input_screening']})""",
    "stream_drift_daily": degradation.ORACLES["drift_daily"],
    "stream_access_rollup": f"""WITH {operations._ACCESS} SELECT endpoint, strftime(ts,'%Y-%m-%d') AS day,
        count(*) AS n_requests, count(*) FILTER (WHERE status_code>=500) AS n_errors, round(sum(duration_ms),4) AS total_ms
        FROM access_log GROUP BY ALL""",
    "stream_latency": f"""WITH {operations._ACCESS} SELECT endpoint, strftime(ts,'%Y-%m-%d') AS day, count(*) AS n_requests,
        true AS p50_near, true AS p95_near FROM access_log GROUP BY ALL""",
    "stream_answers": answering.ORACLES["answers"],
    "stream_caller_sessions": f"""WITH {operations._ACCESS}, {operations._SESSIONS} SELECT sessions.* FROM sessions,
        (SELECT strftime(max(ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS mark FROM access_log) WHERE session_end <= mark""",
    "stream_rate_limit": operations.ORACLES["rate_limit_replay"],
    "stream_rate_in_order": operations.ORACLES["rate_limit_replay"],
}
