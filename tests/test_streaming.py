from pyspark.sql import functions as F

from packlens import api
from packlens.operators import forest, ratelimit
from packlens.sources import cells as views, logs
from packlens.sources.tables import events
from packlens.streaming import jobs


def split_events(spark, small, folder):
    """The events as two files in time order."""
    rows = events(spark, small)
    half = rows.approxQuantile("event_id", [0.5], 0.0)[0]
    path = f"{folder}/events.parquet"
    rows.where(F.col("event_id") <= half).coalesce(1).write.parquet(path)
    rows.where(F.col("event_id") > half).coalesce(1).write.mode("append").parquet(path)


def finished(query):
    query.awaitTermination()
    assert query.exception() is None


def test_bucket_state_carries_over_batches(spark, small, tmp_path):
    split_events(spark, small, str(tmp_path))
    stream = jobs.read_table(spark, str(tmp_path), "events", files_per_batch=1)
    out = str(tmp_path / "verdicts")
    finished(jobs.append_files(jobs.rate_limit(logs.rate_events_of(stream)), out, str(tmp_path / "state")))
    batch = ratelimit.replay(logs.rate_events(spark, small)).select("event_id", "allowed", "tokens_left", "retry_micros")
    streamed = spark.read.parquet(out).select("event_id", "allowed", "tokens_left", "retry_micros")
    assert streamed.count() == 1000 and streamed.exceptAll(batch).count() == 0


def test_stored_counts_survive_a_second_run(spark, small, tmp_path):
    split_events(spark, small, str(tmp_path))
    path, state = str(tmp_path / "counts"), str(tmp_path / "state")
    for _ in range(2):
        stream = jobs.read_table(spark, str(tmp_path), "events", files_per_batch=1)
        finished(jobs.keep_value_counts(stream.selectExpr(*views.REQUEST_EXPRESSIONS), path, state))
    assert spark.read.parquet(path).agg(F.sum("n_cur")).first()[0] == 5 * 1000


def test_sessions_of_callers(spark, small, tmp_path):
    split_events(spark, small, str(tmp_path))
    log = logs.access_of(jobs.read_table(spark, str(tmp_path), "events"))
    query = (
        jobs.caller_sessions(log, "6 hours")
        .writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    )
    finished(query)
    batch = logs.access_log(spark, small).groupBy(F.session_window("ts", "6 hours").alias("s"), "caller").count()
    assert spark.table("sessions").count() == batch.count()
    assert spark.table("sessions").agg(F.sum("n_requests")).first()[0] == 1000


def test_tools_over_tables(spark, small, tmp_path):
    cells = views.labelled_cells(spark, small)
    model = forest.fit_forest(cells, trees=3, depth=4, partitions=4)
    log = str(tmp_path / "log")
    requests = views.score_requests(spark, small)
    assert api.predict_soh(requests, model, log=log).count() == 1000
    api.predict_soh(requests, model, "7", log=log)
    versions = {r.model_version: r["count"] for r in spark.read.parquet(log).groupBy("model_version").count().collect()}
    assert versions == {"unknown": 1000, "7": 1000}
    report = api.drift_report(cells, requests).first()
    assert report.number_of_columns == 5 and report.alert
    assert api.eval_gate(spark, str(tmp_path / "none.json")).first()["kind"] == "missing"


def test_search_tool_keeps_queries_without_passages(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    passages = spark.createDataFrame([(1, "a", "one"), (2, "b", "two")], "chunk_id long, source string, text string")
    queries = spark.createDataFrame([(5, [1.0, 0.0]), (6, [-1.0, -1.0])], "qid long, embedding array<float>")
    found = {r.qid: r for r in api.search_docs(queries, vectors, passages).collect()}
    assert [(p.source, p.relevance) for p in found[5].passages] == [("a", 1.0)]
    assert found[5].candidate_scores == [1.0, 0.0]
    assert found[6].passages == [] and len(found[6].candidate_scores) == 2
