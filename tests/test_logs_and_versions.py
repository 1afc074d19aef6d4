"""A log whose batches count once, index versions that only one publisher gets, ingest of changes only."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from packlens import api
from packlens.operators import chunking, forest, ingest
from packlens.sources import cells as views, sinks


def test_a_batch_that_runs_again_changes_nothing(spark, small, tmp_path):
    model = forest.fit_forest(views.labelled_cells(spark, small), trees=2, depth=3, partitions=4)
    requests, log = views.score_requests(spark, small), str(tmp_path / "log")
    first = api.predict_soh(requests, model, "7", log, key="event_id", batch="a")
    once = {r["event_id"]: (r["id"], r["predicted_soh"]) for r in first.collect()}
    again = api.predict_soh(requests, model, "7", log, key="event_id", batch="a")
    assert {r["event_id"]: (r["id"], r["predicted_soh"]) for r in again.collect()} == once and len(once) == 1000
    api.predict_soh(requests.where("event_id < 10"), model, "7", log, key="event_id", batch="b")
    held = sinks.read_log(spark, log)
    assert held.count() == 1010 == held.select("id").distinct().count() and held.where("id < 0").count() == 0


def test_ids_of_null_and_repeated_requests(spark):
    inputs = "event_id long, cycle_count double, avg_temperature_c double, avg_dod double, avg_c_rate double, calendar_age_days double, predicted_soh double"
    rows = spark.createDataFrame([(None, *(1.0,) * 6), (1, *(1.0,) * 6), (1, *(2.0,) * 6)], inputs)
    ids = [r["id"] for r in sinks.prediction_log(rows, "1", key="event_id", batch="x").collect()]
    assert len(set(ids)) == 2 and None not in ids


def indexed(spark, n):
    chunks = spark.createDataFrame([(i, "s", f"text {i}", [float(i == k) for k in range(n)]) for i in range(n)], "chunk_id long, source string, text string, embedding array<float>")
    return chunks, chunks.select(F.col("chunk_id").alias("qid"), "embedding")


def test_two_publishers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(RuntimeError, match="no version"):
        os.makedirs(f"{path}/manifest")
        ingest.published_index(spark, path)
    assert ingest.publish_verified(spark, *indexed(spark, 3), path).count() == 3
    # Both start from version 1; the second to publish fails, and readers keep the whole version of the first.
    assert ingest.publish_verified(spark, *indexed(spark, 4), path, after=1).count() == 4
    with pytest.raises(ingest.VersionConflict):
        ingest.publish_verified(spark, *indexed(spark, 5), path, after=1)
    assert ingest.published_index(spark, path).count() == 4
    versions = [tuple(r) for r in ingest.index_versions(spark, path).select("version", "n_chunks", "current").orderBy("version").collect()]
    assert versions == [(1, 3, False), (2, 4, True)]


def files_below(path):
    return {f"{d}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_changes_are_written(spark, tmp_path):
    path = str(tmp_path / "store")

    def run(rows):
        docs = spark.createDataFrame(rows, "source string, text string, digest string")
        got = ingest.ingest_changes(spark, docs, path, lambda d: chunking.fixed_chunks(d, size=10, overlap=2))
        return {r["status"]: (r["n_documents"], r["n_chunks"]) for r in got.collect()}

    def held():
        return {(r["source"], r["chunk"]) for r in ingest.current_chunks(spark, path).collect()}

    rows = [("a", "one text of some length", "x"), ("b", "short", "x"), ("b", "short", "y"), ("c", None, "x"), (None, "lost", "x"), ("e", "", "x")]
    assert run(rows) == {"new": (3, 4)}
    assert held() == {("a", "one text o"), ("a", " of some l"), ("a", " length"), ("b", "short")}
    before = files_below(path)
    assert run(rows) == {"same": (3, 0)} and files_below(path) == before
    assert run([("b", "other", "x"), ("f", "new", "x")]) == {"changed": (1, 1), "gone": (2, 0), "new": (1, 1)}
    assert held() == {("b", "other"), ("f", "new")}
    # Back to a text that was there before: it is chunked again, its old batch does not count.
    assert run([("b", "short", "x")]) == {"changed": (1, 1), "gone": (1, 0)}
    assert held() == {("b", "short")} and ingest.current_chunks(spark, path).count() == 1
    assert run([]) == {"gone": (1, 0)} and held() == set()
