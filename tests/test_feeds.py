"""Feeds that are joined as they arrive, sketches of latencies, sets of items as files."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from packlens.operators import evalgate
from packlens.sources import golden
from packlens.sources.sinks import write_report
from packlens.streaming import jobs

START = dt.datetime(2024, 1, 1)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def feed(spark, rows, schema, path, parts, last=()):
    """Rows as a stream, one file a batch in the order given; ``last`` come in a batch of their own."""
    for part in [*(rows[i::parts] for i in range(parts)), *([list(last)] if last else [])]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_questions_wait_for_their_attempts(spark, tmp_path):
    asked = [(i, f"q{i}", minutes(i)) for i in range(40)]
    tried = [(i, 1, minutes(i + 1)) for i in range(0, 40, 2)] + [(i, 2, minutes(i + 9)) for i in range(0, 40, 4)]
    tried += [(5, 1, minutes(5 + 11)), (7, 1, minutes(6)), (99, 1, minutes(20))]
    end = [(-1, None, minutes(10_000))]
    questions = feed(spark, asked, "id long, text string, asked_at timestamp", str(tmp_path / "asked"), 3, end)
    attempts = feed(spark, tried, "id long, attempt int, tried_at timestamp", str(tmp_path / "tried"), 3, end)
    out = str(tmp_path / "out")
    query = jobs.append_files(jobs.with_attempts(questions, attempts, ["id"], lateness="2 hours"), out, str(tmp_path / "state"))
    query.awaitTermination()
    got = sorted((r["id"], r["attempt"] or 0) for r in spark.read.parquet(out).where("id >= 0").collect())
    want = [(i, 1) for i in range(0, 40, 2)] + [(i, 2) for i in range(0, 40, 4)] + [(i, 0) for i in range(1, 40, 2)]
    assert got == sorted(want)


def test_latency_sketches_are_within_their_bound(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"/e{i % 2}", minutes(i % 3000), 200, rng.lognormvariate(3, 1)) for i in range(30_000)]
    log = feed(spark, rows, "endpoint string, ts timestamp, status_code int, duration_ms double", str(tmp_path / "log"), 2)
    kept = []

    def store(batch, number):
        kept.append([r.asDict() for r in batch.withColumns({f"p{s}": F.kll_sketch_get_quantile_double("latencies", F.lit(s / 100)) for s in (50, 95)}).drop("latencies").collect()])

    query = jobs.access_latency(log, width="1 day", lateness="10 days").writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {(r["endpoint"], r["window"]["start"]): r for batch in kept for r in batch}
    for (endpoint, start), r in last.items():
        own = sorted(ms for e, ts, _, ms in rows if e == endpoint and 0 <= (ts - start).total_seconds() < 86_400)
        assert len(own) == r["n_requests"]
        for share, found in ((0.5, r["p50"]), (0.95, r["p95"])):
            rank = sum(ms <= found for ms in own) / len(own)
            assert abs(rank - share) <= jobs.RANK_ERROR + 1 / len(own)


def test_sets_and_reports_as_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(golden, "ITEMS_PER_FILE", 3)
    rows = [(i, f"g{i}", "factual", True, f"ü {i}", [(f"s{i}", ["a", "b"])] if i % 2 else None, "x") for i in range(8)]
    schema = "n long, id string, category string, answerable boolean, query string, expected_chunks array<struct<source:string,must_contain:array<string>>>, reference_answer string"
    path = str(tmp_path / "golden")
    golden.write_items(spark.createDataFrame(rows, schema), path, "n", golden.GOLDEN_SCHEMA, corpus="c", description="d")
    read = golden.read_golden(spark, path)
    assert sorted((r["id"], r["query"]) for r in read.collect()) == [(f"g{i}", f"ü {i}") for i in range(8)]
    assert sorted(tuple(r) for r in golden.expected_of(read).collect()) == [(f"g{i}", 0, f"s{i}", ["a", "b"]) for i in (1, 3, 5, 7)]
    rolled = spark.createDataFrame([("faithfulness", 0.5, 3, 9, 4), ("retrieval_recall", 1.0, None, 9, 4)], "metric string, score double, scored long, n_items long, n_answerable long")
    write_report(golden.report_of(rolled), str(tmp_path / "report"))
    report = golden.read_report(spark, str(tmp_path / "report"))
    found = {(r["metric"], r["kind"]) for r in evalgate.report_gate(report, golden.gates(spark)).collect()}
    assert ("faithfulness", "score") in found and ("faithfulness", "coverage") in found and ("retrieval_recall", "score") not in found
    assert golden.read_report(spark, str(tmp_path / "none")) is None


def test_buckets_in_order_of_time_however_requests_arrive(spark, tmp_path):
    """A hot caller, null callers, free requests and ones without a time, in files that overlap in time; a second run."""
    from packlens.operators import ratelimit

    rng = random.Random(8)
    rows = [(i, "ask", "hot" if i % 2 else None if i % 5 == 0 else f"c{i % 7}", rng.randrange(400_000_000), rng.choice([6, 6, 3])) for i in range(400)]
    rows += [(1000, "ask", "hot", None, 6), (1001, "ask", "hot", 5, 0), (1002, "ask", "x", 7, None)]
    schema = "event_id long, scope string, caller string, at_micros long, per_minute int"
    path = str(tmp_path / "in")
    for part in range(4):
        own = [r for r in rows if (0 if r[3] is None else min(3, (r[3] + r[0] % 10 * 3_000_000) // 100_000_000)) == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(path)
    frame = spark.createDataFrame(rows, schema)
    want = sorted(map(str, ratelimit.replay(frame, 50_000_000).collect()))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = jobs.rate_limit_in_order(stream, out, state, 30_000_000)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    for _ in range(2):
        assert sorted(map(str, jobs.close_in_order(spark, out, last, frame.schema).select("event_id", "scope", "caller", "allowed", "tokens_left", "retry_micros").collect())) == want


def test_requests_beyond_the_lateness_do_not_turn_the_clock_back(spark):
    from packlens.operators import ratelimit

    held = spark.createDataFrame([("ask", "a", 0, 100), ("ask", "b", 60_000_000, 100)], ratelimit.BUCKETS)
    rows = spark.createDataFrame([(1, "ask", "a", 50, 6), (2, "ask", "c", 40, 6)], "event_id long, scope string, caller string, at_micros long, per_minute int")
    verdicts, after = ratelimit.replay_from(rows, held)
    assert {r["event_id"]: r["allowed"] for r in verdicts.collect()} == {1: False, 2: True}
    assert {r["caller"]: (r["tokens"], r["at_micros"]) for r in after.collect()} == {"a": (0, 100), "b": (60_000_000, 100), "c": (5 * 60_000_000, 40)}


def test_replay_is_dealt_by_requests_and_minutes_by_arrival(spark, tmp_path, monkeypatch):
    from packlens.operators import ratelimit
    from packlens.sources import logs

    rows = [(i, "ask", f"c{i % 40}", i * 1_000_000, 6) for i in range(200)] + [(900, "ask", "c0", None, 6)]
    frame = spark.createDataFrame(rows, "event_id long, scope string, caller string, at_micros long, per_minute int")
    want = sorted(map(str, ratelimit.replay(frame).collect()))
    monkeypatch.setattr(ratelimit, "TASK_ROWS", 10)
    dealt = ratelimit.replay(frame)
    assert sorted(map(str, dealt.collect())) == want
    assert dealt.where("tokens_left is not null").select(F.spark_partition_id()).distinct().count() > 8

    arrived = logs.in_minutes(frame, 20_000_000, str(tmp_path / "parts"))
    assert arrived.drop("part").exceptAll(frame).count() == 0 and arrived.count() == len(rows)
    parts = {r["event_id"]: r["part"] for r in arrived.collect()}
    assert parts[900] == 0 and set(parts.values()) == {0, 1, 2, 3}
    assert all(i // 60 <= parts[i] <= (i + 20) // 60 for i in range(200))
