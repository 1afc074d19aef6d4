import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from packlens.operators import contract, ratelimit, runs
from packlens.sources import logs

SECOND = 1_000_000


def by_hand(events):
    """Straight replay in floating point of one caller's (at, limit) rows."""
    tokens = updated = None
    out = []
    for at, limit in events:
        if tokens is None:
            tokens, updated = float(limit), at
        tokens = min(limit, tokens + (at - updated) / SECOND * limit / 60)
        updated = at
        out.append(tokens >= 1 - 1e-9)
        if out[-1]:
            tokens -= 1
    return out


def replayed(spark, rows, **options):
    events = spark.createDataFrame(rows, "event_id long, scope string, caller string, at_micros long, per_minute int")
    return {r.event_id: r for r in ratelimit.replay(events, **options).collect()}


def test_burst_refill_and_idle(spark):
    rows = [(i, "ask", "a", 0, 3) for i in range(4)]
    rows += [(10, "ask", "b", 0, 1), (11, "ask", "b", 30 * SECOND, 1), (12, "ask", "b", 60 * SECOND, 1)]
    rows += [(20, "ask", "c", 0, 5), (21, "ask", "c", 3600 * SECOND, 5)]
    rows += [(30, "agent", "a", 0, 3), (40, "ask", "d", 0, 0)]
    got = replayed(spark, rows)
    assert [got[i].allowed for i in range(4)] == [True, True, True, False]
    assert got[3].retry_micros == 20 * SECOND
    assert [got[i].allowed for i in (10, 11, 12)] == [True, False, True]
    assert got[21].tokens_left == 4 * ratelimit.TOKEN
    assert got[30].allowed and got[40].allowed


@pytest.mark.parametrize("width", [7 * SECOND, 600 * SECOND])
def test_a_hot_caller_is_replayed_exactly_whatever_the_slices(spark, width):
    rng = random.Random(8)
    at, rows = 0, []
    for i in range(1500):
        at += rng.choice([0, 1000, 400_000, 2 * SECOND, 9 * SECOND, 61 * SECOND if rng.random() < 0.05 else 0])
        rows.append((i, "ask", "hot" if rng.random() < 0.7 else f"c{i % 5}", at, 12))
    got = replayed(spark, rows, slice_micros=width)
    for caller in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == caller]
        assert [got[r[0]].allowed for r in mine] == by_hand([(r[3], r[4]) for r in mine])


@settings(max_examples=150, deadline=None)
@given(
    st.integers(1, 9),
    st.lists(st.integers(0, 20 * SECOND), min_size=1, max_size=30),
    st.floats(0, 1),
)
def test_slice_functions_agree_with_single_steps(limit, gaps, share):
    start = int(share * limit * ratelimit.TOKEN)
    tokens, pieces = start, ratelimit.whole_range(limit)
    for gap in gaps:
        _, tokens, _ = ratelimit.take(tokens, gap, limit)
        pieces = ratelimit.advance(pieces, gap, limit)
    assert ratelimit.apply(pieces, start) == tokens
    assert pieces[0][0] == 0 and pieces[-1][1] == limit * ratelimit.TOKEN
    assert all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:]))


TURNS = (
    "request_id long, turn long, input_tokens long, output_tokens long, cache_creation_input_tokens long,"
    " cache_read_input_tokens long, tools array<string>, stop_reason string, stop_category string"
)


def turn(request, number, tokens, tools=(), stop="end_turn", category=None, cached=None):
    return (request, number, tokens, 0, 0, cached, list(tools), stop, category)


def test_budget_is_inclusive_and_zero_is_unlimited(spark):
    rows = spark.createDataFrame([turn(1, 0, 600), turn(1, 1, 500), turn(1, 2, 1), turn(2, 0, 10, cached=990)], TURNS)
    ran = runs.within_budget(rows, 1000)
    assert {(r.request_id, r.turn, r.spent, r.exhausted) for r in ran.collect()} == {
        (1, 0, 600, False), (1, 1, 1100, True), (2, 0, 1000, True),
    }
    assert runs.within_budget(rows, 0).where("exhausted").count() == 0
    usage = {r.request_id: r.billable_tokens for r in runs.token_usage(rows).collect()}
    assert usage == {1: 1101, 2: 1000}


def test_iterations_are_limited(spark):
    rows = spark.createDataFrame([turn(1, 2 * i, 1) for i in range(40)], TURNS)
    assert runs.within_budget(rows).count() == 12
    assert runs.within_budget(rows, max_iterations=None).count() == 40


def outcomes(spark, rows, budget=1000):
    turns = spark.createDataFrame(rows, TURNS)
    requests = spark.createDataFrame([(i,) for i in range(1, 7)], "request_id long")
    return {r.request_id: r for r in runs.run_outcomes(requests, runs.within_budget(turns, budget)).collect()}


def test_run_outcomes(spark):
    rows = [
        turn(1, 0, 1000, stop="refusal"),
        turn(2, 0, 1, ["b"], "tool_use"), turn(2, 1, 1, ["a"], "refusal", "cyber"),
        turn(3, 0, 1, stop="refusal"),
        turn(4, 0, 1, stop="max_tokens"),
        turn(5, 1, 1, ["x"]), turn(5, 0, 1, ["y", "z"], "tool_use"),
    ]
    got = outcomes(spark, rows)
    assert [got[i].outcome for i in range(1, 7)] == [
        "budget_exceeded", "cyber", "refusal", "max_tokens", "answered", "empty_response",
    ]
    assert got[5].tool_calls == ["y", "z", "x"] and got[5].iterations == 2 and got[6].iterations == 0


def test_trajectory_rules(spark):
    labelled = spark.createDataFrame(
        [(1, ["p", "a|s"], []), (2, ["a|s"], ["d"]), (3, ["p"], []), (4, [], ["d"]), (5, ["p", "a|s"], [])],
        "request_id long, expected_tools array<string>, forbidden_tools array<string>",
    )
    done = spark.createDataFrame(
        [(1, ["p"], False), (2, ["s", "d"], False), (3, ["p"], True), (4, [], True), (5, ["a", "p"], False)],
        "request_id long, tool_calls array<string>, refused boolean",
    )
    items = runs.score_trajectories(labelled, done)
    got = {r.request_id: (r.accuracy, r.satisfied, r.missed, r.violated, r.precise) for r in items.collect()}
    assert got == {
        1: (0.5, ["p"], ["a|s"], [], True),
        2: (1.0, ["a|s"], [], ["d"], False),
        3: (0.0, [], ["p"], [], True),
        4: (1.0, [], [], [], True),
        5: (1.0, ["p", "a|s"], [], [], True),
    }
    scores = {r.metric: r.score for r in runs.roll_up_trajectories(items).collect()}
    assert scores == {"trajectory_accuracy": 0.7, "tool_precision": 0.8}
    empty = {r.metric: r.score for r in runs.roll_up_trajectories(items.limit(0)).collect()}
    assert set(empty.values()) == {0.0}
    assert {r.request_id for r in runs.failing_items(items).collect()} == {1, 2, 3}
    assert {(r.tool, r.n_runs) for r in runs.unknown_tools(labelled, ("p", "a", "d")).collect()} == {("s", 3)}


def test_secrets_are_masked_and_counts_stay(spark):
    line = '{"level":"INFO","x_Api_Key":"k","Authorization":"b","password":"p","a_secret":"s","input_tokens":5,"tokens":1,"token":"t","status_code":"200"}'
    parsed = logs.parse_lines(spark.createDataFrame([(line,), ("no json",)], "line string"))
    bad = parsed.where("malformed").collect()
    assert [(r.raw, r.level) for r in bad] == [("no json", None)]
    row = parsed.where("not malformed").select(logs.mask(F.col("extras")).alias("e"), "status_code", "raw").collect()
    assert len(row) == 1 and row[0].status_code == 200 and row[0].raw is None
    assert row[0].e == {
        "x_Api_Key": "***", "Authorization": "***", "password": "***", "a_secret": "***", "token": "***",
        "input_tokens": "5", "tokens": "1",
    }


def test_caller_identity(spark):
    rows = spark.createDataFrame([("sk-123456789", "h"), ("", "h"), (None, None)], "k string, h string")
    got = [r[0] for r in rows.select(logs.caller_identity(F.col("k"), F.col("h"))).collect()]
    assert got == ["key:sk-12345", "ip:h", "ip:unknown"]


def test_contract(spark):
    declared = T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("n", T.IntegerType()),
            T.StructField("gone", T.StringType(), False),
        ]
    )
    rows = spark.createDataFrame([(1, "5", 1.0), (None, "x", 2.0)], "id long, n string, more double")
    got = {r.column: (r.verdict, r.n_null, r.n_uncastable, r.required_broken) for r in contract.check_contract(rows, declared).collect()}
    assert got == {
        "id": ("ok", 1, 0, True), "n": ("type string", 0, 1, False), "gone": ("missing", 0, 0, True),
        "more": ("extra", 0, 0, False),
    }
    assert set(contract.schema_differences(contract.PREDICTION_LOG, contract.PREDICTION_LOG).values()) == {"ok"}


def test_labelled_requests_without_a_run_count(spark):
    labelled = spark.createDataFrame([(1, ["p"], []), (2, [], ["d"])], "request_id long, expected_tools array<string>, forbidden_tools array<string>")
    none = spark.createDataFrame([], "request_id long, tool_calls array<string>, refused boolean")
    items = {r.request_id: r for r in runs.score_trajectories(labelled, none).collect()}
    assert [items[i].accuracy for i in (1, 2)] == [0.0, 0.0] and items[1].missed == ["p"] and items[2].precise


def test_budget_and_replay_keep_null_keys(spark):
    fields = "input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long"
    turns = spark.createDataFrame([(None, 1, 5, 5, 0, None), (1, None, 5, 5, 0, None), (1, 2, 5, 5, 0, 1)], f"request_id long, turn long, {fields}")
    assert runs.within_budget(turns).count() == 3
    rows = [(1, None, "a", 0, 1), (2, None, "a", 1, 1), (3, "s", None, 0, 1), (4, "s", "a", 0, None), (5, "s", "a", None, 1)]
    events = spark.createDataFrame(rows, "event_id long, scope string, caller string, at_micros long, per_minute long")
    got = {r.event_id: r.allowed for r in ratelimit.replay(events).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_own_log_meets_its_contract(spark):
    from packlens.operators.contract import PREDICTION_LOG, check_contract
    from packlens.sources.sinks import prediction_log

    inputs = "cycle_count double, avg_temperature_c double, avg_dod double, avg_c_rate double, calendar_age_days double, predicted_soh double"
    log = prediction_log(spark.createDataFrame([(1.0,) * 6, (2.0,) * 6], inputs), "3")
    assert all(r.verdict == "ok" and not r.required_broken for r in check_contract(log, PREDICTION_LOG).collect())
