"""Registered queries next to their SQL on the smallest tables, and what their plans may hold."""

import pytest

import compare
from packlens.plans.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()
# Covered by the plain forms of the same jobs.
HEAVY = {"drift_daily", "stream_drift_daily", "eval_gate", "item_scores_long", "guardrail_outcomes", "citations"}


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(set(ORACLES) - HEAVY))
def test_query_equals_sql(spark, con, small, key):
    ok, message, *_ = compare.check(spark, con, small, QUERIES[key], ORACLES[key])
    assert ok, message


@pytest.mark.parametrize("key", ["vector_topk", "golden_rot", "serviceability", "budget_cutoff", "groundedness", "output_resolution"])
def test_plans_have_no_cross_join(spark, small, key):
    plan = QUERIES[key](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_limited_before_the_shuffle(spark, small):
    plan = QUERIES["vector_topk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_recent_requests_use_a_top_n(spark, small):
    plan = QUERIES["recent_predictions"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_screening_stays_in_the_jvm(spark, small):
    plan = QUERIES["input_screening"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_stream_scores_equal_batch_scores(spark, small):
    streamed = {r.event_id: r.predicted_soh for r in QUERIES["stream_scores"](spark, small).where("model_version = '1'").collect()}
    batch = {r.event_id: r.predicted_soh for r in QUERIES["batch_scores"](spark, small).collect()}
    assert streamed == batch and len(batch) == spark.read.parquet(f"{small}/events.parquet").count()


def test_forest_does_not_depend_on_partitions(spark, small):
    from packlens.operators import forest
    from packlens.sources import cells

    rows = cells.labelled_cells(spark, small)
    metrics = [forest.train_and_test(rows.repartition(n), trees=5, depth=6, partitions=4)[1].first() for n in (2, 8)]
    assert [round(v, 9) for v in metrics[0]] == [round(v, 9) for v in metrics[1]] and metrics[0]["r2"] > 0.6
