"""Agent runs: token budgets, outcomes, and tool trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packlens.functions.numeric import mean_or_zero, ratio
from packlens.functions.windows import running_totals
from packlens.settings import MAX_ITERATIONS, TOKEN_BUDGET, TRAJECTORY_GATES

USAGE_FIELDS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
# Turns per slice of the running totals: bounds a task even for a run of any length.
TURN_SLICE = 1024


def billable() -> Column:
    """All token fields together, cache reads included; an absent field counts nothing."""
    total = F.lit(0).cast("bigint")
    for field in USAGE_FIELDS:
        total = total + F.coalesce(F.col(field), F.lit(0))
    return total


def token_usage(turns: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in USAGE_FIELDS]
    return turns.groupBy("request_id").agg(*sums, F.sum(billable()).alias("billable_tokens"))


def within_budget(turns: DataFrame, budget: int = TOKEN_BUDGET, max_iterations: int | None = MAX_ITERATIONS) -> DataFrame:
    """The turns that ran: up to and including the one whose spend reaches the budget.

    Adds ``billable``, ``spent`` so far, the ``iteration`` number and ``exhausted``. A budget
    of 0 is unlimited. ``max_iterations`` ends a run as well.
    """
    counted = turns.withColumns({"billable": billable(), "_turn": F.lit(1)})
    placed = running_totals(
        counted, ["request_id"], "turn", ["billable", "_turn"], F.floor(F.col("turn") / TURN_SLICE)
    ).withColumnsRenamed({"run_billable": "spent", "run__turn": "iteration"})
    reached = (F.col("spent") >= budget) if budget else F.lit(False)
    started = (F.col("spent") - F.col("billable") < budget) if budget else F.lit(True)
    ran = placed.where(started).withColumn("exhausted", reached).drop("_turn")
    return ran.where(F.col("iteration") <= max_iterations) if max_iterations else ran


def run_outcomes(requests: DataFrame, ran: DataFrame) -> DataFrame:
    """Outcome of each run from the turns that ran, its last stop reason and its tool calls.

    budget_exceeded, empty_response, the refusal's category or refusal, max_tokens, answered.
    """
    # A run's calls form one row. ``within_budget`` bounds them by MAX_ITERATIONS turns; without
    # that limit the token budget is the only bound.
    calls = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "tools"))), lambda t: t["tools"]))
    per_run = ran.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.sum("billable").alias("billable_tokens"),
        F.bool_or("exhausted").alias("exhausted"),
        F.max_by(F.struct("stop_reason", "stop_category"), "turn").alias("last"),
        calls.alias("tool_calls"),
    )
    stop = F.col("last.stop_reason")
    outcome = (
        F.when(F.col("exhausted"), F.lit("budget_exceeded"))
        .when(F.col("iterations").isNull(), F.lit("empty_response"))
        .when(stop == "refusal", F.coalesce(F.col("last.stop_category"), F.lit("refusal")))
        .when(stop == "max_tokens", F.lit("max_tokens"))
        .otherwise(F.lit("answered"))
    )
    return requests.join(per_run, "request_id", "left").select(
        "request_id",
        outcome.alias("outcome"),
        (outcome != "answered").alias("refused"),
        stop.alias("stop_reason"),
        F.coalesce("iterations", F.lit(0)).alias("iterations"),
        F.coalesce("billable_tokens", F.lit(0)).alias("billable_tokens"),
        F.coalesce("tool_calls", F.array().cast("array<string>")).alias("tool_calls"),
    )


def score_trajectories(labelled: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Which expected tools were called, which were missed, which forbidden ones were used.

    An expected entry lists alternatives separated by a pipe. With nothing expected the
    accuracy is 1; a refused run that should have used tools scores 0 and missed them all. A
    labelled request without a run counts, with accuracy 0 and all its tools missed.
    """
    absent = F.col("_ran").isNull()
    called = F.coalesce("tool_calls", F.array().cast("array<string>"))

    def met(entry: Column) -> Column:
        return F.arrays_overlap(F.split(entry, r"\|"), called)

    none = F.array().cast("array<string>")
    expected = F.col("expected_tools")
    judged = labelled.join(outcomes.withColumn("_ran", F.lit(True)), "request_id", "left").withColumns(
        {
            "_met": F.filter(expected, met),
            "_unmet": F.filter(expected, lambda e: ~met(e)),
            "violated": F.filter("forbidden_tools", lambda t: F.array_contains(called, t)),
        }
    )
    written_off = F.coalesce(F.col("refused"), F.lit(True)) & (F.size(expected) > 0)
    accuracy = (
        F.when(absent, F.lit(0.0))
        .when(F.size(expected) == 0, F.lit(1.0))
        .when(F.col("refused"), F.lit(0.0))
        .otherwise(ratio(F.size("_met"), F.size(expected)))
    )
    return judged.withColumns(
        {
            "satisfied": F.when(written_off, none).otherwise(F.col("_met")),
            "missed": F.when(written_off, expected).otherwise(F.col("_unmet")),
            "accuracy": accuracy,
            "precise": F.size("violated") == 0,
        }
    ).drop("_met", "_unmet", "_ran")


def roll_up_trajectories(items: DataFrame) -> DataFrame:
    """(metric, score, n_items); all zeros for an empty set, which then fails the gate."""
    totals = items.agg(
        F.count(F.lit(1)).alias("n_items"),
        mean_or_zero(F.col("accuracy")).alias("trajectory_accuracy"),
        mean_or_zero(F.col("precise").cast("int")).alias("tool_precision"),
    )
    lines = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in TRAJECTORY_GATES]
    return totals.select(F.explode(F.array(*lines)).alias("m"), "n_items").select("m.metric", "m.score", "n_items")


def failing_items(items: DataFrame) -> DataFrame:
    return items.where((F.size("missed") > 0) | (F.size("violated") > 0))


def unknown_tools(labelled: DataFrame, registered: tuple[str, ...]) -> DataFrame:
    """Tools the labels name that are not registered, with the number of runs naming them."""
    named = labelled.select(
        "request_id",
        F.explode(
            F.array_distinct(
                F.concat(F.flatten(F.transform("expected_tools", lambda e: F.split(e, r"\|"))), "forbidden_tools")
            )
        ).alias("tool"),
    )
    known = labelled.sparkSession.createDataFrame([(t,) for t in registered], "tool string")
    return named.join(known, "tool", "left_anti").groupBy("tool").agg(F.count(F.lit(1)).alias("n_runs"))
