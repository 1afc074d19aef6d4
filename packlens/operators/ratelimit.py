"""Replay of token buckets over logged requests.

A bucket per (scope, caller) holds ``per_minute`` tokens and refills to full in one minute;
each request takes one token or is told how long to wait. Tokens are whole numbers of 1/60000000
parts, so that a microsecond refills exactly ``per_minute`` parts and nothing is rounded.

The state depends on all earlier requests, so a single caller's log is a chain, and one caller
may own much of the table. The log is therefore cut into time slices. What a slice does to the
bucket, for any tokens at its start, is a small piecewise function; those functions are chained
per caller, which gives every slice its true start; then all slices are replayed side by side.
Each pass streams over sorted partitions and holds one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from packlens.functions.windows import join_null_safe
from packlens.sources.sinks import staged

TOKEN = 60_000_000
SLICE_MICROS = 600_000_000
# Requests that a task replays, about.
TASK_ROWS = 50_000

KEYS = ["scope", "caller"]


def take(tokens: int, elapsed: int, per_minute: int) -> tuple[bool, int, int]:
    """One request: (allowed, tokens left, microseconds until a token is there)."""
    tokens = min(per_minute * TOKEN, tokens + max(0, elapsed) * per_minute)
    if tokens >= TOKEN:
        return True, tokens - TOKEN, 0
    return False, tokens, -(-(TOKEN - tokens) // per_minute)


# A piece (low, high, fixed, value) says: for low <= tokens <= high the bucket ends with
# ``value`` if fixed, else with tokens + value.
Piece = tuple[int, int, bool, int]


def whole_range(per_minute: int) -> list[Piece]:
    return [(0, per_minute * TOKEN, False, 0)]


def _after(piece: Piece, elapsed: int, per_minute: int) -> Iterator[Piece]:
    """The piece after a refill and one request."""
    low, high, fixed, value = piece
    full, gain = per_minute * TOKEN, elapsed * per_minute
    if fixed:
        yield low, high, True, take(value, elapsed, per_minute)[1]
        return
    value += gain
    # Split where the bucket overflows, and where a whole token becomes available.
    poor_until = min(high, TOKEN - 1 - value)
    rich_until = min(high, full - 1 - value)
    if low <= poor_until:
        yield low, poor_until, False, value
    if max(low, poor_until + 1) <= rich_until:
        yield max(low, poor_until + 1), rich_until, False, value - TOKEN
    if max(low, rich_until + 1) <= high:
        yield max(low, rich_until + 1), high, True, full - TOKEN


def advance(pieces: list[Piece], elapsed: int, per_minute: int) -> list[Piece]:
    """The function after one more request; neighbours that became equal are merged."""
    out: list[Piece] = []
    for piece in pieces:
        for low, high, fixed, value in _after(piece, max(0, elapsed), per_minute):
            if out and out[-1][2:] == (fixed, value):
                out[-1] = (out[-1][0], high, fixed, value)
            else:
                out.append((low, high, fixed, value))
    return out


def apply(pieces: list[Piece], tokens: int) -> int:
    for low, high, fixed, value in pieces:
        if low <= tokens <= high:
            return value if fixed else tokens + value
    raise ValueError("tokens outside the bucket")


def _slice_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per slice: first and last time, and its function from the first request on.

    The refill before the first request is applied when the slices are chained.
    """
    key, state, last = None, None, None

    def finished() -> dict:
        scope, caller, number = key
        lows, highs, fixed, values = zip(*state["pieces"])
        return {
            "scope": scope, "caller": caller, "slice": number, "first_at": state["first"], "last_at": last,
            "per_minute": state["limit"], "lows": list(lows), "highs": list(highs), "fixed": list(fixed),
            "offsets": list(values),
        }

    for batch in batches:
        out = []
        for scope, caller, number, at, limit in zip(
            batch["scope"], batch["caller"], batch["slice"], batch["at_micros"], batch["per_minute"]
        ):
            if (scope, caller, number) != key:
                if key is not None:
                    out.append(finished())
                key, last = (scope, caller, number), at
                state = {"pieces": whole_range(limit), "first": at, "limit": limit}
            state["pieces"] = advance(state["pieces"], at - last, limit)
            last = max(last, at)
        yield pd.DataFrame(out, columns=_FUNCTION_COLUMNS)
    if key is not None:
        yield pd.DataFrame([finished()], columns=_FUNCTION_COLUMNS)


_FUNCTION_COLUMNS = [
    "scope", "caller", "slice", "first_at", "last_at", "per_minute", "lows", "highs", "fixed", "offsets",
]
_FUNCTION_SCHEMA = (
    "scope string, caller string, slice long, first_at long, last_at long, per_minute int,"
    " lows array<long>, highs array<long>, fixed array<boolean>, offsets array<long>"
)


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens in the bucket at the first request of every slice, after its refill, and after its last one.

    A caller begins with a full bucket, or with the one held for it.
    """
    key, tokens, last = None, 0, 0
    for batch in batches:
        starts, ends = [], []
        for row in batch.itertuples(index=False):
            full = row.per_minute * TOKEN
            if (row.scope, row.caller) != key:
                key, tokens, last = (row.scope, row.caller), full, row.first_at
                if row.held is not None:
                    tokens, last = int(row.held[0]), int(row.held[1])
            tokens = min(full, tokens + max(0, row.first_at - last) * row.per_minute)
            starts.append(tokens)
            tokens = apply(list(zip(row.lows, row.highs, row.fixed, row.offsets)), tokens)
            ends.append(tokens)
            last = max(last, row.last_at)
        yield batch[["scope", "caller", "slice", "last_at"]].assign(start_tokens=starts, end_tokens=ends)


BUCKETS = "scope string, caller string, tokens long, at_micros long"
_CHAINED = "scope string, caller string, slice long, last_at long, start_tokens long, end_tokens long"


def _bounded(events: DataFrame) -> Column:
    return F.coalesce(F.col("per_minute") > 0, F.lit(False))


def _limited(events: DataFrame, slice_micros: int) -> DataFrame:
    """The requests that a bucket decides on, with their time slices."""
    return events.where(_bounded(events) & F.col("at_micros").isNotNull()).select(
        "event_id", *KEYS, "at_micros", F.col("per_minute").cast("int").alias("per_minute"),
        F.floor(F.col("at_micros") / slice_micros).cast("bigint").alias("slice"),
    )


def _chained(limited: DataFrame, tasks: int, held: DataFrame | None = None) -> DataFrame:
    """Every slice's tokens at its start and end; ``held`` are the callers' buckets before the first slice."""
    functions = _streamed(limited, tasks, [*KEYS, "slice"], ["at_micros", "event_id"], _slice_functions, _FUNCTION_SCHEMA)
    none = F.lit(None).cast("array<bigint>")
    if held is None:
        return _streamed(functions.withColumn("held", none), tasks, KEYS, ["slice"], _chain, _CHAINED)
    buckets = held.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.array("tokens", "at_micros").alias("held"))
    same = functions["scope"].eqNullSafe(buckets["_scope"]) & functions["caller"].eqNullSafe(buckets["_caller"])
    return _streamed(functions.join(buckets, same, "left").drop("_scope", "_caller"), tasks, KEYS, ["slice"], _chain, _CHAINED)


def _verdicts(events: DataFrame, limited: DataFrame, tasks: int, chained: DataFrame) -> DataFrame:
    """The slices replayed side by side from their starts, and the requests that no bucket decides on."""
    starts = chained.select(*KEYS, "slice", "start_tokens")
    decided = _streamed(
        join_null_safe(limited, starts, [*KEYS, "slice"]),
        tasks,
        [*KEYS, "slice"],
        ["at_micros", "event_id"],
        _replay,
        "event_id long, scope string, caller string, allowed boolean, tokens_left long, retry_micros long",
    )
    bound = _bounded(events)
    free = events.where(~bound | F.col("at_micros").isNull()).select(
        "event_id", *KEYS, (~bound).alias("allowed"), F.lit(None).cast("bigint").alias("tokens_left"),
        F.lit(0).cast("bigint").alias("retry_micros"),
    )
    return decided.unionByName(free)


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The verdict on each request, from its slice's tokens at the start."""
    key, tokens, last = None, 0, 0
    for batch in batches:
        verdicts = []
        for scope, caller, number, at, limit, start in zip(
            batch["scope"], batch["caller"], batch["slice"], batch["at_micros"], batch["per_minute"], batch["start_tokens"]
        ):
            if (scope, caller, number) != key:
                key, tokens, last = (scope, caller, number), start, at
            allowed, tokens, wait = take(tokens, at - last, limit)
            last = max(last, at)
            verdicts.append((allowed, tokens, wait))
        allowed, left, wait = zip(*verdicts) if verdicts else ((), (), ())
        yield batch[["event_id", "scope", "caller"]].assign(allowed=allowed, tokens_left=left, retry_micros=wait)


def retry_after_seconds(retry_micros: str) -> Column:
    """Whole seconds a refused caller is told to wait, at least one."""
    return F.greatest(F.lit(1), F.floor(F.col(retry_micros) / 1e6 + 0.999)).cast("int")


def _tasks(limited: DataFrame) -> int:
    """Tasks among which the requests are dealt; they grow with the requests."""
    return -(-limited.count() // TASK_ROWS) or 1


def _streamed(df: DataFrame, tasks: int, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """``step`` over the rows of each partition: hashed by ``keys``, sorted by keys and ``order``.

    A number of its own keeps the adaptive plan from joining partitions of few bytes but much work.
    """
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInPandas(step, schema)


def replay(events: DataFrame, slice_micros: int = SLICE_MICROS) -> DataFrame:
    """(event_id, scope, caller, allowed, tokens_left, retry_micros) of every request.

    ``events`` holds (event_id, scope, caller, at_micros, per_minute); requests of the same
    microsecond go by event id. The limit may change between requests: the bucket is then cut
    to the new size. A limit of 0 or less, or null, is no limit. A null scope or caller is one of
    its own. A request without a time is refused. The result does not depend on ``slice_micros``.
    """
    limited = _limited(events, slice_micros)
    tasks = _tasks(limited)
    return _verdicts(events, limited, tasks, _chained(limited, tasks))


def replay_from(events: DataFrame, held: DataFrame, slice_micros: int = SLICE_MICROS) -> tuple[DataFrame, DataFrame]:
    """The verdicts on further requests, and the buckets after them, from the buckets ``held`` so far.

    A request from before its caller's last one counts as made at that time: it does not turn the clock back.
    """
    held = held.select(*KEYS, "tokens", "at_micros")
    clock = held.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("at_micros").alias("_at"))
    same = events["scope"].eqNullSafe(clock["_scope"]) & events["caller"].eqNullSafe(clock["_caller"])
    moved = events.join(clock, same, "left").withColumn("at_micros", F.when(F.col("at_micros").isNotNull(), F.greatest("at_micros", "_at")))
    moved = staged(moved.select(events.columns), "requests")
    limited = _limited(moved, slice_micros)
    tasks = _tasks(limited)
    chained = staged(_chained(limited, tasks, held), "slices")
    last = chained.groupBy(*KEYS).agg(F.max_by(F.struct(F.col("end_tokens").alias("tokens"), F.col("last_at").alias("at_micros")), "slice").alias("x"))
    both = held.withColumn("_new", F.lit(0)).unionByName(last.select(*KEYS, "x.*", F.lit(1).alias("_new")))
    after = both.groupBy(*KEYS).agg(F.max_by(F.struct("tokens", F.col("at_micros").alias("at")), "_new").alias("x"))
    return _verdicts(moved, limited, tasks, chained), after.select(*KEYS, "x.tokens", F.col("x.at").alias("at_micros"))
