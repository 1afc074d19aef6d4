"""Sessions per caller: slices against one pass over each caller, and the stream."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packlens.operators.accesslog import caller_sessions

DAY = dt.datetime(2024, 1, 1)


def by_hand(rows, gap):
    out = []
    for caller in {r[0] for r in rows}:
        times = sorted((t, s, ms) for c, t, s, ms in rows if c == caller and t is not None)
        run = []
        for i, x in enumerate(times):
            if run and x[0] - run[-1][0] > gap:
                out.append((caller, run))
                run = []
            run.append(x)
            if i == len(times) - 1:
                out.append((caller, run))
    return sorted(((c, r[0][0], r[-1][0] + gap, len(r), sum(x[1] >= 500 for x in r), float(sum(x[2] for x in r))) for c, r in out), key=str)


@pytest.mark.parametrize("width", ["1 minute", "10 minutes", "1 hour", "1 day"])
def test_slices_do_not_cut_sessions(spark, width):
    """A hot caller without a pause over many slices, callers with pauses of exactly the gap, null callers and times."""
    rng = random.Random(9)
    rows = [("hot", DAY + dt.timedelta(minutes=3 * i), 200, 1) for i in range(300)]
    rows += [(f"c{i % 5}" if i % 6 else None, DAY + dt.timedelta(minutes=rng.randrange(2000)), rng.choice([200, 500]), 2) for i in range(200)]
    rows += [("edge", DAY + dt.timedelta(minutes=30 * i), 200, 1) for i in range(5)] + [("edge", DAY + dt.timedelta(minutes=30 * 4 + 31), 503, 1)]
    rows += [("edge", None, 200, 1), ("none", None, 200, 1), ("twice", DAY, 200, 1), ("twice", DAY, 200, 1)]
    log = spark.createDataFrame(rows, "caller string, ts timestamp, status_code int, duration_ms int").repartition(3)
    got = [tuple(r) for r in caller_sessions(log, "30 minutes", width).collect()]
    assert sorted(((*g[:5], float(g[5])) for g in got), key=str) == by_hand(rows, dt.timedelta(minutes=30))
    assert caller_sessions(log.limit(0)).collect() == []


def test_same_sessions_as_the_built_in_window(spark, small):
    from packlens.sources import logs

    log = logs.access_log(spark, small)
    own = caller_sessions(log, "6 hours").select("caller", "session_start", "session_end", "n_requests")
    built = log.groupBy(F.session_window("ts", "6 hours").alias("s"), "caller").count().select("caller", "s.start", "s.end", "count")
    assert own.exceptAll(built).count() == 0 == built.exceptAll(own).count()
