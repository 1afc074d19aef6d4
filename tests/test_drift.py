"""Drift per period against the statistics of the repeated reference."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from packlens.functions import windows
from packlens.operators import drift


def repeated(reference, current, columns):
    """The same figures with the reference's counts once per period."""
    periods = current.select("day").distinct().withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns])))
    named = reference.join(periods, "column").select("day", *reference.columns)
    return drift.column_drift(named.unionByName(current), ["day", "column"])


@pytest.mark.parametrize("rows_at_once", [100_000, 0])
@pytest.mark.parametrize("seed", range(3))
def test_prefix_places_give_the_same_figures(spark, monkeypatch, rows_at_once, seed):
    """Shared and own values, days far off on either side, a day with a column missing, a constant column."""
    monkeypatch.setattr(windows, "ONE_SLICE_ROWS", rows_at_once)
    rng = random.Random(seed)
    ref = [("a", round(rng.gauss(0, 5), 1), rng.randint(1, 5)) for _ in range(300)] + [("b", float(rng.randint(0, 9)), 3) for _ in range(10)] + [("c", 4.0, 7)]
    cur = [(d, "a", round(rng.gauss(d - 2, 3 + d), 1), rng.randint(1, 4)) for d in range(5) for _ in range(60)]
    cur += [(9, "a", 500.0, 2), (10, "a", -500.0, 2), (11, "a", ref[0][1], 1), (12, "b", 3.5, 1), (12, "b", 30.0, 9), (0, "c", 4.0, 3), (1, "c", 5.0, 3), (2, "b", 0.0, 1)]
    zero = F.lit(0).cast("bigint")
    reference = spark.createDataFrame(ref, "column string, value double, n_ref long").groupBy("column", "value").agg(F.sum("n_ref").alias("n_ref")).withColumn("n_cur", zero)
    current = spark.createDataFrame(cur, "day long, column string, value double, n_cur long").withColumn("n_ref", zero).select("day", "column", "value", "n_ref", "n_cur")
    want = {(r["day"], r["column"]): r for r in repeated(reference, current, "abc").collect()}
    got = {(r["day"], r["column"]): r for r in drift.period_drift(reference, current, "day", "abc").collect()}
    assert got.keys() == want.keys() and len(got) == 27
    for k, w in want.items():
        g = got[k]
        assert (g["ref_rows"], g["cur_rows"], g["drifted"]) == (w["ref_rows"], w["cur_rows"], w["drifted"]), k
        for c in ("ks", "wasserstein", "psi"):
            assert (g[c] is None) == (w[c] is None) and (w[c] is None or g[c] == pytest.approx(w[c], rel=1e-9, abs=1e-9)), (k, c)


def test_next_known_over_slices(spark):
    rng = random.Random(3)
    rows = [(f"k{i % 3}" if i % 5 else None, rng.randint(0, 400), i, float(i) if rng.random() < 0.1 else None) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, at long, i long, v double")
    got = windows.next_known(frame, ["k"], ["at", "i"], ["v"], F.floor(F.col("at") / 7)).collect()
    for r in got:
        after = sorted((at, i, v) for k, at, i, v in rows if k == r["k"] and v is not None and (at, i) >= (r["at"], r["i"]))
        assert r["at_v"] == (after[0][2] if after else None)
    assert len(got) == 600
