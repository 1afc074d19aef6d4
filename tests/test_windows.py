import random

from pyspark.sql import Window, functions as F

from packlens.functions import windows


def hot_rows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else None if i % 7 == 0 else f"k{i % 7}", i, rng.randint(0, 9)) for i in range(2000)]
    rows.append((None, None, 3))
    return spark.createDataFrame(rows, "k string, t long, v long")


def test_running_totals_equal_one_window(spark):
    rows = hot_rows(spark)
    sliced = windows.running_totals(rows, ["k"], "t", ["v"], F.floor(F.col("t") / 50), following=True)
    whole = Window.partitionBy("k").orderBy("t")
    plain = rows.withColumns({"run_v": F.sum("v").over(whole), "next_t": F.lead("t").over(whole)})
    columns = ["k", "t", "v", "run_v", "next_t"]
    assert sorted(map(str, sliced.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))


def test_sliced_counts_equal_unsliced(spark, monkeypatch):
    rng = random.Random(6)
    rows = spark.createDataFrame(
        [(f"g{i % 3}" if i % 4 else None, round(rng.gauss(0, 10), 2) if i % 9 else None, rng.randint(1, 4)) for i in range(900)],
        "g string, x double, n long",
    ).groupBy("g", "x").agg(F.sum("n").alias("n"))
    columns = ["g", "x", "n", "run_n", "total_n", "next_x"]
    plain = windows.placed_counts(rows, ["g"], "x", ["n"]).select(columns).collect()
    monkeypatch.setattr(windows, "ONE_SLICE_ROWS", 0)
    sliced = windows.placed_counts(rows, ["g"], "x", ["n"]).select(columns).collect()
    assert len(plain) == rows.count() and any(r["g"] is None for r in plain)
    assert sorted(map(str, plain)) == sorted(map(str, sliced))
