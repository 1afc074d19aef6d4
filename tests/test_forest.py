"""The registered forest is the whole one; a task's tree against a plain one; first splits by histograms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.functions import trees as kernel
from packlens.operators import forest
from packlens.plans import learning


def cells(spark, n):
    """Cells with few values a feature, no two alike."""
    return spark.range(n).selectExpr(
        "cast(id as string) cell_id", "cast(id % 20 as double) cycle_count", "25e0 + id % 7 avg_temperature_c", "2e-1 + (id % 11) / 2e1 avg_dod",
        "1e0 + id % 3 avg_c_rate", "1e1 + id % 13 calendar_age_days", "9e1 + (id * 7919) % 1009 / 2e2 - (id % 20) / 2e0 soh",
    )


def test_registered_forest_is_whole(spark, tmp_path):
    lines = spark.range(3000).selectExpr("id + 1 l_orderkey", "cast(id % 7 + 1 as int) l_linenumber", "id * 31 % 211 l_partkey", "id * 17 % 101 l_suppkey")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    run = learning.recorded_run(spark, str(tmp_path)).first()
    assert (run["trees"], run["depth"]) == (200, None) and run["n_train"] + run["n_test"] == 3000
    model, _ = forest.load_latest(spark, learning._runs(spark, str(tmp_path)))
    parts = spark.read.parquet(f"{model.path}/parts").collect()
    assert {p["tree"] for p in parts} == set(range(200))
    # A tree goes on until each leaf has one label: far beyond the 511 nodes of depth 8.
    assert min(p["size"] for p in parts) > 511
    assert min(forest._depths(np.frombuffer(p["split"], np.int8)).max() for p in parts) > 8
    assert learning.rf_metrics(spark, str(tmp_path)).first()["n"] == run["n_test"]


def plain(x, y, w, depth):
    """A tree by the definition, one node after the other."""
    if y.min() == y.max() or depth == 0:
        return (w * y).sum() / w.sum()
    best = (-1.0, None, None)
    for f, values in enumerate(x):
        found = np.unique(values)
        for low, high in zip(found[:-1], found[1:], strict=True):
            left = values <= low
            score = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if score > best[0]:
                best = (score, f, (low + high) / 2)
    if best[1] is None:
        return (w * y).sum() / w.sum()
    left = x[best[1]] <= best[2]
    below = None if depth is None else depth - 1
    return (*best[1:], plain(x[:, left], y[left], w[left], below), plain(x[:, ~left], y[~left], w[~left], below))


@pytest.mark.parametrize("depth", [None, 3, 0])
def test_grown_tree_is_the_plain_one(depth):
    draw = np.random.default_rng(0)
    for digits in (0, 1, 2) * 4:
        n = int(draw.integers(1, 100))
        x = np.round(draw.normal(size=(4, n + 50)), digits)
        x[3] = 2 * x[0]
        y, w = draw.integers(0, 6, n).astype(float), draw.poisson(1, n) + 1
        split, value = kernel.grow(x[:, :n], y, kernel.steps(y, 0.0, 1.0), w, depth)
        want, tree = [], plain(x[:, :n], y, w, depth)
        for row in x.T:
            node = tree
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            want.append(node)
        assert np.allclose(value[kernel.walk(split, value, x)], want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("depth", [None, 4])
def test_first_splits_by_histograms_give_the_same_trees(spark, depth):
    """Where the bins hold every value, a tree split by all tasks scores the training rows as one grown by a task."""
    rows = cells(spark, 3000)
    whole, parted = (forest.fit_forest(rows, trees=4, depth=depth, partitions=4, node_rows=n) for n in (10_000, 300))
    assert [len(s) for s, _ in whole.tops] == [1] * 4 and min(len(s) for s, _ in parted.tops) > 15
    scores = [{r["cell_id"]: r["predicted_soh"] for r in forest.score(m, rows, "cell_id").collect()} for m in (whole, parted)]
    assert len(scores[0]) == 3000 and scores[0].keys() == scores[1].keys()
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-6
    # No part below the first splits had more rows to grow from than it should.
    assert max(size for *_, size in parted.parts) < 2 * 300


def test_scores_keep_every_request_and_refuse_missing_inputs(spark):
    rows = cells(spark, 200)
    model = forest.fit_forest(rows, trees=3, depth=2, partitions=2)
    twice = rows.unionByName(rows).withColumn("cell_id", F.when(F.col("cell_id") != "7", F.col("cell_id")))
    scored = forest.score(model, twice, "cell_id")
    assert scored.columns == ["cell_id", *forest.RAW_INPUTS, "predicted_soh"]
    assert scored.count() == 400 and scored.where("cell_id is null").count() == 2 and scored.where("predicted_soh is null").count() == 0
    assert forest.score(model, rows.limit(0), "cell_id").count() == 0
    for broken in ("null", "'NaN'"):
        with pytest.raises(Exception, match="null or NaN"):
            forest.score(model, rows.withColumn("avg_dod", F.expr(f"if(cell_id = '3', cast({broken} as double), avg_dod)")), "cell_id").collect()
