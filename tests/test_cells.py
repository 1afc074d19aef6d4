from pyspark.sql import functions as F

from packlens.functions.numeric import physics_soh
from packlens.operators import cells, drift, forest
from packlens.sources import cells as views


def requests(spark, *rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in views.RAW_INPUTS))


def test_features_by_hand(spark):
    row = cells.with_features(requests(spark, (1000.0, 35.0, 0.5, 1.0, 400.0))).first()
    assert tuple(row.asDict()) == cells.FEATURES
    assert (row.equivalent_full_cycles, row.temperature_stress, row.calendar_stress) == (500.0, 2.0, 20.0)


def test_soh_is_clipped(spark):
    rows = requests(spark, (0.0, 25.0, 0.5, 1.0, 0.0), (3000.0, 45.0, 1.0, 2.0, 1500.0))
    assert [r[0] for r in rows.select(physics_soh()).collect()] == [100.0, 70.0]


def test_perfect_prediction(spark):
    rows = spark.createDataFrame([(80.0, 80.0), (90.0, 90.0), (95.0, 95.0)], "y double, p double")
    row = cells.regression_metrics(rows, "y", "p").first()
    assert (row.mae, row.rmse, row.r2) == (0.0, 0.0, 1.0)


def test_request_problems(spark):
    rows = requests(spark, (-1.0, 20.0, 1.5, 1.0, 1.0), (1.0, 20.0, 0.5, 1.0, 1.0))
    assert [r[0] for r in rows.select(cells.score_request_problems()).collect()] == [["cycle_count", "avg_dod"], []]
    rows = requests(spark, (None, float("nan"), 0.5, float("nan"), None))
    assert rows.select(cells.score_request_problems()).first()[0] == ["cycle_count", "avg_temperature_c", "avg_c_rate", "calendar_age_days"]


def test_constant_truth(spark):
    rows = spark.createDataFrame([(80.0, 80.0, 81.0), (80.0, 80.0, 80.0)], "y double, p double, q double")
    assert cells.regression_metrics(rows, "y", "p").first()["r2"] == 1.0
    assert cells.regression_metrics(rows, "y", "q").first()["r2"] == 0.0


def test_latest_version_is_numeric(spark):
    rows = spark.createDataFrame([("m", "9", "a"), ("m", "10", "b")], "model string, version string, run_id string")
    assert cells.latest_versions(rows).first()["version"] == "10"


def test_split_share_and_stability(spark, small):
    rows = views.labelled_cells(spark, small)
    marked = cells.split_train_test(rows, "cell_id", 0.2, 42).select("cell_id", "is_test")
    share = marked.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.17 < share < 0.23
    again = cells.split_train_test(rows.repartition(3), "cell_id", 0.2, 42).select("cell_id", "is_test")
    assert marked.exceptAll(again).count() == 0


def test_row_count_without_table(spark):
    assert cells.row_count(spark, "no_such_table") == 0


def current_and_reference(spark, small):
    rows = views.cell_samples(spark, small).select("cell_id", *views.RAW_INPUTS)
    half = F.pmod(F.xxhash64("cell_id"), F.lit(3)) == 0
    return rows.where(~half), rows.where(half)


def test_no_drift_for_the_same_distribution(spark, small):
    reference, current = current_and_reference(spark, small)
    row = drift.drift_summary(drift.drift_between(reference, current)).first()
    assert row.number_of_columns == 5 and row.alert is False


def test_alert_when_three_of_five_shift(spark, small):
    reference, current = current_and_reference(spark, small)
    shifted = current.withColumns(
        {
            "avg_temperature_c": F.col("avg_temperature_c") + 40,
            "cycle_count": F.col("cycle_count") + 2500,
            "calendar_age_days": F.col("calendar_age_days") + 1500,
        }
    )
    row = drift.drift_summary(drift.drift_between(reference, shifted)).first()
    assert row.number_of_drifted_columns == 3
    assert row.dataset_drift is True and row.alert is True
    assert abs(row.share_of_drifted_columns - 0.6) < 1e-12


def test_drift_refuses_an_empty_side(spark, small):
    import pytest

    reference, current = current_and_reference(spark, small)
    with pytest.raises(Exception, match="no logged requests"):
        drift.drift_summary(drift.drift_between(reference, current.where("false"))).collect()


def test_forest_is_accurate_and_versions_count_up(spark, small, tmp_path):
    rows = views.labelled_cells(spark, small)
    first = forest.record_training(spark, rows, str(tmp_path), trees=6, depth=7, partitions=4).first()
    second = forest.record_training(spark, rows, str(tmp_path), trees=2, depth=3, partitions=4).first()
    assert first.r2 > 0.6 and first.features == list(cells.FEATURES)
    assert first.n_train + first.n_test == rows.count()
    assert (first.version, second.version) == ("1", "2")
    model, version = forest.load_latest(spark, str(tmp_path))
    assert version == "2"
    assert forest.score(model, views.score_requests(spark, small), "event_id").count() == 1000


def test_more_training_rows_get_more_partitions(spark):
    cells = spark.range(4000).selectExpr(
        "cast(id as double) cycle_count", "25e0 + id % 7 avg_temperature_c", "5e-1 avg_dod", "1e0 avg_c_rate", "1e1 + id calendar_age_days", "9e1 soh"
    )
    sizes = forest.dealt(cells, partitions=2, rows=500).rdd.glom().map(len).collect()
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 1000
    assert forest.dealt(cells, partitions=10, rows=500).rdd.getNumPartitions() == 10
