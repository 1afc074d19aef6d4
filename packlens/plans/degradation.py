"""Queries over the battery views and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.functions.numeric import physics_soh
from packlens.operators import cells as ops, drift
from packlens.plans.oracle_views import with_views
from packlens.session import staging_path
from packlens.settings import END_OF_LIFE_SOH, KS_CRITICAL, SEED, TEST_SHARE
from packlens.sources import cells as views, sinks
from packlens.sources.tables import events, table


def soh_features(spark: SparkSession, folder: str) -> DataFrame:
    featured = ops.with_features(views.labelled_cells(spark, folder), "cell_id", "soh")
    rounded = [F.round(c, 6).alias(c) for c in ops.FEATURES]
    return featured.select("cell_id", "soh", *rounded)


def soh_physics(spark: SparkSession, folder: str) -> DataFrame:
    cells = views.cell_samples(spark, folder)
    return cells.select("cell_id", physics_soh(F.col("noise")).alias("soh"), physics_soh().alias("noiseless_soh"))


def soh_bands(spark: SparkSession, folder: str) -> DataFrame:
    cells = views.labelled_cells(spark, folder)
    bands = {
        "few_cycles": F.col("cycle_count") < 500,
        "many_cycles": F.col("cycle_count") > 2500,
        "cool": F.col("avg_temperature_c") < 20,
        "hot": F.col("avg_temperature_c") > 40,
    }
    means = cells.agg(*[F.round(F.avg(F.when(cond, F.col("soh"))), 4).alias(name) for name, cond in bands.items()])
    return means.withColumns(
        {"cycles_age": F.col("many_cycles") < F.col("few_cycles"), "heat_ages": F.col("hot") < F.col("cool")}
    )


def sample_count(spark: SparkSession, folder: str) -> DataFrame:
    return views.cell_samples(spark, folder).agg(F.count(F.lit(1)).alias("n_samples"))


def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.labelled_cells(spark, folder).withColumn("predicted_soh", physics_soh())
    metrics = ops.regression_metrics(scored, "soh", "predicted_soh")
    return metrics.select("n", *[F.round(m, 6).alias(m) for m in ("mae", "rmse", "r2")])


def request_validity(spark: SparkSession, folder: str) -> DataFrame:
    scoring = views.unchecked_requests(spark, folder).select(
        F.lit("predict").alias("endpoint"), ops.score_request_problems().alias("problems")
    )
    asking = table(spark, folder, "conversations").where("role = 'user'").select(
        F.lit("ask").alias("endpoint"),
        F.when(F.expr("(conv_id*5+turn)%11 = 0"), F.lit("")).otherwise(F.col("text")).alias("question"),
        F.expr("(conv_id*3+turn)%24-1").alias("k"),
    ).select("endpoint", ops.question_problems("question", "k").alias("problems"))
    return (
        scoring.unionByName(asking)
        .groupBy("endpoint", F.array_join("problems", "|").alias("problems"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("accepted", F.col("problems") == "")
    )


def site_limits(spark: SparkSession, folder: str) -> DataFrame:
    """End-of-life limit per site: the conventional one, tightened by the site's nation."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("site_key"),
        F.col("s_nationkey").alias("nation_key"),
        (F.lit(END_OF_LIFE_SOH) + F.col("s_nationkey") % 5).alias("eol_threshold"),
    )


def serviceability(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.cell_samples(spark, folder).select("site_key", physics_soh().alias("predicted_soh"))
    judged = ops.serviceability(scored, site_limits(spark, folder), "site_key")
    return judged.groupBy("nation_key", "eol_threshold").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if("retire").alias("n_retire"),
        F.round(F.min("margin"), 4).alias("worst_margin"),
        F.round(F.avg("margin"), 4).alias("mean_margin"),
    )


def latest_model(spark: SparkSession, folder: str) -> DataFrame:
    registry = table(spark, folder, "orders").select(
        F.concat(F.lit("soh-"), F.col("o_orderpriority")).alias("model"),
        F.col("o_orderkey").cast("string").alias("version"),
        F.concat(F.lit("run-"), F.col("o_custkey")).alias("run_id"),
    )
    return ops.latest_versions(registry)


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    """The arithmetic split: the hash split is the library's, this one SQL can repeat."""
    cells = views.labelled_cells(spark, folder).withColumn(
        "is_test", (F.col("order_key") * 2654435761 + F.lit(SEED)) % 1000 < int(TEST_SHARE * 1000)
    )
    return cells.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("soh"), 4).alias("mean_soh"), F.max("cycle_count").alias("max_cycles")
    )


def recent_predictions(spark: SparkSession, folder: str) -> DataFrame:
    newest = drift.recent(views.score_requests(spark, folder))
    return newest.select("event_id", *views.RAW_INPUTS)


def _drift(spark: SparkSession, folder: str) -> DataFrame:
    current = drift.recent(views.score_requests(spark, folder))
    return drift.drift_between(views.cell_samples(spark, folder), current)


def drift_columns(spark: SparkSession, folder: str) -> DataFrame:
    stats = _drift(spark, folder)
    return stats.select(
        "column", "ref_rows", "cur_rows", *[F.round(c, 6).alias(c) for c in ("ks", "wasserstein", "psi")], "drifted"
    )


def drift_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = drift.drift_summary(_drift(spark, folder)).drop("current_rows")
    return summary.withColumn("share_of_drifted_columns", F.round("share_of_drifted_columns", 6))


def drift_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's requests against the training inputs."""
    requests = views.score_requests(spark, folder).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    current = drift.value_counts(requests, "current", ["day"])
    reference = drift.value_counts(views.cell_samples(spark, folder), "reference")
    return daily_report(reference, current)


def daily_report(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Drift per day from value counts of both sides."""
    stats = drift.period_drift(reference, current, "day")
    return stats.select(
        "day", "column", "ref_rows", "cur_rows", *[F.round(c, 6).alias(c) for c in ("ks", "wasserstein", "psi")], "drifted"
    )


def seed_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Replace-write the samples, read them back, and report what was stored."""
    cells = views.labelled_cells(spark, folder).select("cell_id", *views.RAW_INPUTS, "soh")
    stored = sinks.replace_table(spark, cells, "samples")
    return stored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum("cycle_count"), 3).alias("cycles"),
        F.round(F.avg("soh"), 6).alias("mean_soh"),
    )


def prediction_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log after a batch that ran twice and a batch of the next version; the noiseless label stands in for the model."""
    scored = views.score_requests(spark, folder).withColumn("predicted_soh", physics_soh())
    path = staging_path(spark, "log")
    for batch, version in (("1", "7"), ("1", "7"), ("2", "8")):
        sinks.commit_batch(sinks.prediction_log(scored, version, "event_id", key="event_id", batch=batch), path, batch)
    return sinks.read_log(spark, path).select("id", "event_id", *views.RAW_INPUTS, "predicted_soh", "model_version")


QUERIES = {
    "prediction_log": prediction_log,
    "soh_features": soh_features,
    "soh_physics": soh_physics,
    "soh_bands": soh_bands,
    "sample_count": sample_count,
    "regression_metrics": regression_metrics,
    "request_validity": request_validity,
    "serviceability": serviceability,
    "latest_model": latest_model,
    "train_test_split": train_test_split,
    "recent_predictions": recent_predictions,
    "drift_columns": drift_columns,
    "drift_summary": drift_summary,
    "drift_daily": drift_daily,
    "seed_roundtrip": seed_roundtrip,
}

_STRESS = "power(2e0, (avg_temperature_c-25e0)/1e1)"
_NOISELESS = (
    "round(least(1e2, greatest(7e1, 1e2 - 15e-4*(cycle_count*avg_dod)*sqrt(avg_c_rate)*" + _STRESS
    + " - 5e-2*sqrt(calendar_age_days)*" + _STRESS + ")), 3)"
)


def _unpivot(source: str, keys: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys} '{c}' AS \"column\", {c} AS value FROM {source}" for c in views.RAW_INPUTS
    )


def _drift_sql(keys: str, ref: str, cur: str) -> str:
    """CTEs from ``ref`` and ``cur`` (keys, value) to ``stats``, with plain windows."""
    return f"""
    counts AS (
      SELECT {keys}, value, sum(r) AS n_ref, sum(c) AS n_cur FROM (
        SELECT {keys}, value, 1 AS r, 0 AS c FROM {ref} UNION ALL SELECT {keys}, value, 0, 1 FROM {cur}
      ) GROUP BY {keys}, value),
    totals AS (
      SELECT {keys}, sum(n_ref) AS ref_rows, sum(n_cur) AS cur_rows,
        sqrt(sum(value*value*n_ref)/sum(n_ref) - power(sum(value*n_ref)/sum(n_ref), 2)) AS ref_std
      FROM counts GROUP BY {keys}),
    placed AS (
      SELECT *, sum(n_ref) OVER w AS f, sum(n_cur) OVER w AS g,
        coalesce(lead(value) OVER (PARTITION BY {keys} ORDER BY value) - value, 0) AS step
      FROM counts JOIN totals USING ({keys})
      WINDOW w AS (PARTITION BY {keys} ORDER BY value ROWS UNBOUNDED PRECEDING)),
    gaps AS (
      SELECT *, abs(f/ref_rows::DOUBLE - g/cur_rows::DOUBLE) AS gap,
        least(9, floor(1e1*(f-n_ref)/ref_rows)) AS decile FROM placed),
    bins AS (
      SELECT {keys}, ref_rows, cur_rows, ref_std, decile, max(gap) AS ks, sum(gap*step) AS area,
        greatest(sum(n_ref)/max(ref_rows)::DOUBLE, 1e-4) AS p, greatest(sum(n_cur)/max(cur_rows)::DOUBLE, 1e-4) AS q
      FROM gaps GROUP BY ALL),
    stats AS (
      SELECT {keys}, ref_rows::BIGINT AS ref_rows, cur_rows::BIGINT AS cur_rows, max(ks) AS ks,
        sum(area)/ref_std AS wasserstein, sum((q-p)*ln(q/p)) AS psi,
        max(ks) > {KS_CRITICAL}::DOUBLE*sqrt((ref_rows+cur_rows)/(ref_rows::DOUBLE*cur_rows)) AS drifted
      FROM bins GROUP BY {keys}, ref_rows, cur_rows, ref_std)
    """


_RECENT = "recent AS (SELECT * FROM score_requests ORDER BY created_at DESC, event_id DESC LIMIT 500)"
_DRIFT = (
    f"{_RECENT}, ref AS ({_unpivot('cell_samples')}), cur AS ({_unpivot('recent')}), "
    + _drift_sql('"column"', "ref", "cur")
)
_ROUNDED = "ref_rows, cur_rows, round(ks,6) AS ks, round(wasserstein,6) AS wasserstein, round(psi,6) AS psi, drifted"

ORACLES = {
    "prediction_log": with_views(
        ["score_requests"],
        f"""b AS (SELECT * FROM (VALUES ('1', '7'), ('2', '8')) v(batch, model_version))
        SELECT ('0x' || substr(md5(event_id || '|' || model_version || '|' || batch), 1, 15))::BIGINT AS id, event_id, {', '.join(views.RAW_INPUTS)},
          {_NOISELESS} AS predicted_soh, model_version FROM score_requests, b""",
    ),
    "soh_features": with_views(
        ["cell_samples", "labelled_cells"],
        "SELECT cell_id, soh, round(cycle_count,6) AS cycle_count, round(avg_temperature_c,6) AS avg_temperature_c,"
        " round(avg_dod,6) AS avg_dod, round(avg_c_rate,6) AS avg_c_rate,"
        " round(calendar_age_days,6) AS calendar_age_days,"
        " round(cycle_count*avg_dod,6) AS equivalent_full_cycles,"
        f" round({_STRESS},6) AS temperature_stress, round(sqrt(calendar_age_days),6) AS calendar_stress"
        " FROM labelled_cells",
    ),
    "soh_physics": with_views(
        ["cell_samples", "labelled_cells"], f"SELECT cell_id, soh, {_NOISELESS} AS noiseless_soh FROM labelled_cells"
    ),
    "soh_bands": with_views(
        ["cell_samples", "labelled_cells"],
        """m AS (SELECT round(avg(soh) FILTER (WHERE cycle_count < 500), 4) AS few_cycles,
            round(avg(soh) FILTER (WHERE cycle_count > 2500), 4) AS many_cycles,
            round(avg(soh) FILTER (WHERE avg_temperature_c < 20), 4) AS cool,
            round(avg(soh) FILTER (WHERE avg_temperature_c > 40), 4) AS hot FROM labelled_cells)
        SELECT *, many_cycles < few_cycles AS cycles_age, hot < cool AS heat_ages FROM m""",
    ),
    "sample_count": "SELECT count(*) AS n_samples FROM lineitem",
    "regression_metrics": with_views(
        ["cell_samples", "labelled_cells"],
        f"""p AS (SELECT soh, {_NOISELESS} AS predicted FROM labelled_cells)
        SELECT count(*) AS n, round(avg(abs(soh-predicted)),6) AS mae, round(sqrt(avg((soh-predicted)**2)),6) AS rmse,
          round(1 - sum((soh-predicted)**2)/(var_pop(soh)*count(*)),6) AS r2 FROM p""",
    ),
    "request_validity": with_views(
        ["unchecked_requests"],
        """r AS (
          SELECT 'predict' AS endpoint, concat_ws('|', CASE WHEN cycle_count>=0 AND NOT isnan(cycle_count) THEN NULL ELSE 'cycle_count' END,
            CASE WHEN avg_temperature_c IS NULL OR isnan(avg_temperature_c) THEN 'avg_temperature_c' END,
            CASE WHEN avg_dod>=0 AND avg_dod<=1 THEN NULL ELSE 'avg_dod' END,
            CASE WHEN avg_c_rate>=0 AND NOT isnan(avg_c_rate) THEN NULL ELSE 'avg_c_rate' END,
            CASE WHEN calendar_age_days>=0 AND NOT isnan(calendar_age_days) THEN NULL ELSE 'calendar_age_days' END) AS problems
            FROM unchecked_requests
          UNION ALL
          SELECT 'ask', concat_ws('|', CASE WHEN length(CASE WHEN (conv_id*5+turn)%11=0 THEN '' ELSE text END)<1
            THEN 'question' END, CASE WHEN NOT ((conv_id*3+turn)%24-1 BETWEEN 1 AND 20) THEN 'k' END)
          FROM conversations WHERE role='user')
        SELECT endpoint, problems, count(*) AS n, problems='' AS accepted FROM r GROUP BY ALL""",
    ),
    "serviceability": with_views(
        ["cell_samples"],
        f"""j AS (SELECT s_nationkey AS nation_key, 8e1+s_nationkey%5 AS eol_threshold, {_NOISELESS} AS predicted
          FROM cell_samples LEFT JOIN supplier ON site_key = s_suppkey)
        SELECT nation_key, eol_threshold, count(*) AS n_cells, count(*) FILTER (WHERE predicted < eol_threshold) AS n_retire,
          round(min(predicted-eol_threshold),4) AS worst_margin, round(avg(predicted-eol_threshold),4) AS mean_margin
        FROM j GROUP BY nation_key, eol_threshold""",
    ),
    "latest_model": """SELECT 'soh-' || o_orderpriority AS model, arg_max(o_orderkey::VARCHAR, o_orderkey) AS version,
        arg_max('run-' || o_custkey, o_orderkey) AS run_id, count(*) AS n_versions FROM orders GROUP BY 1""",
    "train_test_split": with_views(
        ["cell_samples", "labelled_cells"],
        f"""SELECT (order_key*2654435761+{SEED})%1000 < 200 AS is_test, count(*) AS n, round(avg(soh),4) AS mean_soh,
          max(cycle_count) AS max_cycles FROM labelled_cells GROUP BY 1""",
    ),
    "recent_predictions": with_views(
        ["score_requests"],
        f"{_RECENT} SELECT event_id, {', '.join(views.RAW_INPUTS)} FROM recent",
    ),
    "drift_columns": with_views(
        ["cell_samples", "score_requests"], f'{_DRIFT} SELECT "column", {_ROUNDED} FROM stats'
    ),
    "drift_summary": with_views(
        ["cell_samples", "score_requests"],
        f"""{_DRIFT}, s AS (SELECT count(*) AS number_of_columns, count(*) FILTER (WHERE drifted) AS number_of_drifted_columns
          FROM stats)
        SELECT number_of_columns, number_of_drifted_columns,
          round(number_of_drifted_columns/number_of_columns::DOUBLE,6) AS share_of_drifted_columns,
          number_of_drifted_columns/number_of_columns::DOUBLE >= 5e-1 AS dataset_drift,
          number_of_drifted_columns/number_of_columns::DOUBLE > 5e-1 AS alert FROM s""",
    ),
    "drift_daily": with_views(
        ["cell_samples", "score_requests"],
        f"""daily AS (SELECT *, strftime(created_at,'%Y-%m-%d') AS day FROM score_requests),
        cur AS ({_unpivot('daily', 'day,')}), ref1 AS ({_unpivot('cell_samples')}),
        refc AS (SELECT "column", value, count(*) AS n FROM ref1 GROUP BY ALL),
        days AS (SELECT DISTINCT day FROM daily),
        """
        + _drift_sql('day, "column"', "REF", "cur").replace(
            'SELECT day, "column", value, 1 AS r, 0 AS c FROM REF',
            'SELECT day, "column", value, n AS r, 0 AS c FROM refc, days',
        )
        + f' SELECT day, "column", {_ROUNDED} FROM stats',
    ),
    "seed_roundtrip": with_views(
        ["cell_samples", "labelled_cells"],
        "SELECT count(*) AS n_rows, round(sum(cycle_count),3) AS cycles, round(avg(soh),6) AS mean_soh FROM labelled_cells",
    ),
}
