"""Distribution drift of scoring inputs against the training inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packlens.functions.numeric import ratio
from packlens.functions.windows import CUTS, next_known, placed_counts
from packlens.settings import DRIFT_SHARE, KS_CRITICAL, RECENT_LIMIT
from packlens.sources.cells import RAW_INPUTS
from packlens.sources.sinks import staged


def recent(requests: DataFrame, n: int | None = RECENT_LIMIT) -> DataFrame:
    """The newest ``n`` logged requests, all of them when ``n`` is None."""
    if n is None:
        return requests
    return requests.orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)


def value_counts(df: DataFrame, side: str, keys: list[str] | None = None, columns=RAW_INPUTS) -> DataFrame:
    """(column, value) counts of one side; the other side's count is 0."""
    keys = keys or []
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("cell"),
    ).where(F.col("cell.value").isNotNull())
    counted = long.groupBy(*keys, "cell.column", "cell.value").agg(F.count(F.lit(1)).alias("n"))
    is_reference = side == "reference"
    return counted.select(
        *keys,
        "column",
        "value",
        (F.col("n") if is_reference else F.lit(0).cast("bigint")).alias("n_ref"),
        (F.lit(0).cast("bigint") if is_reference else F.col("n")).alias("n_cur"),
    )


def column_drift(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sample statistics per ``keys`` from (value, n_ref, n_cur) counts.

    KS distance, Wasserstein-1 over the reference's standard deviation, and PSI over
    reference deciles. ``drifted`` is the KS decision at the 5 % critical value.
    """
    merged = counts.groupBy(*keys, "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    # Read three times below; staged so the tables behind the counts are scanned once.
    merged = staged(merged, "value-counts")
    placed = placed_counts(merged, keys, "value", ["n_ref", "n_cur"]).withColumnsRenamed(
        {"total_n_ref": "ref_rows", "total_n_cur": "cur_rows"}
    )
    gap = F.abs(
        F.try_divide(F.col("run_n_ref"), F.col("ref_rows")) - F.try_divide(F.col("run_n_cur"), F.col("cur_rows"))
    )
    reached = F.try_divide(F.lit(10.0) * (F.col("run_n_ref") - F.col("n_ref")), F.col("ref_rows"))
    decile = F.least(F.lit(9), F.floor(reached)).cast("int")
    binned = placed.withColumns(
        {"gap": gap, "step": F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0)), "decile": decile}
    )
    weighted = F.col("value") * F.col("n_ref")
    per_bin = binned.groupBy(*keys, "ref_rows", "cur_rows", "decile").agg(
        F.max("gap").alias("ks"),
        F.sum(F.col("gap") * F.col("step")).alias("area"),
        F.sum(weighted).alias("sum_ref"),
        F.sum(F.col("value") * weighted).alias("squares_ref"),
        F.greatest(F.try_divide(F.sum("n_ref"), F.max("ref_rows")), F.lit(1e-4)).alias("p_ref"),
        F.greatest(F.try_divide(F.sum("n_cur"), F.max("cur_rows")), F.lit(1e-4)).alias("p_cur"),
    )
    mean = F.try_divide(F.sum("sum_ref"), F.col("ref_rows"))
    variance = F.try_divide(F.sum("squares_ref"), F.col("ref_rows")) - mean * mean
    stats = per_bin.groupBy(*keys, "ref_rows", "cur_rows").agg(
        F.max("ks").alias("ks"),
        F.sum("area").alias("area"),
        F.sqrt(variance).alias("ref_std"),
        F.sum((F.col("p_cur") - F.col("p_ref")) * F.log(F.col("p_cur") / F.col("p_ref"))).alias("psi"),
    )
    limit = F.lit(KS_CRITICAL) * F.sqrt(
        F.try_divide(F.col("ref_rows") + F.col("cur_rows"), F.col("ref_rows").cast("double") * F.col("cur_rows"))
    )
    return stats.select(
        *keys,
        "ref_rows",
        "cur_rows",
        "ks",
        F.try_divide(F.col("area"), F.col("ref_std")).alias("wasserstein"),
        "psi",
        (F.col("ks") > limit).alias("drifted"),
    )


BINS = 10


def _in_bins(bin_of: Column, n: Column) -> Column:
    """Aggregate: the sums of ``n`` in each decile; null where a decile has no row."""
    return F.array(*[F.sum(F.when(bin_of == i, n)) for i in range(BINS)])


def period_drift(reference: DataFrame, current: DataFrame, period: str, columns=RAW_INPUTS) -> DataFrame:
    """The statistics of ``column_drift`` for the values of each period, without repeating the reference per period.

    ``reference`` (column, value, n_ref), ``current`` (period, column, value, n_cur), a row for each value.
    The reference is placed once, at its own values and those of all periods: how many rows lie up to a value, and
    their sum, which give the distribution and its integral there. Between two neighbouring values of a period its own
    distribution is constant and the reference's rises, so the largest distance lies at an end, and the area between
    them follows from the integral at both ends and at the value where the two cross, which is looked up by count.
    Work after the placing grows with the periods' values alone.
    """
    current = staged(current.groupBy(period, "column", "value").agg(F.sum("n_cur").alias("n_cur")), "period-counts")
    nothing = F.lit(0).cast("bigint")
    both = reference.select("column", "value", "n_ref").unionByName(current.select("column", "value").distinct().withColumn("n_ref", nothing))
    values = both.groupBy("column", "value").agg(F.sum("n_ref").alias("n_ref")).withColumn("sum_ref", F.col("value") * F.col("n_ref"))
    placed = staged(placed_counts(staged(values, "reference-values"), ["column"], "value", ["n_ref", "sum_ref"]), "reference-places")

    bin_of = F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.lit(float(BINS)) * (F.col("run_n_ref") - F.col("n_ref")), F.col("total_n_ref"))))
    own = placed.where("n_ref > 0")
    mean = F.sum("sum_ref") / F.sum("n_ref")
    facts = own.groupBy("column").agg(
        F.sum("n_ref").alias("ref_rows"),
        F.max("value").alias("ref_top"),
        F.sum("sum_ref").alias("ref_sum"),
        F.sqrt(F.sum(F.col("value") * F.col("sum_ref")) / F.sum("n_ref") - mean * mean).alias("ref_std"),
        _in_bins(bin_of, F.col("n_ref")).alias("ref_bins"),
    )
    # A place as (rows below, rows up to it, integral of the rows up to it).
    place = F.struct(
        (F.col("run_n_ref") - F.col("n_ref")).alias("below"), F.col("run_n_ref").alias("upto"),
        (F.col("run_n_ref") * F.col("value") - F.col("run_sum_ref")).alias("area"), bin_of.alias("bin"),
    )
    places = placed.select(F.col("column"), F.col("value"), place.alias("here"))
    ends = places.withColumnsRenamed({"value": "next_value", "here": "there"})
    rows = placed_counts(current, [period, "column"], "value", ["n_cur"]).join(places, ["column", "value"]).join(ends, ["column", "next_value"], "left")
    rows = rows.join(facts, "column").withColumns(
        {
            "g": F.col("run_n_cur") / F.col("total_n_cur"),
            "g_before": (F.col("run_n_cur") - F.col("n_cur")) / F.col("total_n_cur"),
            # After a period's last value the reference goes on to its own last one.
            "b": F.coalesce("next_value", F.greatest("ref_top", "value")),
            "b_area": F.coalesce(F.col("there.area"), F.col("ref_rows") * F.greatest("ref_top", "value") - F.col("ref_sum")),
            "b_below": F.coalesce(F.col("there.below"), F.col("ref_rows")),
        }
    )
    rows = staged(rows.withColumn("mark", F.col("g") * F.col("ref_rows")), "period-places")
    crossing = (F.col("here.upto") < F.col("mark")) & (F.col("b_below") > F.col("mark"))
    part = F.floor(F.col("at") * CUTS / F.col("rows"))
    marks = rows.where(crossing).select(
        "column", F.col("mark").alias("at"), F.col("ref_rows").alias("rows"), F.lit(0).alias("kind"), F.struct(period, "value").alias("row"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("x_area")
    )
    steps = own.select(
        "column", F.col("run_n_ref").cast("double").alias("at"), F.col("total_n_ref").alias("rows"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["row"].dataType).alias("row"),
        F.col("value").alias("x"), (F.col("run_n_ref") * F.col("value") - F.col("run_sum_ref")).alias("x_area"),
    )
    met = next_known(marks.unionByName(steps), ["column"], ["at", "kind"], ["x", "x_area"], part).where("kind = 0")
    met = met.select("column", F.col(f"row.{period}").alias(period), F.col("row.value").alias("value"), F.col("at_x").alias("x"), F.col("at_x_area").alias("x_area"))
    rows = rows.join(met, ["column", period, "value"], "left")
    n, g, a, b = F.col("ref_rows"), F.col("g"), F.col("value"), F.col("b")
    rising = (F.col("b_area") - F.col("here.area")) / n
    flat = g * (b - a)
    area = (
        F.when(F.col("x").isNotNull(), g * (F.col("x") - a) - (F.col("x_area") - F.col("here.area")) / n + (F.col("b_area") - F.col("x_area")) / n - g * (b - F.col("x")))
        .when(F.col("here.upto") >= F.col("mark"), rising - flat)
        .otherwise(flat - rising)
    )
    lead_in = F.when(F.col("run_n_cur") == F.col("n_cur"), F.col("here.area") / n).otherwise(0.0)
    stats = rows.groupBy(period, "column").agg(
        F.max("total_n_cur").alias("cur_rows"),
        F.max(F.greatest(F.abs(F.col("here.upto") / n - g), F.abs(F.col("here.below") / n - F.col("g_before")))).alias("ks"),
        F.sum(area + lead_in).alias("area"),
        _in_bins(F.col("here.bin"), F.col("n_cur")).alias("cur_bins"),
    )
    every = current.select(period).distinct().withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns]))).join(facts.drop("ref_top", "ref_sum"), "column")
    full = every.join(stats, [period, "column"], "left").withColumn("cur_rows", F.coalesce("cur_rows", nothing))

    def surprise(ref: Column, cur: Column) -> Column:
        p = F.greatest(ref / F.col("ref_rows"), F.lit(1e-4))
        q = F.greatest(F.try_divide(cur, F.col("cur_rows")), F.lit(1e-4))
        return F.when(ref.isNull() & cur.isNull(), 0.0).otherwise((q - p) * F.log(q / p))

    none = F.array().cast("array<bigint>")
    psi = F.aggregate(F.zip_with("ref_bins", F.coalesce("cur_bins", none), surprise), F.lit(0.0), lambda total, x: total + x)
    limit = F.lit(KS_CRITICAL) * F.sqrt(F.try_divide(F.col("ref_rows") + F.col("cur_rows"), F.col("ref_rows").cast("double") * F.col("cur_rows")))
    return full.select(
        period, "column", "ref_rows", "cur_rows", "ks", F.try_divide(F.col("area"), F.col("ref_std")).alias("wasserstein"), psi.alias("psi"), (F.col("ks") > limit).alias("drifted")
    )


def drift_between(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Per-column drift of ``current`` against ``reference``."""
    counts = value_counts(reference, "reference").unionByName(value_counts(current, "current"))
    return column_drift(counts.where(F.col("value").isNotNull()), ["column"])


def drift_summary(columns: DataFrame, share_threshold: float = DRIFT_SHARE) -> DataFrame:
    """One row: how many columns drifted, and whether to alert. Fails on an empty current side."""
    summary = columns.agg(
        F.count(F.lit(1)).alias("number_of_columns"),
        F.count_if("drifted").alias("number_of_drifted_columns"),
        F.coalesce(F.min("cur_rows"), F.lit(0)).alias("current_rows"),
    )
    empty = F.raise_error(F.lit("no logged requests to compare with the training inputs")).cast("double")
    share = F.when(
        F.col("current_rows") > 0, ratio(F.col("number_of_drifted_columns"), F.col("number_of_columns"))
    ).otherwise(empty)
    return summary.withColumns(
        {
            "share_of_drifted_columns": share,
            "dataset_drift": share >= 0.5,
            "alert": share > share_threshold,
        }
    )
