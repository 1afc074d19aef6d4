"""Running totals over groups that may be too large for one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: list[str],
    slice_of: Column,
    following: bool = False,
) -> DataFrame:
    """Add ``run_<measure>`` (inclusive running sums in ``order``) per ``keys``.

    A window over ``keys`` alone would put a hot key into one task. Here rows are cut into
    slices first (``slice_of`` must not decrease with ``order``), slice totals are summed over
    slices, and the row-level window runs per (keys, slice). With ``following`` the next
    value of ``order`` within the keys is added as ``next_<order>``.
    """
    sliced = df.withColumn("_slice", slice_of)
    per_slice = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(m).alias(f"_sum_{m}") for m in measures], F.min(order).alias("_first")
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        F.lead("_first").over(by_slice).alias("_next_first"),
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = join_null_safe(sliced, offsets, [*keys, "_slice"])
    columns = {f"run_{m}": F.sum(m).over(upto) + F.col(f"_before_{m}") for m in measures}
    if following:
        columns[f"next_{order}"] = F.coalesce(F.lead(order).over(inner), F.col("_next_first"))
    return out.withColumns(columns).drop("_slice", "_next_first", *[f"_before_{m}" for m in measures])


def next_known(df: DataFrame, keys: list[str], order: list[str], known: list[str], slice_of: Column) -> DataFrame:
    """Add ``at_<known>``: of the first row at or after each row in ``order`` (within ``keys``) whose ``known`` are not null.

    Slices (``slice_of`` must not decrease with ``order``) are searched side by side; where a slice
    holds none after a row, the first one of a later slice is taken.
    """
    sliced = df.withColumns({"_slice": slice_of, "_known": F.when(F.col(known[0]).isNotNull(), F.struct(*known))})
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.min_by("_known", F.when(F.col("_known").isNotNull(), F.struct(*order))).alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    offers = per_slice.select(*keys, "_slice", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = join_null_safe(sliced, offers, [*keys, "_slice"])
    found = F.coalesce(F.first("_known", ignorenulls=True).over(inner), F.col("_later"))
    return out.withColumn("_found", found).withColumns({f"at_{k}": F.col("_found")[k] for k in known}).drop("_slice", "_known", "_later", "_found")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` that matches nulls with nulls."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, reduce(and_, same)).drop(*[f"_right_{k}" for k in keys])


# Cut points of a group's values, and the rows up to which a group is not cut at all.
CUTS = 63
ONE_SLICE_ROWS = 100_000


def placed_counts(counts: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """Value counts in order: ``run_<measure>``, ``total_<measure>`` and ``next_<value>`` per keys.

    Exact quantiles and distribution distances read off this table without holding a group's
    rows together: a group of many values is cut at its own quantiles, so slices hold about the
    same number of rows however the values are spread. Null keys form a group, null values come
    first. ``counts`` is read more than once and should be staged. Where no group is that large, one
    shuffle by the keys and one window do it all; the result is the same.
    """
    large = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > ONE_SLICE_ROWS)
    if large.isEmpty():
        return _placed_at_once(counts, keys, value, measures)
    share = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    profile = counts.groupBy(*keys).agg(
        *[F.sum(m).alias(f"total_{m}") for m in measures],
        F.count(F.lit(1)).alias("_rows"),
        F.percentile_approx(value, share, 10_000).alias("_cuts"),
    )
    placed = join_null_safe(counts, profile, keys)
    own = F.size(F.filter("_cuts", lambda c: c <= F.col(value)))
    slice_of = F.when((F.col("_rows") <= ONE_SLICE_ROWS) | F.col("_cuts").isNull(), F.lit(0)).otherwise(own)
    return running_totals(placed, keys, value, measures, slice_of, following=True).drop("_rows", "_cuts")


def _placed_at_once(counts: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """The same columns from a window over each whole group."""
    group = Window.partitionBy(*keys).orderBy(value)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {f"total_{m}": F.sum(m).over(whole) for m in measures} | {f"run_{m}": F.sum(m).over(upto) for m in measures}
    return counts.withColumns({**columns, f"next_{value}": F.lead(value).over(group)})


def value_at(position: Column, value: str, n: str) -> Column:
    """Aggregate: the value at 1-based ``position`` of a group's sorted rows."""
    covers = (F.col(f"run_{n}") >= position) & (F.col(f"run_{n}") - F.col(n) < position)
    return F.max(F.when(covers, F.col(value)))


def interpolated(position: Column, value: str, n: str) -> Column:
    """Aggregate: the value at a fractional 1-based position, by straight-line interpolation."""
    low = value_at(F.floor(position), value, n)
    high = F.coalesce(value_at(F.floor(position) + 1, value, n), low)
    part = F.max(position - F.floor(position))
    return low + (high - low) * part
