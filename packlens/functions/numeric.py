"""Numeric column expressions: stress features, the ageing formula, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where nothing was counted."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def temperature_stress(temperature: Column) -> Column:
    """Ageing speed relative to 25 degrees: doubles every 10 degrees."""
    return F.pow(F.lit(2.0), (temperature - 25.0) / 10.0)


def stress_features() -> dict[str, Column]:
    return {
        "equivalent_full_cycles": F.col("cycle_count") * F.col("avg_dod"),
        "temperature_stress": temperature_stress(F.col("avg_temperature_c")),
        "calendar_stress": F.sqrt("calendar_age_days"),
    }


def physics_soh(noise: Column | None = None) -> Column:
    """State of health from cycle fade and calendar fade, within 70 to 100, to 3 places."""
    stress = temperature_stress(F.col("avg_temperature_c"))
    cycles = F.lit(0.0015) * (F.col("cycle_count") * F.col("avg_dod")) * F.sqrt("avg_c_rate") * stress
    calendar = F.lit(0.05) * F.sqrt("calendar_age_days") * stress
    healthy = F.lit(100.0) - cycles - calendar
    if noise is not None:
        healthy = healthy + noise
    return F.round(clamp(healthy, 70.0, 100.0), 3)
