"""Checks of a table against its declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The prediction log.
PREDICTION_LOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("cycle_count", T.DoubleType()),
        T.StructField("avg_temperature_c", T.DoubleType()),
        T.StructField("avg_dod", T.DoubleType()),
        T.StructField("avg_c_rate", T.DoubleType()),
        T.StructField("calendar_age_days", T.DoubleType()),
        T.StructField("predicted_soh", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
    ]
)


def schema_differences(actual: T.StructType, declared: T.StructType) -> dict[str, str]:
    """Column -> ok, missing, extra or the type found instead of the declared one."""
    have = {f.name: f.dataType.simpleString() for f in actual}
    want = {f.name: f.dataType.simpleString() for f in declared}
    verdicts = {}
    for name in [*want, *[n for n in have if n not in want]]:
        if name not in have:
            verdicts[name] = "missing"
        elif name not in want:
            verdicts[name] = "extra"
        else:
            verdicts[name] = "ok" if have[name] == want[name] else f"type {have[name]}"
    return verdicts


def check_contract(rows: DataFrame, declared: T.StructType) -> DataFrame:
    """One row per column: schema verdict, values that are null, and values no declared type holds.

    The counts come from one pass over the table.
    """
    verdicts = schema_differences(rows.schema, declared)
    fields = {f.name: f for f in declared}
    none = F.lit(0).cast("bigint")
    aggregates, lines = [F.count(F.lit(1)).alias("n_rows")], []
    for name, verdict in verdicts.items():
        nulls, uncastable = none, none
        if verdict not in ("missing",):
            aggregates.append(F.count_if(F.col(name).isNull()).alias(f"null_{name}"))
            nulls = F.col(f"null_{name}")
        if verdict.startswith("type"):
            lost = F.col(name).isNotNull() & F.col(name).try_cast(fields[name].dataType).isNull()
            aggregates.append(F.count_if(lost).alias(f"lost_{name}"))
            uncastable = F.col(f"lost_{name}")
        required = name in fields and not fields[name].nullable
        broken = F.lit(verdict == "missing") if required else F.lit(False)
        lines.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(verdict).alias("verdict"),
                nulls.alias("n_null"),
                uncastable.alias("n_uncastable"),
                (broken | (F.lit(required) & (nulls > 0))).alias("required_broken"),
            )
        )
    return rows.agg(*aggregates).select("n_rows", F.explode(F.array(*lines)).alias("line")).select("line.*", "n_rows")
