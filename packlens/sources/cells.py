"""Battery views over the test tables.

``lineitem`` rows stand in for measured cells and ``events`` rows for scoring requests. Each
view is a list of select expressions that Spark SQL and DuckDB read alike, so the queries and
their SQL checks start from the same rows. Literals carry an exponent to stay doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packlens.sources.tables import events, table

RAW_INPUTS = ("cycle_count", "avg_temperature_c", "avg_dod", "avg_c_rate", "calendar_age_days")

CELL_EXPRESSIONS = (
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),"
    " cast(l_partkey as string), cast(l_suppkey as string)) as cell_id",
    "cast((l_orderkey*7919+l_linenumber*104729)%3000 as double) as cycle_count",
    "15e0+((l_partkey*31+l_linenumber*17)%3001)/1e2 as avg_temperature_c",
    "2e-1+((l_suppkey*263+l_orderkey*29)%8001)/1e4 as avg_dod",
    "2e-1+((l_orderkey*13+l_partkey*7)%18001)/1e4 as avg_c_rate",
    "((l_partkey*53+l_orderkey*11)%15001)/1e1 as calendar_age_days",
    "(((l_orderkey*97+l_linenumber*389)%2001)-1000)/1e3 as noise",
    "l_orderkey as order_key",
    "l_suppkey as site_key",
)

SOH_EXPRESSION = (
    "round(least(1e2, greatest(7e1, 1e2"
    " - 15e-4*(cycle_count*avg_dod)*sqrt(avg_c_rate)*power(2e0, (avg_temperature_c-25e0)/1e1)"
    " - 5e-2*sqrt(calendar_age_days)*power(2e0, (avg_temperature_c-25e0)/1e1)"
    " + noise)), 3)"
)

REQUEST_EXPRESSIONS = (
    "event_id",
    "ts as created_at",
    "cast((event_id*7919)%3000+2500 as double) as cycle_count",
    "55e0+((user_id*31+event_id*17)%3001)/1e2 as avg_temperature_c",
    "2e-1+((user_id*263+event_id*29)%8001)/1e4 as avg_dod",
    "2e-1+((event_id*7919+user_id*7)%18001)/1e4 as avg_c_rate",
    "1500e0+((event_id*53+user_id*11)%15001)/1e1 as calendar_age_days",
)

# The same requests before validation: some fall outside the accepted ranges.
UNCHECKED_EXPRESSIONS = (
    "event_id",
    "case when event_id%101<>7 then cast((event_id*7919)%3000-100 as double) end as cycle_count",
    "case event_id%103 when 5 then cast('NaN' as double) when 6 then null else 55e0+((user_id*31+event_id*17)%3001)/1e2 end as avg_temperature_c",
    "case when event_id%107<>9 then ((user_id*263+event_id*29)%12001)/1e4 else cast('NaN' as double) end as avg_dod",
    "case when event_id%109<>11 then ((event_id*7919+user_id*7)%18001)/1e4-1e-1 end as avg_c_rate",
    "((event_id*53+user_id*11)%15001)/1e1-2e1 as calendar_age_days",
)


def cell_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Raw cell measurements with a repeatable noise term."""
    return table(spark, folder, "lineitem").selectExpr(*CELL_EXPRESSIONS)


def labelled_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cell measurements with their measured state of health."""
    return cell_samples(spark, folder).selectExpr("*", f"{SOH_EXPRESSION} as soh")


def score_requests(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).selectExpr(*REQUEST_EXPRESSIONS)


def unchecked_requests(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).selectExpr(*UNCHECKED_EXPRESSIONS)
