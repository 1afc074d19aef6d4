"""Agent turn logs, access logs and rate-limit events over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packlens.functions.text import estimate_tokens
from packlens.sources.sinks import staged
from packlens.sources.tables import events, spread, table

# Parts of a key that mark a secret, and what replaces its value.
SECRET_MARKERS = ("api_key", "apikey", "secret", "password", "token", "authorization")
MASK = "***"

# The envelope of a log line; every other key is an extra.
ENVELOPE = ("ts", "level", "logger", "message", "request_id", "method", "endpoint", "status_code", "duration_ms")

# Tools an agent turn may call, by number; 5 is none, 6 calls two.
TURN_TOOLS = "(conv_id*5+turn*3)%7"


def is_secret(key: Column) -> Column:
    """Does the key name a secret? Token counts do not."""
    lowered = F.lower(key)
    count = F.endswith(lowered, F.lit("_tokens")) | (lowered == "tokens")
    marked = F.lit(False)
    for marker in SECRET_MARKERS:
        marked = marked | F.contains(lowered, F.lit(marker))
    return ~count & marked


def mask(extras: Column) -> Column:
    """The map with the values of secret keys replaced."""
    return F.transform_values(extras, lambda k, v: F.when(is_secret(k), F.lit(MASK)).otherwise(v))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines (one JSON object each) as typed envelope columns and a map of extras.

    A line that is no JSON object stays as ``raw``, with ``malformed`` true and all else null.
    """
    whole = lines.withColumn("_log", F.from_json(line, "map<string,string>")).withColumns(
        {"malformed": F.col("_log").isNull(), "raw": F.when(F.col("_log").isNull(), F.col(line))}
    )
    read = {name: F.try_element_at("_log", F.lit(name)) for name in ENVELOPE}
    typed = {
        **read,
        "status_code": read["status_code"].try_cast("bigint"),
        "duration_ms": read["duration_ms"].try_cast("double"),
        "extras": F.map_filter("_log", lambda k, v: ~k.isin(*ENVELOPE)),
    }
    return whole.withColumns(typed).drop("_log", line)


def leaves(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, path, kind, value) of every scalar in each JSON line, however deep: objects and arrays keep their
    structure as paths (``$.a.b[0]``) and scalars their type.

    A value is masked where a key on its path, not only the last one, names a secret. Lines that are no JSON, and null
    ones, give no row; an empty object or array is a leaf of that kind without a value. One pass per level of nesting.
    """
    spark = lines.sparkSession
    level = lines.select(F.col(key), F.lit("$").alias("path"), F.lit(False).alias("secret"), F.try_parse_json(line).alias("v")).where(F.col("v").isNotNull())
    found = []
    while True:
        level = staged(level.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)), "log-level")
        inner = F.col("kind").isin("OBJECT", "ARRAY") & ~F.to_json("v").isin("{}", "[]")
        text = F.when(F.col("secret"), F.lit(MASK)).when(F.col("kind").isin("OBJECT", "ARRAY", "VOID"), None).otherwise(F.try_variant_get("v", "$", "string"))
        found.append(level.where(~inner).select(key, "path", "kind", text.alias("value")))
        deeper = level.where(inner)
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, found)
        each = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), "_key")).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        hidden = F.col("secret") | F.coalesce(is_secret(F.col("_key")), F.lit(False))
        level = each.select(key, F.concat("path", step).alias("path"), hidden.alias("secret"), F.col("_value").alias("v"))


def endpoint_label(route: Column, path: Column) -> Column:
    """The route pattern where one matched, else the path asked for."""
    return F.coalesce(route, path)


def caller_identity(key: Column, host: Column) -> Column:
    """Who called: the first eight characters of the key, else the peer address."""
    return (
        F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit("key:"), F.substring(key, 1, 8)))
        .when(host.isNotNull(), F.concat(F.lit("ip:"), host))
        .otherwise(F.lit("ip:unknown"))
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, line): each event as the JSON line a service would have written."""
    # Keys of the line, in order. Same text in the SQL check.
    return spread(events(spark, folder)).selectExpr("event_id", f"{LOG_LINE} AS line")


def nested_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, line): each event as a line with nested extras."""
    return events(spark, folder).selectExpr("event_id", f"{NESTED_LINE} AS line")


# Same text in the SQL check.
NESTED_LINE = """
concat('{"level":"INFO","request":{"id":', cast(event_id as string), ',"headers":{"Authorization":"Bearer ', cast(event_id as string),
  '","accept":["a","b', cast(user_id as string), '"]},"timings":[', cast(event_id%11 as string), ',{"db_ms":', cast(event_id%7 as string),
  '}]},"Session_Token":{"id":"s', cast(user_id as string), '","tries":', cast(event_id%3 as string), '},"output_tokens":', cast(event_id%900 as string),
  ',"ok":', CASE WHEN event_type='error' THEN 'false' ELSE 'true' END, CASE WHEN event_id%40=39 THEN '' ELSE '}' END)
""".strip()

LOG_LINE = """
concat('{"level": "', CASE WHEN event_type='error' THEN 'ERROR' ELSE 'INFO' END,
  '", "logger": "api", "message": "request", "endpoint": "/', event_type,
  '", "status_code": ', CASE WHEN event_type='error' THEN '500' ELSE '200' END,
  ', "duration_ms": ', cast(cast(floor(value*1e2) as bigint) as string),
  ', "user": "u', cast(user_id as string),
  CASE event_id%4 WHEN 0 THEN '", "x_api_key": "sk-1' WHEN 1 THEN '", "input_tokens": "12'
    WHEN 2 THEN '", "Session_Token": "abc' ELSE '", "tokens": "9' END,
  '", "Authorization": "Bearer ', cast(event_id as string), CASE WHEN event_id%50=49 THEN '" cut' ELSE '"}' END)
""".strip()


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    return access_of(events(spark, folder))


def access_of(rows: DataFrame) -> DataFrame:
    """Requests with caller, endpoint, status and latency; some matched no route."""
    path = F.concat(F.lit("/"), "event_type")
    route = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("/v1/"), "event_type"))
    key = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("sk-user-"), F.col("user_id").cast("string")))
    host = F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")))
    return rows.select(
        "event_id",
        "ts",
        caller_identity(key, host).alias("caller"),
        endpoint_label(route, path).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("duration_ms"),
    )


def rate_events(spark: SparkSession, folder: str) -> DataFrame:
    return rate_events_of(events(spark, folder))


def rate_events_of(rows: DataFrame) -> DataFrame:
    """(event_id, scope, caller, at_micros, per_minute): the month's events within minutes."""
    start = "timestamp'2024-01-01 00:00:00'"
    rows = rows.withColumn("at_micros", F.expr(f"(unix_micros(ts) - unix_micros({start})) div 8000"))
    agent = F.col("event_type").isin("purchase", "signup")
    return rows.select(
        "event_id",
        F.when(agent, F.lit("agent")).otherwise(F.lit("ask")).alias("scope"),
        F.col("user_id").cast("string").alias("caller"),
        "at_micros",
        F.when(agent, F.lit(3)).otherwise(F.lit(6)).alias("per_minute"),
    )


def in_minutes(rows: DataFrame, late_micros: int, path: str) -> DataFrame:
    """``rows`` with ``part``, the minute in which each arrives, up to ``late_micros`` after its time; one without a time
    comes with the first minute. Stored at ``path`` in a folder for each minute, so that a minute is read alone."""
    part = F.floor((F.col("at_micros") + F.pmod(F.xxhash64("event_id"), F.lit(late_micros))) / 60_000_000)
    rows.withColumn("part", F.coalesce(part, F.lit(0)).cast("bigint")).write.partitionBy("part").parquet(path)
    schema = f"{', '.join(f'{name} {kind}' for name, kind in rows.dtypes)}, part bigint"
    return rows.sparkSession.read.schema(schema).parquet(path)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant rows as the turns of an agent run, one run per conversation."""
    rows = table(spark, folder, "conversations").where("role = 'assistant'")
    names = F.array(*[F.lit(t) for t in ("search_docs", "ask_docs", "predict_soh", "drift_report", "delegate_research")])
    number = F.expr(f"cast({TURN_TOOLS} as int)")
    tools = (
        F.when(number == 5, F.array().cast("array<string>"))
        .when(number == 6, F.array(F.lit("ask_docs"), F.lit("predict_soh")))
        .otherwise(F.array(F.element_at(names, number + 1)))
    )
    reason = F.expr(
        "CASE (conv_id+turn)%6 WHEN 0 THEN 'refusal' WHEN 1 THEN 'max_tokens' ELSE 'end_turn' END"
    )
    return rows.select(
        F.col("conv_id").alias("request_id"),
        "turn",
        estimate_tokens(F.col("text")).alias("input_tokens"),
        F.floor(F.length("text") / 8).alias("output_tokens"),
        (F.col("turn") * 3).alias("cache_creation_input_tokens"),
        F.when(F.col("turn") % 4 == 1, F.lit(40)).cast("bigint").alias("cache_read_input_tokens"),
        tools.alias("tools"),
        reason.alias("stop_reason"),
        F.when((reason == "refusal") & (F.col("conv_id") % 2 == 0), F.lit("cyber")).alias("stop_category"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("request_id")).distinct()


def labelled_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Expected and forbidden tools of each run; an expected entry may name alternatives."""
    none = F.array().cast("array<string>")
    number = F.col("request_id")
    expected = (
        F.when(number % 5 == 0, none)
        .when(number % 5 == 1, F.array(F.lit("ask_docs|search_docs")))
        .when(number % 5 == 2, F.array(F.lit("predict_soh")))
        .when(number % 5 == 3, F.array(F.lit("predict_soh"), F.lit("ask_docs|search_docs")))
        .otherwise(F.array(F.lit("drift_report|lookup_docs")))
    )
    forbidden = (
        F.when(number % 3 == 0, none)
        .when(number % 3 == 1, F.array(F.lit("drift_report")))
        .otherwise(F.array(F.lit("delegate_research"), F.lit("run_shell")))
    )
    return requests(spark, folder).select(
        "request_id", expected.alias("expected_tools"), forbidden.alias("forbidden_tools")
    )
