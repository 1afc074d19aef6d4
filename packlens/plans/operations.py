"""Agent-run, log, rate-limit and schema queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from packlens.operators import accesslog, contract, evalgate, ratelimit, runs as ops
from packlens.plans.answering import _TOKENS
from packlens.plans.oracle_views import with_views
from packlens.settings import TOOLS, TRAJECTORY_GATES
from packlens.session import staging_path
from packlens.sources import golden, logs
from packlens.sources.sinks import staged
from packlens.sources.tables import events

# Small enough to cut some of the test runs short.
BUDGET = 400


def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    return ops.token_usage(logs.turns(spark, folder))


def budget_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    ran = ops.within_budget(logs.turns(spark, folder), BUDGET)
    return ran.select("request_id", "turn", "iteration", "billable", "spent", "exhausted")


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    ran = ops.within_budget(logs.turns(spark, folder), BUDGET)
    return ops.run_outcomes(logs.requests(spark, folder), ran)


def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder).select(
        "request_id", "outcome", "refused", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"), "iterations",
        "billable_tokens", F.array_join("tool_calls", "|").alias("tool_calls"),
    )


def _trajectories(spark: SparkSession, folder: str) -> DataFrame:
    return ops.score_trajectories(logs.labelled_runs(spark, folder), _outcomes(spark, folder))


def trajectory_items(spark: SparkSession, folder: str) -> DataFrame:
    lists = [F.array_join(c, ",").alias(c) for c in ("satisfied", "missed", "violated")]
    return _trajectories(spark, folder).select("request_id", *lists, F.round("accuracy", 6).alias("accuracy"), "precise")


def trajectory_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return ops.roll_up_trajectories(_trajectories(spark, folder)).withColumn("score", F.round("score", 6))


def trajectory_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Gates not met, then the runs that missed a tool or used a forbidden one."""
    items = staged(_trajectories(spark, folder), "trajectories")
    failed = evalgate.gate_violations(ops.roll_up_trajectories(items), golden.gates(spark, TRAJECTORY_GATES))
    gates = failed.select(F.lit("gate").alias("kind"), F.col("metric").alias("name"), F.round("actual", 6).alias("value"))
    runs = ops.failing_items(items).select(
        F.lit("run").alias("kind"), F.col("request_id").cast("string").alias("name"), F.round("accuracy", 6).alias("value")
    )
    return gates.unionByName(runs)


def tool_registry_check(spark: SparkSession, folder: str) -> DataFrame:
    return ops.unknown_tools(logs.labelled_runs(spark, folder), TOOLS)


def trajectory_files(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled questions, written as JSON files and read back."""
    labelled = logs.labelled_runs(spark, folder).withColumns({"id": F.col("request_id").cast("string"), "query": F.concat(F.lit("run "), F.col("request_id").cast("string"))})
    path = staging_path(spark, "trajectories")
    golden.write_items(labelled, path, "request_id", golden.TRAJECTORY_SCHEMA)
    read = golden.read_trajectories(spark, path)
    return read.select("id", "query", *[F.array_join(c, ",").alias(c) for c in ("expected_tools", "forbidden_tools")])


def log_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = logs.parse_lines(logs.log_lines(spark, folder))
    return parsed.select(
        "event_id", "malformed", F.md5("raw").alias("raw_md5"), "level", "endpoint", "status_code", F.round("duration_ms", 3).alias("duration_ms"),
        F.when(~F.col("malformed"), F.size("extras")).cast("bigint").alias("n_extras"), F.element_at("extras", F.lit("user")).alias("user"),
    )


def log_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Every scalar of nested log lines with its path, secrets masked at any depth."""
    return logs.leaves(logs.nested_lines(spark, folder), "event_id").select("event_id", "path", F.coalesce("value", F.lit("")).alias("value"))


def mask_sensitive(spark: SparkSession, folder: str) -> DataFrame:
    parsed = logs.parse_lines(logs.log_lines(spark, folder))
    entries = F.array_sort(
        F.transform(F.map_entries(logs.mask(F.col("extras"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return parsed.where("not malformed").select("event_id", F.array_join(entries, ";").alias("extras"))


def access_rollup(spark: SparkSession, folder: str) -> DataFrame:
    daily = logs.access_log(spark, folder).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    rolled = accesslog.access_rollup(accesslog.access_counts(daily, "day"), "day")
    figures = ("mean_ms", "p50_ms", "p95_ms", "max_ms")
    return rolled.withColumns({c: F.round(c, 8) for c in figures})


def caller_traffic(spark: SparkSession, folder: str) -> DataFrame:
    return logs.access_log(spark, folder).groupBy("caller").agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("status_code") >= 500).alias("n_errors")
    )


# Long enough for the test log, where a caller comes back after hours.
SESSION_GAP = "6 hours"


def session_rows(sessions: DataFrame) -> DataFrame:
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")]
    return sessions.select("caller", *times, "n_requests", "n_errors", F.round("total_ms", 4).alias("total_ms"))


def caller_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return session_rows(accesslog.caller_sessions(logs.access_log(spark, folder), SESSION_GAP))


def rate_limit_replay(spark: SparkSession, folder: str) -> DataFrame:
    return ratelimit.replay(logs.rate_events(spark, folder), slice_micros=60_000_000)


# A declared shape of the events table that differs from the stored one.
DECLARED_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("value", T.IntegerType(), True),
        T.StructField("created_by", T.StringType(), False),
    ]
)


def schema_contract(spark: SparkSession, folder: str) -> DataFrame:
    return contract.check_contract(events(spark, folder), DECLARED_EVENTS)


QUERIES = {
    "token_usage": token_usage,
    "budget_cutoff": budget_cutoff,
    "run_outcomes": run_outcomes,
    "trajectory_items": trajectory_items,
    "trajectory_rollup": trajectory_rollup,
    "trajectory_gate": trajectory_gate,
    "tool_registry_check": tool_registry_check,
    "trajectory_files": trajectory_files,
    "log_parse": log_parse,
    "log_nested": log_nested,
    "mask_sensitive": mask_sensitive,
    "access_rollup": access_rollup,
    "caller_traffic": caller_traffic,
    "caller_sessions": caller_sessions,
    "rate_limit_replay": rate_limit_replay,
    "schema_contract": schema_contract,
}

_USAGE = "input_tokens + output_tokens + cache_creation_input_tokens + coalesce(cache_read_input_tokens,0)"
_TURNS = f"""turns AS (SELECT conv_id AS request_id, turn, {_TOKENS.replace('question', 'text')} AS input_tokens,
      length(text)//8 AS output_tokens, turn*3 AS cache_creation_input_tokens,
      CASE WHEN turn%4=1 THEN 40 END AS cache_read_input_tokens,
      CASE {logs.TURN_TOOLS} WHEN 5 THEN []::VARCHAR[] WHEN 6 THEN ['ask_docs','predict_soh']
        ELSE [['search_docs','ask_docs','predict_soh','drift_report','delegate_research'][{logs.TURN_TOOLS}+1]] END AS tools,
      CASE (conv_id+turn)%6 WHEN 0 THEN 'refusal' WHEN 1 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
      CASE WHEN (conv_id+turn)%6=0 AND conv_id%2=0 THEN 'cyber' END AS stop_category
    FROM conversations WHERE role='assistant')"""
_RAN = f"""spent AS (SELECT *, {_USAGE} AS billable, sum({_USAGE}) OVER w AS spent, row_number() OVER w AS iteration FROM turns
      WINDOW w AS (PARTITION BY request_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    ran AS (SELECT *, spent >= {BUDGET} AS exhausted FROM spent WHERE spent - billable < {BUDGET} AND iteration <= 12)"""
_OUTCOMES = f"""{_TURNS}, {_RAN},
    agg AS (SELECT request_id, count(*) AS iterations, sum(billable)::BIGINT AS billable_tokens, bool_or(exhausted) AS exhausted,
      arg_max(stop_reason, turn) AS stop_reason, arg_max(coalesce(stop_category,''), turn) AS category,
      flatten(list(tools ORDER BY turn)) AS tool_calls FROM ran GROUP BY request_id),
    outcomes AS (SELECT r.request_id, CASE WHEN exhausted THEN 'budget_exceeded' WHEN iterations IS NULL THEN 'empty_response'
        WHEN stop_reason='refusal' THEN CASE WHEN category='' THEN 'refusal' ELSE category END
        WHEN stop_reason='max_tokens' THEN 'max_tokens' ELSE 'answered' END AS outcome, coalesce(stop_reason,'') AS stop_reason,
        coalesce(iterations,0) AS iterations, coalesce(billable_tokens,0) AS billable_tokens,
        coalesce(tool_calls,[]) AS tool_calls
      FROM (SELECT DISTINCT conv_id AS request_id FROM conversations) r LEFT JOIN agg USING (request_id))"""
_LABELLED = """labelled AS (SELECT DISTINCT conv_id AS request_id,
      CASE conv_id%5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['ask_docs|search_docs'] WHEN 2 THEN ['predict_soh']
        WHEN 3 THEN ['predict_soh','ask_docs|search_docs'] ELSE ['drift_report|lookup_docs'] END AS expected,
      CASE conv_id%3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['drift_report'] ELSE ['delegate_research','run_shell'] END AS forbidden
    FROM conversations)"""
_TRAJECTORIES = f"""{_OUTCOMES}, {_LABELLED},
    t0 AS (SELECT *, coalesce(outcome <> 'answered', true) AS refused, outcome IS NULL AS absent,
      list_filter(expected, lambda e: list_has_any(string_split(e,'|'), tool_calls)) AS met,
      list_filter(expected, lambda e: NOT list_has_any(string_split(e,'|'), tool_calls)) AS unmet,
      list_filter(forbidden, lambda t: list_contains(tool_calls, t)) AS violated
      FROM (SELECT l.*, o.outcome, coalesce(o.tool_calls, []) AS tool_calls FROM labelled l LEFT JOIN outcomes o USING (request_id))),
    items AS (SELECT request_id, CASE WHEN refused AND len(expected)>0 THEN [] ELSE met END AS satisfied,
      CASE WHEN refused AND len(expected)>0 THEN expected ELSE unmet END AS missed, violated,
      CASE WHEN absent THEN 0e0 WHEN len(expected)=0 THEN 1e0 WHEN refused THEN 0 ELSE len(met)/len(expected)::DOUBLE END AS accuracy,
      len(violated)=0 AS precise FROM t0)"""
_ROLLED = """rolled AS (SELECT 'trajectory_accuracy' AS metric, coalesce(avg(accuracy),0) AS score, count(*) AS n_items FROM items
    UNION ALL SELECT 'tool_precision', coalesce(avg(precise::INT),0), count(*) FROM items)"""
_LINES0 = f"all_lines AS (SELECT event_id, {logs.LOG_LINE} AS line FROM events)"
_LINES = "lines AS (SELECT * FROM all_lines WHERE json_valid(line))"
_EXTRAS = """extras AS (SELECT event_id, unnest(json_keys(line)) AS k, line FROM lines)"""
_ACCESS = """access_log AS (SELECT event_id, ts, CASE user_id%3 WHEN 0 THEN 'key:' || substr('sk-user-' || user_id,1,8)
      WHEN 1 THEN 'ip:10.0.0.' || user_id ELSE 'ip:unknown' END AS caller,
      CASE WHEN event_id%10<>0 THEN '/v1/' ELSE '/' END || event_type AS endpoint,
      CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status_code, value AS duration_ms FROM events)"""
_SESSIONS = """marked AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true) AS opens FROM access_log
      WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY caller ORDER BY ts)),
    numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY caller ORDER BY ts) AS number FROM marked),
    sessions AS (SELECT caller, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
      strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n_requests,
      count(*) FILTER (WHERE status_code>=500) AS n_errors, round(sum(duration_ms),4) AS total_ms FROM numbered GROUP BY caller, number)"""
_GATES = ", ".join(f"('{m}', {t}::DOUBLE)" for m, t in TRAJECTORY_GATES.items())

ORACLES = {
    "token_usage": f"""WITH {_TURNS} SELECT request_id, sum(input_tokens)::BIGINT AS input_tokens,
        sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_input_tokens)::BIGINT AS cache_creation_input_tokens,
        coalesce(sum(cache_read_input_tokens),0)::BIGINT AS cache_read_input_tokens, sum({_USAGE})::BIGINT AS billable_tokens
        FROM turns GROUP BY request_id""",
    "budget_cutoff": f"""WITH {_TURNS}, {_RAN} SELECT request_id, turn, iteration, billable, spent::BIGINT AS spent, exhausted
        FROM ran""",
    "run_outcomes": f"""WITH {_OUTCOMES} SELECT request_id, outcome, outcome <> 'answered' AS refused, stop_reason, iterations,
        billable_tokens, array_to_string(tool_calls,'|') AS tool_calls FROM outcomes""",
    "trajectory_items": f"""WITH {_TRAJECTORIES} SELECT request_id, array_to_string(satisfied,',') AS satisfied,
        array_to_string(missed,',') AS missed, array_to_string(violated,',') AS violated, round(accuracy,6) AS accuracy, precise
        FROM items""",
    "trajectory_rollup": f"WITH {_TRAJECTORIES}, {_ROLLED} SELECT metric, round(score,6) AS score, n_items FROM rolled",
    "trajectory_gate": f"""WITH {_TRAJECTORIES}, {_ROLLED}
        SELECT 'gate' AS kind, metric AS name, round(coalesce(score,0),6) AS value FROM (VALUES {_GATES}) g(metric, threshold)
          LEFT JOIN rolled USING (metric) WHERE coalesce(score,0) < threshold
        UNION ALL SELECT 'run', request_id::VARCHAR, round(accuracy,6) FROM items WHERE len(missed)>0 OR len(violated)>0""",
    "tool_registry_check": f"""WITH {_LABELLED}, n AS (SELECT request_id, unnest(list_distinct(list_concat(
          flatten(list_transform(expected, lambda e: string_split(e,'|'))), forbidden))) AS tool FROM labelled)
        SELECT tool, count(*) AS n_runs FROM n WHERE tool NOT IN {tuple(TOOLS)} GROUP BY tool""",
    "trajectory_files": f"""WITH {_LABELLED} SELECT request_id::VARCHAR AS id, 'run ' || request_id AS query,
        array_to_string(expected,',') AS expected_tools, array_to_string(forbidden,',') AS forbidden_tools FROM labelled""",
    "log_parse": f"""WITH {_LINES0}, {_LINES.replace("lines AS", "good AS", 1)}
        SELECT event_id, true AS malformed, md5(line) AS raw_md5, NULL AS level, NULL AS endpoint, NULL AS status_code, NULL AS duration_ms,
          NULL AS n_extras, NULL AS "user" FROM all_lines WHERE NOT json_valid(line)
        UNION ALL SELECT event_id, false, NULL, line->>'$.level' AS level, line->>'$.endpoint' AS endpoint,
        (line->>'$.status_code')::BIGINT AS status_code, round((line->>'$.duration_ms')::DOUBLE,3) AS duration_ms,
        len(json_keys(line)) - 6 AS n_extras, line->>'$.user' AS "user" FROM good""",
    "log_nested": f"""WITH l AS (SELECT event_id, {logs.NESTED_LINE} AS line FROM events),
        t AS (SELECT event_id, fullkey AS path, atom FROM (SELECT * FROM l WHERE json_valid(line)) g, json_tree(g.line) WHERE atom IS NOT NULL)
        SELECT event_id, path, CASE WHEN len(list_filter(regexp_split_to_array(lower(path), '[.\\[]'), lambda k: regexp_matches(k, 'api_key|apikey|secret|password|token|authorization')
            AND NOT (ends_with(k,'_tokens') OR k = 'tokens'))) > 0 THEN '***' ELSE atom->>'$' END AS value FROM t""",
    "mask_sensitive": f"""WITH {_LINES0}, {_LINES}, {_EXTRAS},
        m AS (SELECT event_id, k || '=' || CASE WHEN NOT (ends_with(lower(k),'_tokens') OR lower(k)='tokens')
            AND regexp_matches(lower(k), 'api_key|apikey|secret|password|token|authorization') THEN '***'
            ELSE line->>k END AS e FROM extras
          WHERE k NOT IN {logs.ENVELOPE})
        SELECT event_id, string_agg(e, ';' ORDER BY e) AS extras FROM m GROUP BY event_id""",
    "access_rollup": f"""WITH {_ACCESS} SELECT endpoint, strftime(ts,'%Y-%m-%d') AS day, count(*) AS n_requests,
        count(*) FILTER (WHERE status_code>=500) AS n_errors, round(avg(duration_ms),8) AS mean_ms,
        round(quantile_cont(duration_ms,0.5),8) AS p50_ms, round(quantile_cont(duration_ms,0.95),8) AS p95_ms,
        round(max(duration_ms),8) AS max_ms FROM access_log GROUP BY ALL""",
    "caller_traffic": f"""WITH {_ACCESS} SELECT caller, count(*) AS n_requests,
        count(*) FILTER (WHERE status_code>=500) AS n_errors FROM access_log GROUP BY caller""",
    "caller_sessions": f"WITH {_ACCESS}, {_SESSIONS} SELECT * FROM sessions",
    "rate_limit_replay": """WITH RECURSIVE e AS (SELECT event_id, scope, caller, us, lim,
          row_number() OVER (PARTITION BY scope, caller ORDER BY us, event_id) AS i FROM (
            SELECT event_id, CASE WHEN event_type IN ('purchase','signup') THEN 'agent' ELSE 'ask' END AS scope,
              user_id::VARCHAR AS caller, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 8000 AS us,
              CASE WHEN event_type IN ('purchase','signup') THEN 3 ELSE 6 END::BIGINT AS lim FROM events)),
        r AS (
          SELECT event_id, scope, caller, i, us, true AS allowed, lim*60000000 - 60000000 AS tokens_left, 0::BIGINT AS retry_micros
            FROM e WHERE i = 1
          UNION ALL
          SELECT event_id, scope, caller, i, us, t >= 60000000, CASE WHEN t >= 60000000 THEN t-60000000 ELSE t END,
            CASE WHEN t >= 60000000 THEN 0 ELSE (60000000-t+lim-1)//lim END FROM (
              SELECT e.event_id, e.scope, e.caller, e.i, e.us, e.lim, least(e.lim*60000000, r.tokens_left+(e.us-r.us)*e.lim) AS t
              FROM r JOIN e ON e.scope=r.scope AND e.caller=r.caller AND e.i=r.i+1))
        SELECT event_id, scope, caller, allowed, tokens_left, retry_micros FROM r""",
    "schema_contract": """WITH d(c, verdict, req) AS (VALUES ('event_id','ok',true), ('ts','ok',true), ('user_id','type bigint',false),
          ('event_type','ok',true), ('value','type double',false), ('created_by','missing',true), ('props','extra',false)),
        n AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_id IS NULL) AS a, count(*) FILTER (WHERE ts IS NULL) AS b,
          count(*) FILTER (WHERE user_id IS NULL) AS c1, count(*) FILTER (WHERE event_type IS NULL) AS d1,
          count(*) FILTER (WHERE value IS NULL) AS e, count(*) FILTER (WHERE props IS NULL) AS f,
          count(*) FILTER (WHERE value IS NOT NULL AND try_cast(value AS INT) IS NULL) AS l FROM events)
        SELECT c AS "column", verdict, CASE c WHEN 'event_id' THEN a WHEN 'ts' THEN b WHEN 'user_id' THEN c1 WHEN 'event_type' THEN d1
          WHEN 'value' THEN e WHEN 'props' THEN f ELSE 0 END AS n_null, CASE c WHEN 'value' THEN l ELSE 0 END AS n_uncastable,
          req AND (verdict='missing' OR CASE c WHEN 'event_id' THEN a WHEN 'ts' THEN b WHEN 'event_type' THEN d1 ELSE 0 END > 0)
            AS required_broken, n_rows FROM d, n""",
}
