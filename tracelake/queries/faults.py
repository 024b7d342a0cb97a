"""Operators over traces in which things go wrong: with the word lists and thresholds that the library ships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fleet, logs, traces, tree
from ..sources.adapters import spans_from_sessions

_SESSIONS = """
v AS (SELECT *, event_id AS n, event_id % 8 AS r, event_id // 8 AS g FROM events),
u AS (
  SELECT *, 's' || g AS trace_id, CASE WHEN n % 131 <> 7 THEN 'e' || n END AS span_id,
    CASE WHEN r = 0 THEN NULL WHEN n % 97 = 5 THEN 'gone' WHEN r % 3 = 1 THEN 'e' || (g * 8) ELSE 'e' || (n - 1) END AS parent_span_id,
    CASE WHEN r = 0 THEN 'visit ' || event_type WHEN n % 9 = 0 THEN 'acquire connection' WHEN n % 9 = 1 THEN 'retry payment' WHEN n % 9 = 2 THEN 'call deadline exceeded' WHEN n % 9 = 3 THEN 'timed out step' ELSE 'step ' || event_type END AS name,
    CASE WHEN r = 0 THEN 2 ELSE 3 END AS kind, TIMESTAMP '2024-01-01' + to_minutes(CAST(g AS BIGINT)) + to_milliseconds(CAST(10 * r AS BIGINT)) AS start_time,
    CASE WHEN n % 127 = 4 THEN NULL WHEN n % 113 = 3 THEN -1000000 ELSE CAST(round(value * CASE WHEN n % 40 = 0 THEN 30 ELSE 1 END * 1000000) AS BIGINT) END AS duration_nano,
    event_type = 'error' AS is_error, CASE WHEN n % 5 <> 0 THEN 'svc-' || (user_id % 10) END AS service, CASE WHEN n % 5 = 0 THEN 'app-' || (user_id % 3) END AS app,
    CASE WHEN r = 0 THEN CASE g % 3 WHEN 0 THEN '200' WHEN 1 THEN '404' ELSE '503' END END AS http_status, CASE WHEN r IN (1, 4) THEN 'SELECT ' || event_type || ' ' || (n % 6) END AS statement,
    CASE WHEN r = 2 THEN CASE WHEN n % 3 < 2 THEN 'OK' ELSE 'UNAVAILABLE' END END AS grpc, CASE WHEN r = 3 THEN CASE WHEN user_id % 2 = 0 THEN '500' ELSE '200' END END AS response_code,
    CASE WHEN r = 5 THEN CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END END AS error, CASE WHEN r = 6 AND n % 7 = 0 THEN 'NullPointer' END AS exception_kind,
    CASE WHEN r = 7 AND n % 5 = 0 THEN 'context deadline passed' END AS note, n % 9 = 0 AND r > 0 AS pooled
  FROM v),
s AS (SELECT *, duration_nano / 1000000.0::DOUBLE AS ms, start_time + to_microseconds(CAST(trunc(duration_nano / 1000.0) AS BIGINT)) AS end_time FROM u)
"""


def _sql(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{_SESSIONS} {'' if rest.startswith('SELECT') else ', '}{rest}"


def _sessions(f):
    return lambda spark, d: f(spans_from_sessions(spark, d))


_POOL = (
    "pi AS (SELECT trace_id, span_id, name AS span_name, round(ms, 2) AS wait_ms, CASE WHEN pooled THEN CASE WHEN n % 2 = 0 THEN '10' ELSE '20' END END AS pool_size, CASE WHEN pooled THEN CAST(n % 10 AS VARCHAR) END AS active_connections, CASE WHEN pooled THEN CAST(n % 4 AS VARCHAR) END AS waiting_requests, CASE WHEN ms >= 500 THEN 'high' WHEN ms >= 200 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE name = 'acquire connection' AND ms >= 100), "
    "pool AS (SELECT *, round(sum(wait_ms) OVER (PARTITION BY trace_id), 2) AS total_wait_ms, round(sum(wait_ms) OVER (PARTITION BY trace_id), 2) >= 300 AS pool_exhaustion FROM pi)"
)
_CHAIN = (
    "h AS (SELECT *, name IN ('call deadline exceeded', 'timed out step') OR note IS NOT NULL OR coalesce(ms >= 1000, false) AS hit, parent_span_id IS NULL OR NOT EXISTS (SELECT 1 FROM s p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id) AS top FROM s), "
    "w AS (SELECT trace_id, span_id, hit, CASE WHEN hit THEN [name] ELSE CAST([] AS VARCHAR[]) END AS names, CASE WHEN hit THEN ms ELSE 0.0 END AS total FROM h WHERE top UNION ALL "
    "SELECT h.trace_id, h.span_id, h.hit, CASE WHEN h.hit THEN list_concat([h.name], w.names) ELSE w.names END, w.total + CASE WHEN h.hit THEN h.ms ELSE 0.0 END FROM h JOIN w ON h.trace_id = w.trace_id AND h.parent_span_id = w.span_id), "
    "ch AS (SELECT *, len(names) AS n FROM w WHERE hit AND len(names) >= 2), "
    "casc AS (SELECT trace_id, n AS chain_length, names[1] AS origin_span, array_to_string(names, ',') AS affected_spans, round(total, 3) AS total_timeout_ms FROM ch a WHERE NOT EXISTS (SELECT 1 FROM ch b WHERE b.trace_id = a.trace_id AND (b.n > a.n OR b.n = a.n AND b.span_id < a.span_id) AND list_has_all(b.names, a.names)))"
)
_RETRY = (
    "q AS (SELECT *, epoch_us(start_time)::DOUBLE / 1000 - lag(epoch_us(end_time)::DOUBLE / 1000) OVER z AS gap, lag(ms) OVER z AS pm FROM s WINDOW z AS (PARTITION BY trace_id, name ORDER BY start_time, span_id)), "
    "g2 AS (SELECT trace_id, name AS span_name, count(*) AS retry_count, 1 + count(*) FILTER (gap >= 0 AND gap < 1000) AS sequential, count(*) FILTER (pm > 1.5 * ms) AS drops, round(sum(ms), 2) AS total_ms FROM q GROUP BY 1, 2), "
    "rs AS (SELECT trace_id, span_name, retry_count, sequential, total_ms, retry_count >= 3 AND drops = 0 AS has_exponential_backoff, CASE WHEN retry_count >= 5 THEN 'high' ELSE 'medium' END AS impact FROM g2 WHERE span_name = 'retry payment' OR retry_count >= 3 AND sequential >= 3)"
)
_MESSAGES = ["Pod OOMKilled twice", "Slow query on db", "5XX from upstream", "node has disk pressure", "cold start seen", "CPU throttling by cpu limit", "connection pool exhausted", "all is fine", "unschedulable pending pod", "rate ok"]
# What the shipped rules say of each message: (categories in order, class).
_CLASSES = {0: ("memory", "high"), 1: ("performance", "high"), 2: ("errors", "high"), 3: ("storage", "high"), 4: ("serverless", "medium"), 5: ("cpu", "medium"), 6: ("database", "high"), 8: ("kubernetes", "high")}


def _findings(spark: SparkSession, d: str) -> DataFrame:
    said = F.array(*[F.lit(m) for m in _MESSAGES])
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", said[(F.col("event_id") % 10).cast("int")].alias("message"))
    return logs.classify_findings(rows).select("event_id", "categories", "severity_class")


def _cascade(spans: DataFrame) -> DataFrame:
    return tree.cascading_timeout(spans).withColumn("affected_spans", F.array_join("affected_spans", ",")).withColumn("total_timeout_ms", F.round("total_timeout_ms", 3))


QUERIES = {
    "extract_errors_all_kinds": (
        _sessions(traces.extract_errors),
        _sql(
            "SELECT trace_id, span_id, name, 'http_error' AS error_type, http_status AS error_message FROM s WHERE http_status IN ('404', '503') UNION ALL SELECT trace_id, span_id, name, 'grpc_error', grpc FROM s WHERE grpc = 'UNAVAILABLE' "
            "UNION ALL SELECT trace_id, span_id, name, 'http_error', response_code FROM s WHERE response_code = '500' UNION ALL SELECT trace_id, span_id, name, 'error', error FROM s WHERE error = 'true' UNION ALL SELECT trace_id, span_id, name, 'exception.kind', exception_kind FROM s WHERE exception_kind IS NOT NULL"
        ),
    ),
    "validate_trace_quality_all_issues": (
        _sessions(traces.validate_trace_quality),
        _sql(
            "j AS (SELECT c.*, p.span_id IS NOT NULL AS known, p.start_time AS ps, p.end_time AS pe FROM s c LEFT JOIN (SELECT * FROM s WHERE span_id IS NOT NULL) p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id) "
            "SELECT trace_id, span_id, 'missing_span_id' AS issue FROM j WHERE span_id IS NULL UNION ALL SELECT trace_id, span_id, 'orphaned_span' FROM j WHERE parent_span_id IS NOT NULL AND NOT known UNION ALL SELECT trace_id, span_id, 'negative_duration' FROM j WHERE end_time < start_time "
            "UNION ALL SELECT trace_id, span_id, 'clock_skew' FROM j WHERE start_time < ps OR end_time > pe UNION ALL SELECT trace_id, span_id, 'timestamp_error' FROM j WHERE start_time IS NULL OR end_time IS NULL"
        ),
    ),
    "latency_anomalies_of_a_tail": (
        _sessions(traces.latency_anomalies),
        _sql("m AS (SELECT name, avg(ms) AS m, coalesce(stddev_samp(ms), 0.0) AS sd FROM s GROUP BY 1), j AS (SELECT *, (ms - m) / sd AS z FROM s JOIN m USING (name) WHERE sd > 0) SELECT trace_id, span_id, name, round(ms, 3) AS duration_ms, round(z, 2) AS z_score, CASE WHEN z > 0 THEN 'slow' ELSE 'fast' END AS anomaly_type FROM j WHERE abs(z) > 2 AND ms > 50"),
    ),
    "statistical_outliers_of_a_tail": (_sessions(traces.statistical_outliers), _sql("SELECT trace_id, ms AS duration_ms FROM s WHERE parent_span_id IS NULL AND ms > (SELECT avg(ms) + 2 * stddev_samp(ms) FROM s WHERE parent_span_id IS NULL)")),
    "service_level_stats_by_labels": (
        _sessions(fleet.service_level_stats),
        _sql("SELECT coalesce(service, app) AS service_name, count(*) AS span_count, round(count(*) FILTER (error IS NOT NULL OR contains(coalesce(statement, ''), 'error') OR contains(coalesce('/' || CASE WHEN r = 0 THEN event_type END, ''), 'error')) / count(*) * 100, 2) AS error_rate, round(avg(ms), 2) AS avg_latency_ms FROM s GROUP BY 1"),
    ),
    "database_statements": (
        _sessions(lambda s: fleet.database_operations(s, exact=True)),
        _sql(
            "b AS (SELECT CASE WHEN statement IS NOT NULL THEN 'mysql' END AS db_system, CASE WHEN statement IS NOT NULL THEN 'db' || (user_id % 3) END AS db_name, CASE WHEN statement IS NOT NULL THEN 'SELECT' END AS db_operation, statement, ms FROM s WHERE kind = 3) "
            "SELECT db_system, db_name, db_operation, count(*) AS call_count, round(avg(ms), 2) AS avg_ms, round(quantile_disc(ms, 0.95), 2) AS p95_ms, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT statement) FILTER (statement IS NOT NULL)), 1, 3), ','), '') AS sample_statements, min(statement) AS any_statement FROM b GROUP BY 1, 2, 3"
        ),
    ),
    "http_sizes": (
        _sessions(lambda s: fleet.http_attributes(s, 5, exact=True)),
        _sql("SELECT 'GET' AS http_method, '/' || event_type AS http_target, http_status, count(*) AS request_count, round(quantile_disc(ms, 0.5), 2) AS p50_ms, round(quantile_disc(ms, 0.95), 2) AS p95_ms, round(quantile_disc(ms, 0.99), 2) AS p99_ms, round(avg(n % 1000), 2) AS avg_request_size, round(avg(user_id * 10), 2) AS avg_response_size FROM s WHERE kind = 2 GROUP BY 2, 3 HAVING count(*) >= 5"),
    ),
    "exception_events": (
        _sessions(lambda s: fleet.span_events(s, "exception", limit=200)),
        _sql("SELECT trace_id, span_id, service AS service_name, name AS span_name, 'exception' AS event_name, start_time AS event_time, 'Err' || (n % 4) AS exception_type, 'user ' || user_id AS exception_message, 'at line ' || (n % 13) AS exception_stacktrace FROM s WHERE is_error ORDER BY start_time DESC, span_id LIMIT 200"),
    ),
    "connection_pool_waits": (_sessions(traces.connection_pool_issues), _sql(f"{_POOL} SELECT * FROM pool")),
    "cascading_timeout_by_words": (_sessions(_cascade), _sql(f"{_CHAIN} SELECT * FROM casc", recursive=True)),
    "all_patterns_by_words": (
        _sessions(lambda s: traces.all_patterns(s, with_healthy=False)),
        _sql(
            f"{_RETRY}, {_CHAIN}, {_POOL}, "
            "k AS (SELECT trace_id, 1 AS k, CASE impact WHEN 'high' THEN 2 ELSE 1 END AS rk FROM rs UNION ALL SELECT trace_id, 2, 3 FROM casc UNION ALL SELECT trace_id, 3, CASE WHEN pool_exhaustion THEN 3 WHEN severity = 'high' THEN 2 ELSE 1 END FROM pool) "
            "SELECT trace_id, count(*) FILTER (k = 1) AS retry_storms, count(*) FILTER (k = 2) AS cascading_timeouts, count(*) FILTER (k = 3) AS connection_pool_issues, CASE max(rk) WHEN 3 THEN 'critical' WHEN 2 THEN 'degraded' ELSE 'warning' END AS health FROM k GROUP BY 1",
            recursive=True,
        ),
    ),
    "classify_findings_by_shipped_rules": (
        _findings,
        "SELECT * FROM (SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{c}'" for k, (c, _) in _CLASSES.items()) + " END AS categories, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{s}'" for k, (_, s) in _CLASSES.items()) + " END AS severity_class FROM events) WHERE categories IS NOT NULL",
    ),
}
