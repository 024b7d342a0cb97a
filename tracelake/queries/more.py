"""Filters, variants and compositions beside the main queries of each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import shared_folder
from ..operators import correlate, logs, metrics, traces, tree
from ..plans import pipelines
from ..sources import adapters as A
from ..sources import readers as R
from . import documents as D
from . import sql as Q
from .faults import _SESSIONS
from .faults import QUERIES as FAULTS
from .signals import _ALL_TEMPLATES, entries
from .traces import _BLOCKING_TIES, half_up

END = "2024-01-31"


def _service() -> Column:
    return F.col("resource_labels")["service.name"]


def _read_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans written to the shared folder and read in the fixed schema."""
    path = f"{shared_folder(spark)}/spans-{uuid.uuid4().hex}"
    R.write_result(A.spans_from_orders(spark, d).drop("instrumentation_scope"), path)
    s = R.read_spans(spark, path)
    return s.select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", C.service().alias("service"), C.attr("peer.service").alias("peer"), F.col("instrumentation_scope.name").alias("library"))


def _written(spark: SparkSession, d: str, kind: str) -> DataFrame:
    path = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    R.write_result(A.metrics_from_events(spark, d).select("metric_type", F.col("metric_labels")["shard"].alias("shard"), "value"), path, kind)
    return spark.read.schema("metric_type string, shard string, value double").format(kind).load(path)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as latencies, views as a running total, purchases as a gauge."""
    p = A.metrics_from_events(spark, d).filter("metric_type in ('click', 'view', 'purchase')")
    name = F.when(F.col("metric_type") == "click", "click_latency").when(F.col("metric_type") == "view", "views_total").otherwise("purchase")
    return p.withColumn("metric_type", name)


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return correlate.metric_kinds_during_trace(A.spans_from_events(spark, d).filter(C.is_error()), _metrics(spark, d), _service(), 1800, exact=True)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'signup'")
    changes = e.select(F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("service_name"), "ts", F.col("event_id").alias("change_id"), F.lit("services.Deploy").alias("method"))
    return pipelines.change_pipeline(A.spans_from_events(spark, d), changes, END, 24 * 31, 1440, exact=True, bucket_hours=24, min_samples=3)


def _talk_patterns(spark: SparkSession, d: str) -> DataFrame:
    return logs.template_patterns(A.logs_from_conversations(spark, d))


def _remedies(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "slow query: OOMKilled").when(F.col("event_type") == "view", "disk pressure")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", said.alias("message")).filter("message is not null")
    actions = [("memory", "raise the limit", "low", "low"), ("memory", "find the leak", "medium", "high"), ("performance", "add an index", "low", "medium"), ("performance", "cache", "medium", "low"), ("storage", "grow the disk", "low", "low")]
    return logs.suggest_remediation(logs.classify_findings(rows), spark.createDataFrame(actions, "category string, action string, risk string, effort string"), "event_id")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    p = tree.critical_path_blocking(A.spans_from_orders(spark, d)).select("trace_id", F.explode("critical_path").alias("p"))
    return p.select("trace_id", F.col("p.span_id").alias("span_id"), F.col("p.contribution_pct").alias("contribution_pct"))


def _steps_sql() -> str:
    """The chain with what each step adds to it, in place of the ids alone."""
    chain = _BLOCKING_TIES.replace("[span_id] AS path", "[{'id': span_id, 'ms': self_ms}] AS path").replace(
        "list_append(b.path, y.span_id)", "list_append(b.path, {'id': y.span_id, 'ms': b.weight * CASE WHEN b.end_ms - y.end_ms > 5 THEN 0.5 ELSE 1.0 END * y.self_ms})"
    )
    return Q.with_orders(f"{chain} SELECT trace_id, p.id AS span_id, CASE WHEN blocking <> 0 THEN {half_up('p.ms / blocking * 100')} END AS contribution_pct FROM (SELECT trace_id, blocking, unnest(path) AS p FROM best)").replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "read_spans": (_read_spans, Q.with_orders("SELECT trace_id, span_id, parent_span_id, name, kind, start_time, end_time, service, peer, CAST(NULL AS VARCHAR) AS library FROM s")),
    "write_result_csv": (lambda spark, d: _written(spark, d, "csv"), "SELECT event_type AS metric_type, CAST(user_id % 10 AS VARCHAR) AS shard, value FROM events"),
    "write_result_json": (lambda spark, d: _written(spark, d, "json"), "SELECT event_type AS metric_type, CAST(user_id % 10 AS VARCHAR) AS shard, value FROM events"),
    "read_trace_documents_durations": (
        lambda spark, d: R.trace_documents_to_spans(D.trace_documents(spark, d)).select("trace_id", F.round("trace_duration_ms", 3).alias("trace_duration_ms")).distinct(),
        Q.with_orders("SELECT trace_id, round((epoch_us(max(end_time)) - epoch_us(min(start_time)))::DOUBLE / 1000, 3) AS trace_duration_ms FROM s GROUP BY 1"),
    ),
    "log_entries_with_fields": (
        lambda spark, d: R.entries_with_fields(entries(spark, d), {"id": "x", "Message": "user 7 did click"}).select("event_id"),
        "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7",
    ),
    "list_log_entries_by_rank": (
        lambda spark, d: R.list_log_entries(A.logs_from_events(spark, d), min_severity="WARNING", limit=500).select("insert_id", "severity_text"),
        Q.with_logs("SELECT insert_id, severity AS severity_text FROM logs WHERE severity IN ('WARN', 'ERROR') ORDER BY timestamp DESC, insert_id LIMIT 500"),
    ),
    "select_points": (
        lambda spark, d: R.select_points(A.metrics_from_events(spark, d), "click", {"shard": "3"}, {"service.name": "svc-3"}, "2024-01-05", "2024-01-25").select("ts", "value"),
        "SELECT CAST(ts AS TIMESTAMP) AS ts, value FROM events WHERE event_type = 'click' AND user_id % 10 = 3 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'",
    ),
    "time_window_in_the_past": (
        lambda spark, d: C.time_window(A.spans_from_events(spark, d), 48, "2024-01-15").select("span_id"),
        Q.with_events("SELECT span_id FROM s WHERE start_time BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-15'"),
    ),
    "span_error_by_status": (
        lambda spark, d: A.spans_from_sessions(spark, d).groupBy("name").agg(F.count_if(C.error_by_status()).alias("by_status"), F.count_if(C.error_by_labels()).alias("by_labels"), F.count_if(C.error_by_text()).alias("by_text")),
        f"WITH {_SESSIONS} SELECT name, count(*) FILTER (http_status IN ('404', '503')) AS by_status, count(*) FILTER (http_status IN ('404', '503') OR error = 'true') AS by_labels, count(*) FILTER (error IS NOT NULL OR contains(coalesce(statement, ''), 'error') OR r = 0 AND event_type = 'error') AS by_text FROM s GROUP BY 1",
    ),
    "trace_context_of_events": (
        lambda spark, d: correlate.trace_context(A.spans_from_events(spark, d)).select("trace_id", "services", "hosts", "span_count"),
        Q.with_events("SELECT trace_id, service AS services, 'host-' || (CAST(substr(trace_id, 2) AS BIGINT) % 4) AS hosts, 1 AS span_count FROM s"),
    ),
    "trace_services": (
        lambda spark, d: correlate.trace_services(A.spans_from_orders(spark, d).withColumn("name", F.concat_ws("/", C.attr("peer.service"), "name"))),
        Q.with_orders("SELECT DISTINCT trace_id, peer AS service FROM s WHERE peer IS NOT NULL"),
    ),
    "metric_kinds_during_trace": (
        _kinds,
        Q.with_events(
            "p AS (SELECT CASE event_type WHEN 'click' THEN 'click_latency' WHEN 'view' THEN 'views_total' ELSE 'purchase' END AS metric_type, 'svc-' || (user_id % 10) AS service_name, CAST(ts AS TIMESTAMP) AS ts, value FROM events WHERE event_type IN ('click', 'view', 'purchase')), "
            "q AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS grown FROM p WINDOW w AS (PARTITION BY service_name, metric_type ORDER BY ts)), "
            "j AS (SELECT s.trace_id, q.*, epoch_us(s.end_time)::DOUBLE / 1000000 - epoch_us(s.start_time)::DOUBLE / 1000000 + 3600 AS seconds FROM s JOIN q ON q.service_name = s.service AND q.ts BETWEEN s.start_time - INTERVAL 30 MINUTE AND s.end_time + INTERVAL 30 MINUTE WHERE s.is_error) "
            "SELECT trace_id, service_name, metric_type, CASE metric_type WHEN 'click_latency' THEN 'histogram' WHEN 'views_total' THEN 'counter' ELSE 'gauge' END AS kind, count(*) AS points, round(CASE metric_type WHEN 'click_latency' THEN quantile_disc(value, 0.95) WHEN 'views_total' THEN sum(grown) / max(seconds) ELSE avg(value) END, 6) AS value FROM j GROUP BY 1, 2, 3"
        ),
    ),
    "gauge_over_window": (
        lambda spark, d: metrics.gauge_over_window(A.metrics_from_events(spark, d), ["metric_type"], "2024-01-20", 60 * 24),
        "SELECT event_type AS metric_type, round(avg(value), 8) AS avg, min(value) AS min, max(value) AS max, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20' GROUP BY 1",
    ),
    "all_patterns_with_healthy": (
        lambda spark, d: traces.all_patterns(A.spans_from_sessions(spark, d)).groupBy("health").agg(F.count("*").alias("traces"), F.sum("retry_storms").alias("retry_storms"), F.sum("cascading_timeouts").alias("cascading_timeouts")),
        f"SELECT coalesce(health, 'healthy') AS health, count(*) AS traces, CAST(coalesce(sum(retry_storms), 0) AS BIGINT) AS retry_storms, CAST(coalesce(sum(cascading_timeouts), 0) AS BIGINT) AS cascading_timeouts FROM (SELECT DISTINCT 's' || (event_id // 8) AS trace_id FROM events) LEFT JOIN ({FAULTS['all_patterns_by_words'][1]}) USING (trace_id) GROUP BY 1",
    ),
    "example_trace_report": (
        lambda spark, d: traces.example_trace_report(A.spans_from_orders(spark, d)).select("service_name", "count", "mean_ms", "stdev_ms", "error_traces", "sample_adequate", "latency_variance_detected", "baseline_valid"),
        Q.with_orders("SELECT service AS service_name, count(*) AS count, round(avg(ms), 2) AS mean_ms, round(coalesce(stddev_samp(ms), 0), 2) AS stdev_ms, count(*) FILTER (is_error) AS error_traces, count(*) >= 20 AS sample_adequate, coalesce(round(stddev_samp(ms), 2), 0) > 0 AS latency_variance_detected, true AS baseline_valid FROM s WHERE parent_span_id IS NULL AND ms > 0 GROUP BY 1"),
    ),
    "top_patterns_by_severity": (lambda spark, d: logs.top_patterns(_talk_patterns(spark, d), "severity", 25).select("pattern_id", "count"), Q.with_talk(f"{_ALL_TEMPLATES} SELECT pattern_id, count FROM ta ORDER BY errors * 10 + warnings * 5 DESC, count DESC, pattern_id LIMIT 25")),
    "compression_ratio": (lambda spark, d: logs.compression_ratio(_talk_patterns(spark, d)), Q.with_talk(f"{_ALL_TEMPLATES} SELECT CAST(sum(count) AS BIGINT) AS total_logs, count(*) AS total_patterns, round(sum(count) / count(*), 2) AS compression_ratio FROM ta")),
    "suggest_remediation": (
        _remedies,
        "SELECT event_id, rank, category, action, risk, effort, risk = 'low' AND effort = 'low' AS quick_win FROM events JOIN (VALUES ('error', 1, 'memory', 'raise the limit', 'low', 'low'), ('error', 2, 'performance', 'add an index', 'low', 'medium'), ('error', 3, 'performance', 'cache', 'medium', 'low'), ('error', 4, 'memory', 'find the leak', 'medium', 'high'), ('view', 1, 'storage', 'grow the disk', 'low', 'low')) a(kind, rank, category, action, risk, effort) ON kind = event_type",
    ),
    "critical_path_contributions": (_steps, _steps_sql()),
    "change_pipeline": (
        _changes,
        Q.with_events(
            "g AS (SELECT service AS service_name, date_trunc('day', start_time) AS bucket, round(quantile_disc(ms, 0.95), 2) AS v FROM s WHERE start_time >= TIMESTAMP '2023-12-31' GROUP BY 1, 2 HAVING count(*) >= 3), h AS (SELECT *, lag(v) OVER (PARTITION BY service_name ORDER BY bucket) AS o FROM g), st AS (SELECT service_name, min(bucket) AS anomaly_start FROM h WHERE abs((v - o) / o * 100) >= 20 GROUP BY 1), "
            "ch AS (SELECT 'svc-' || (user_id % 10) AS service_name, CAST(ts AS TIMESTAMP) AS ts, event_id AS change_id FROM events WHERE event_type = 'signup') SELECT service_name, anomaly_start, count(*) AS changes, arg_max(change_id, (ts, change_id)) AS change_id, 'services.Deploy' AS method, max(ts) AS changed_at FROM st JOIN ch USING (service_name) WHERE ts BETWEEN anomaly_start - INTERVAL 1440 MINUTE AND anomaly_start GROUP BY 1, 2"
        ),
    ),
}
