"""Fleet and service-graph operators over the order and event traces."""

from __future__ import annotations

from ..operators import fleet as O
from ..operators import graph as N
from ..sources.adapters import spans_from_events, spans_from_orders
from . import sql as Q

#: Ends of the order and event histories.
ORDERS_END, ORDERS_HOURS = "2001-12-31", 24 * 365 * 12
EVENTS_END = "2024-01-31"


def _orders(f):
    return lambda spark, d: f(spans_from_orders(spark, d))


def _events(f):
    return lambda spark, d: f(spans_from_events(spark, d))


_EX = "SELECT trace_id, service AS service_name, name, round(ms, 2) AS duration_ms, is_error, start_time FROM s WHERE parent_span_id IS NULL"
_PAIRS = "p AS (SELECT service AS source, coalesce(peer, db_system) AS target, count(*) AS calls FROM s WHERE kind = 3 AND service <> coalesce(peer, db_system) GROUP BY 1, 2)"
_BASE = f"b AS ({_EX}), m AS (SELECT quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM b)"
_BASELINE = "SELECT trace_id, duration_ms FROM b, m WHERE NOT is_error AND abs(duration_ms - p50) < 0.1 * p50 ORDER BY abs(duration_ms - p50), trace_id LIMIT 5"
_OUTLIERS = "SELECT trace_id, duration_ms FROM b, m WHERE duration_ms >= p95 ORDER BY duration_ms DESC, trace_id LIMIT 5"

QUERIES = {
    "aggregate_metrics": (
        _orders(lambda s: O.aggregate_metrics(s, ORDERS_END, ORDERS_HOURS, exact=True)),
        Q.with_orders(f"SELECT service AS service_name, {Q.COUNTS}, {Q.LATENCY}, round(avg(ms), 2) AS avg_ms, min(start_time) AS first_seen, max(start_time) AS last_seen FROM s WHERE parent_span_id IS NULL GROUP BY 1 ORDER BY error_rate_pct DESC, p99_ms DESC, service_name LIMIT 50"),
    ),
    "aggregate_metrics_by_operation": (
        _events(lambda s: O.aggregate_metrics(s, EVENTS_END, 24 * 31, group_by="operation_name", min_duration_ms=5, exact=True)),
        Q.with_events(f"SELECT name AS operation_name, {Q.COUNTS}, {Q.LATENCY}, round(avg(ms), 2) AS avg_ms, min(start_time) AS first_seen, max(start_time) AS last_seen FROM s WHERE start_time >= TIMESTAMP '2023-12-31' AND duration_nano >= 5000000 GROUP BY 1 ORDER BY error_rate_pct DESC, p99_ms DESC, operation_name LIMIT 50"),
    ),
    "service_stats_all_spans": (
        _orders(lambda s: O.service_stats_all_spans(s, "1990-01-01", ORDERS_END, exact=True)),
        Q.with_orders(f"SELECT service AS service_name, count(*) AS span_count, round(avg(ms), 2) AS avg_ms, {Q.LATENCY}, count(*) FILTER (is_error) AS error_count FROM s WHERE start_time BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '2001-12-31' GROUP BY 1"),
    ),
    "baseline_traces_near_p50": (
        _orders(lambda s: O.baseline_traces_near_p50(s, "svc-1", 20)),
        Q.with_orders("b AS (SELECT trace_id, ms AS duration_ms FROM s WHERE parent_span_id IS NULL AND service = 'svc-1'), m AS (SELECT quantile_cont(duration_ms, 0.5) AS p50 FROM b) SELECT trace_id, duration_ms FROM b, m ORDER BY abs(duration_ms - p50), trace_id LIMIT 20"),
    ),
    "anomaly_traces_p99_or_error": (
        _orders(lambda s: O.anomaly_traces_p99_or_error(s, "svc-1", 50)),
        Q.with_orders("b AS (SELECT trace_id, ms AS duration_ms, is_error FROM s WHERE parent_span_id IS NULL AND service = 'svc-1'), m AS (SELECT quantile_cont(duration_ms, 0.99) AS p99 FROM b) SELECT trace_id, duration_ms, is_error FROM b, m WHERE duration_ms >= p99 OR is_error ORDER BY duration_ms DESC, trace_id LIMIT 50"),
    ),
    "exemplars_outliers": (
        _orders(lambda s: O.exemplars(s, ORDERS_END, "outliers", ORDERS_HOURS, limit=25, exact=True)),
        Q.with_orders(f"{_BASE} SELECT trace_id, service_name, name, duration_ms, round((duration_ms - p95) / p95 * 100, 2) AS pct_above_p95 FROM b, m WHERE duration_ms >= p95 ORDER BY duration_ms DESC, trace_id LIMIT 25"),
    ),
    "exemplars_errors": (
        _orders(lambda s: O.exemplars(s, ORDERS_END, "errors", ORDERS_HOURS, limit=25)),
        Q.with_orders(f"b AS ({_EX}) SELECT trace_id, service_name, name, duration_ms, 'error_trace' AS selection_reason FROM b WHERE is_error ORDER BY start_time DESC, trace_id LIMIT 25"),
    ),
    "exemplars_baseline": (
        _orders(lambda s: O.exemplars(s, ORDERS_END, "baseline", ORDERS_HOURS, limit=25, exact=True)),
        Q.with_orders(f"{_BASE} SELECT trace_id, service_name, name, duration_ms FROM b, m WHERE NOT is_error AND abs(duration_ms - p50) < 0.1 * p50 ORDER BY abs(duration_ms - p50), trace_id LIMIT 25"),
    ),
    "exemplars_comparison": (
        _orders(lambda s: O.exemplars(s, ORDERS_END, "comparison", ORDERS_HOURS, limit=10, exact=True)),
        Q.with_orders(f"{_BASE} SELECT *, 'baseline' AS selection_reason FROM ({_BASELINE}) UNION ALL SELECT *, 'outliers' FROM ({_OUTLIERS})"),
    ),
    "compare_time_periods": (
        _events(lambda s: O.compare_time_periods(s, EVENTS_END, (24 * 14, 24 * 7), (24 * 7, 0), exact=True)),
        Q.with_events(
            f"g AS (SELECT service AS service_name, period, {Q.COUNTS}, round(quantile_disc(ms, 0.95), 2) AS p95_ms FROM (SELECT *, CASE WHEN start_time < TIMESTAMP '2024-01-24' THEN 'baseline' ELSE 'anomaly' END AS period FROM s WHERE start_time >= TIMESTAMP '2024-01-17') GROUP BY 1, 2) "
            "SELECT service_name, period, request_count, error_count, error_rate_pct, p95_ms, round(p95_ms - o, 2) AS p95_delta_ms, round((p95_ms - o) / o * 100, 1) AS p95_change_pct, round(error_rate_pct - r, 2) AS error_rate_delta FROM (SELECT *, lag(p95_ms) OVER w AS o, lag(error_rate_pct) OVER w AS r FROM g WINDOW w AS (PARTITION BY service_name ORDER BY period DESC))"
        ),
    ),
    "trend_changes": (
        _events(lambda s: O.trend_changes(s, EVENTS_END, 24 * 31, "p95", 1, exact=True)),
        Q.with_events(
            "g AS (SELECT date_trunc('hour', start_time) AS bucket, count(*) AS sample_count, round(quantile_disc(ms, 0.95), 2) AS value FROM s WHERE start_time >= TIMESTAMP '2023-12-31' GROUP BY 1 HAVING count(*) >= 10), "
            "h AS (SELECT *, avg(value) OVER (ORDER BY bucket ROWS 2 PRECEDING) AS a, lag(value) OVER (ORDER BY bucket) AS o FROM g) "
            "SELECT bucket, sample_count, value, round(a, 6) AS moving_avg, round(value - o, 2) AS delta, round((value - o) / o * 100, 1) AS pct_change, CASE WHEN abs((value - o) / o * 100) >= 20 THEN 'SIGNIFICANT' WHEN abs((value - o) / o * 100) >= 10 THEN 'MODERATE' ELSE 'STABLE' END AS change_class FROM h"
        ),
    ),
    "trend_changes_error_rate_4h": (
        _events(lambda s: O.trend_changes(s, EVENTS_END, 24 * 31, "error_rate", 4)),
        Q.with_events(
            "g AS (SELECT time_bucket(INTERVAL 4 HOUR, start_time, TIMESTAMP '1970-01-01') AS bucket, count(*) AS sample_count, round(count(*) FILTER (is_error) / count(*) * 100, 2) AS value FROM s WHERE start_time >= TIMESTAMP '2023-12-31' GROUP BY 1 HAVING count(*) >= 10), "
            "h AS (SELECT *, avg(value) OVER (ORDER BY bucket ROWS 2 PRECEDING) AS a, lag(value) OVER (ORDER BY bucket) AS o FROM g), k AS (SELECT *, CASE WHEN o <> 0 THEN (value - o) / o * 100 END AS c FROM h) "
            "SELECT bucket, sample_count, value, round(a, 6) AS moving_avg, round(value - o, 2) AS delta, round(c, 1) AS pct_change, CASE WHEN abs(c) >= 20 THEN 'SIGNIFICANT' WHEN abs(c) >= 10 THEN 'MODERATE' ELSE 'STABLE' END AS change_class FROM k"
        ),
    ),
    "span_events": (
        _orders(lambda s: O.span_events(s, "exception", limit=100)),
        Q.with_orders("SELECT trace_id, span_id, service AS service_name, name AS span_name, 'exception' AS event_name, start_time AS event_time, exc_type AS exception_type, exc_message AS exception_message, CAST(NULL AS VARCHAR) AS exception_stacktrace FROM s WHERE exc_type IS NOT NULL ORDER BY start_time DESC, span_id LIMIT 100"),
    ),
    "exception_patterns": (
        _orders(lambda s: O.exception_patterns(s)),
        Q.with_orders(f"SELECT exc_type AS exception_type, count(*) AS exception_count, count(DISTINCT trace_id) AS affected_traces, count(DISTINCT service) AS affected_services, {Q.sample('exc_message')} AS sample_messages FROM s WHERE exc_type IS NOT NULL GROUP BY 1"),
    ),
    "exception_patterns_by_service": (
        _orders(lambda s: O.exception_patterns(s, "service_name")),
        Q.with_orders(f"SELECT service AS service_name, count(*) AS exception_count, count(DISTINCT trace_id) AS affected_traces, count(DISTINCT service) AS affected_services, {Q.sample('exc_message')} AS sample_messages FROM s WHERE exc_type IS NOT NULL GROUP BY 1"),
    ),
    "span_links": (
        _orders(lambda s: O.span_links(s, 100)),
        Q.with_orders("""SELECT trace_id, span_id, service AS service_name, name AS span_name, linked AS linked_trace_id, CAST(NULL AS VARCHAR) AS linked_span_id, 'previous' AS link_type, CAST(NULL AS VARCHAR) AS link_reason, '{"type":"previous"}' AS link_attributes FROM s WHERE linked IS NOT NULL ORDER BY trace_id, span_id LIMIT 100"""),
    ),
    "link_patterns": (
        _orders(O.link_patterns),
        Q.with_orders("SELECT service AS service_name, count(*) AS spans_with_links, count(*) AS total_links, 1.0::DOUBLE AS avg_links_per_span FROM s WHERE linked IS NOT NULL GROUP BY 1"),
    ),
    "instrumentation_libraries": (
        _orders(O.instrumentation_libraries),
        Q.with_orders(f"SELECT scope AS library_name, '1' AS library_version, CAST(NULL AS VARCHAR) AS library_schema_url, count(*) AS span_count, count(DISTINCT service) AS service_count, count(DISTINCT trace_id) AS trace_count, {Q.sample('service')} AS sample_services FROM s GROUP BY 1"),
    ),
    "http_attributes": (
        _orders(lambda s: O.http_attributes(s, exact=True)),
        Q.with_orders(f"SELECT http_method, http_target, http_status, count(*) AS request_count, {Q.LATENCY}, CAST(NULL AS DOUBLE) AS avg_request_size, CAST(NULL AS DOUBLE) AS avg_response_size FROM s WHERE kind = 2 GROUP BY 1, 2, 3 HAVING count(*) >= 10"),
    ),
    "database_operations": (
        _orders(lambda s: O.database_operations(s, exact=True)),
        Q.with_orders("SELECT db_system, db_name, db_operation, count(*) AS call_count, round(avg(ms), 2) AS avg_ms, round(quantile_disc(ms, 0.95), 2) AS p95_ms, '' AS sample_statements, CAST(NULL AS VARCHAR) AS any_statement FROM s WHERE kind = 3 GROUP BY 1, 2, 3"),
    ),
    "service_level_stats": (
        _orders(O.service_level_stats),
        Q.with_orders("SELECT service AS service_name, count(*) AS span_count, 0.0::DOUBLE AS error_rate, round(avg(ms), 2) AS avg_latency_ms FROM s GROUP BY 1"),
    ),
    "bottleneck_services": (
        _orders(lambda s: O.bottleneck_services(s, 10, 20, exact=True)),
        Q.with_orders(
            "t AS (SELECT trace_id, sum(ms) FILTER (parent_span_id IS NULL) AS trace_ms FROM s GROUP BY 1 HAVING count(*) >= 2), "
            "f AS (SELECT s.*, ms / trace_ms * 100 AS share, NOT EXISTS (SELECT 1 FROM s c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.span_id) AS leaf FROM s JOIN t USING (trace_id)), "
            "g AS (SELECT service AS service_name, name AS operation_name, count(DISTINCT trace_id) AS trace_count, round(avg(share), 2) AS avg_contribution_pct, round(quantile_disc(share, 0.95), 2) AS p95_contribution_pct, round(avg(ms), 2) AS avg_ms, round(quantile_disc(ms, 0.95), 2) AS p95_ms, count(*) FILTER (leaf) AS leaf_count, round(count(*) FILTER (is_error) / count(*) * 100, 2) AS error_rate_pct FROM f GROUP BY 1, 2 HAVING count(DISTINCT trace_id) >= 10) "
            "SELECT *, round(0.4::DOUBLE * avg_contribution_pct + 0.3::DOUBLE * p95_contribution_pct / 100 + 0.3::DOUBLE * trace_count / 10, 2) AS bottleneck_score FROM g ORDER BY bottleneck_score DESC, service_name, operation_name LIMIT 20"
        ),
    ),
    "critical_path_contribution": (
        _orders(lambda s: O.critical_path_contribution(s, "svc-3", exact=True)),
        Q.with_orders(
            "t AS (SELECT trace_id, max(ms) AS trace_ms FROM s WHERE parent_span_id IS NULL GROUP BY 1), f AS (SELECT s.*, trace_ms, ms / trace_ms * 100 AS share FROM s JOIN t USING (trace_id) WHERE service = 'svc-3'), "
            "g AS (SELECT service AS service_name, name AS operation_name, count(*) AS span_count, round(avg(ms), 2) AS avg_ms, " + Q.LATENCY + ", round(avg(share), 2) AS avg_contribution_pct, round(quantile_disc(share, 0.5), 2) AS p50_contribution_pct, round(quantile_disc(share, 0.95), 2) AS p95_contribution_pct, round(avg(trace_ms), 2) AS avg_trace_ms, round(count(*) FILTER (is_error) / count(*) * 100, 2) AS error_rate_pct FROM f GROUP BY 1, 2) "
            "SELECT *, round(avg_ms * avg_contribution_pct / 100, 2) AS weighted_impact FROM g"
        ),
    ),
    "latency_histogram": (
        _orders(lambda s: O.latency_histogram(s, exact=True)),
        Q.with_orders("SELECT service AS service_name, " + ", ".join(f"count(*) FILTER (ms <= {b}) AS le_{b}" for b in O.LATENCY_BOUNDS) + f", count(*) AS le_inf, {Q.LATENCY} FROM s GROUP BY 1"),
    ),
    "latency_exemplars_by_percentile": (
        _orders(lambda s: O.latency_exemplars_by_percentile(s, 95, 40, exact=True)),
        Q.with_orders(
            "r AS (SELECT trace_id, service AS service_name, ms, percent_rank() OVER (PARTITION BY service ORDER BY ms) * 100 AS p FROM s WHERE parent_span_id IS NULL AND kind = 2), m AS (SELECT service_name, round(quantile_disc(ms, 0.95), 2) AS service_p95_ms, round(quantile_disc(ms, 0.99), 2) AS service_p99_ms FROM r GROUP BY 1) "
            "SELECT trace_id, service_name, round(ms, 2) AS duration_ms, round(p, 2) AS percentile, CASE " + " ".join(f"WHEN ms <= {b} THEN '<={b}ms'" for b in O.LATENCY_BOUNDS) + " ELSE '+Inf' END AS latency_bucket, service_p95_ms, service_p99_ms FROM r JOIN m USING (service_name) WHERE p >= 95 ORDER BY duration_ms DESC, trace_id LIMIT 40"
        ),
    ),
    "dependency_edges": (
        _orders(lambda s: N.dependency_edges(s, 5, exact=True)),
        Q.with_orders(
            f"g AS (SELECT service AS source_service, coalesce(peer, db_system) AS target_service, CASE WHEN db_system IS NOT NULL THEN 'DATABASE' WHEN rpc_system IS NOT NULL THEN 'RPC' WHEN http_method IS NOT NULL THEN 'HTTP' ELSE 'INTERNAL' END AS call_type, count(*) AS call_count, count(DISTINCT trace_id) AS trace_count, round(avg(ms), 2) AS avg_latency_ms, round(quantile_disc(ms, 0.95), 2) AS p95_latency_ms, round(count(*) FILTER (is_error) / count(*) * 100, 2) AS error_rate_pct, {Q.sample('name')} AS sample_operations FROM s WHERE kind = 3 AND service <> coalesce(peer, db_system) GROUP BY 1, 2, 3 HAVING count(*) >= 5), "
            "w AS (SELECT *, round(call_count / sum(call_count) OVER (PARTITION BY source_service) * 100, 2) AS dependency_weight_pct FROM g) "
            "SELECT *, CASE WHEN error_rate_pct > 5 THEN 'UNHEALTHY' WHEN error_rate_pct > 1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS dependency_health, CASE WHEN dependency_weight_pct > 50 THEN 'CRITICAL' WHEN dependency_weight_pct > 20 THEN 'HIGH' WHEN dependency_weight_pct > 5 THEN 'MEDIUM' ELSE 'LOW' END AS criticality FROM w"
        ),
    ),
    "topology_roles": (
        _orders(N.topology_roles),
        Q.with_orders(f"{_PAIRS}, v AS (SELECT DISTINCT service AS service_name FROM s UNION SELECT target FROM p) SELECT service_name, CASE WHEN service_name IN (SELECT source FROM p) AND service_name IN (SELECT target FROM p) THEN 'INTERMEDIATE' WHEN service_name IN (SELECT source FROM p) THEN 'ENTRY_POINT' WHEN service_name IN (SELECT target FROM p) THEN 'LEAF' ELSE 'ISOLATED' END AS role FROM v"),
    ),
    "upstream_downstream": (
        _orders(lambda s: N.upstream_downstream(s, "svc-4", 2)),
        Q.with_orders(
            f"{_PAIRS}, e AS (SELECT 'UPSTREAM' AS direction, target AS here, source AS nxt, calls FROM p UNION ALL SELECT 'DOWNSTREAM', source, target, calls FROM p), "
            "a AS (SELECT direction, nxt AS service_name, ['svc-4', nxt] AS path, calls FROM e WHERE here = 'svc-4'), b AS (SELECT a.direction, e.nxt AS service_name, list_append(a.path, e.nxt) AS path, e.calls FROM a JOIN e ON e.direction = a.direction AND e.here = a.service_name WHERE NOT list_contains(a.path, e.nxt)) "
            "SELECT direction, service_name, d AS depth, array_to_string(path, ' -> ') AS path, calls, CASE WHEN d = 1 THEN 'DIRECT_' ELSE 'INDIRECT_' END || CASE direction WHEN 'UPSTREAM' THEN 'CALLER' ELSE 'DEPENDENCY' END AS relationship FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, 2 FROM b)"
        ),
    ),
    "circular_dependencies": (
        _orders(N.circular_dependencies),
        Q.with_orders(
            f"{_PAIRS} SELECT 2 AS cycle_length, a.source || ' -> ' || a.target || ' -> ' || a.source AS cycle_path FROM p a JOIN p b ON a.target = b.source AND b.target = a.source WHERE a.target > a.source "
            "UNION ALL SELECT 3, a.source || ' -> ' || a.target || ' -> ' || b.target || ' -> ' || a.source FROM p a JOIN p b ON a.target = b.source JOIN p c ON b.target = c.source AND c.target = a.source WHERE a.target > a.source AND b.target > a.source AND b.target <> a.target "
            "UNION ALL SELECT 4, a.source || ' -> ' || a.target || ' -> ' || b.target || ' -> ' || c.target || ' -> ' || a.source FROM p a JOIN p b ON a.target = b.source JOIN p c ON b.target = c.source JOIN p d ON c.target = d.source AND d.target = a.source WHERE a.target > a.source AND b.target > a.source AND c.target > a.source AND b.target <> a.target AND c.target <> a.target AND c.target <> b.target"
        ),
    ),
    "hidden_dependencies": (
        _orders(lambda s: N.hidden_dependencies(s, 3, exact=True)),
        Q.with_orders(
            f"g AS (SELECT service AS source_service, coalesce(peer, db_system) AS target_identifier, CASE WHEN db_system IS NOT NULL THEN 'DATABASE' WHEN rpc_system = 'grpc' THEN 'GRPC_SERVICE' ELSE 'INTERNAL_SERVICE' END AS dependency_type, db_system, db_name, CAST(NULL AS VARCHAR) AS http_host, CAST(NULL AS VARCHAR) AS queue_name, count(*) AS call_count, count(DISTINCT name) AS unique_operations, round(avg(ms), 2) AS avg_latency_ms, round(quantile_disc(ms, 0.95), 2) AS p95_latency_ms, round(count(*) FILTER (is_error) / count(*) * 100, 2) AS error_rate_pct, {Q.sample('name')} AS sample_operations FROM s WHERE kind = 3 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3) "
            "SELECT *, CASE dependency_type WHEN 'DATABASE' THEN db_system || '/' || coalesce(db_name, 'unknown') ELSE target_identifier END AS target_details, CASE WHEN error_rate_pct > 5 THEN 'HIGH' WHEN call_count > 1000 THEN 'MEDIUM' ELSE 'LOW' END AS documentation_priority FROM g"
        ),
    ),
    "blast_radius": (
        _orders(lambda s: N.blast_radius(s, 2)),
        Q.with_orders(
            f"{_PAIRS}, a AS (SELECT target AS origin, source AS v, calls, 1 AS d FROM p), b AS (SELECT a.origin, p.source AS v, p.calls, 2 AS d FROM a JOIN p ON p.target = a.v WHERE p.source <> a.origin AND p.source <> a.v), u AS (SELECT origin, v, min(d) AS d, sum(calls) FILTER (d = 1) AS calls FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) "
            "SELECT origin AS service_name, count(*) AS affected_services, max(d) AS max_depth, CAST(sum(calls) AS BIGINT) AS direct_calls FROM u GROUP BY 1"
        ),
    ),
}
