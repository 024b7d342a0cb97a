"""The derived tables of ``sources.adapters`` as ANSI SQL."""

SPANS_FROM_ORDERS = """
items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
spans AS (
  SELECT 't' || o_orderkey AS trace_id, 'o' || o_orderkey AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'order ' || o_orderpriority AS name, 2 AS kind,
    CAST(o_orderdate AS TIMESTAMP) AS start_time, CAST(round(o_totalprice * 1000) AS BIGINT) AS duration_nano, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS code,
    'svc-' || (o_custkey % 13) AS service, 'orders' AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method, '/' || o_orderpriority AS http_target,
    CASE WHEN o_orderstatus = 'F' THEN '500' ELSE '200' END AS http_status, CAST(NULL AS VARCHAR) AS peer, CAST(NULL AS VARCHAR) AS db_system, CAST(NULL AS VARCHAR) AS db_name,
    CAST(NULL AS VARCHAR) AS db_operation, CAST(NULL AS VARCHAR) AS rpc_system, CAST(NULL AS VARCHAR) AS exc_type, CAST(NULL AS VARCHAR) AS exc_message, CAST(NULL AS VARCHAR) AS linked
  FROM orders
  UNION ALL
  SELECT 't' || l_orderkey, 'l' || l_orderkey || '-' || rn, CASE WHEN rn % 3 = 1 THEN 'o' || l_orderkey ELSE 'l' || l_orderkey || '-' || (rn - 1) END, 'item ' || (l_partkey % 20), 3,
    CAST(o_orderdate AS TIMESTAMP) + to_milliseconds(CAST(20 * rn AS BIGINT)), CAST(l_quantity * 1000000 AS BIGINT), CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END,
    'svc-' || (l_suppkey % 10), 'items-' || (l_suppkey % 3), CASE WHEN l_partkey % 3 = 2 THEN 'GET' END, NULL, NULL, 'svc-' || (2 + l_partkey % 10),
    CASE WHEN l_partkey % 3 = 0 THEN 'postgresql' END, CASE WHEN l_partkey % 3 = 0 THEN 'db' || (l_suppkey % 4) END, CASE WHEN l_partkey % 3 = 0 THEN l_linestatus END,
    CASE WHEN l_partkey % 3 = 1 THEN 'grpc' END, CASE WHEN l_returnflag = 'R' THEN 'Err' || (l_partkey % 5) END, CASE WHEN l_returnflag = 'R' THEN 'part ' || (l_partkey % 50) END,
    CASE WHEN l_discount >= 0.09 THEN 't' || (l_orderkey - 1) END
  FROM items JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT *, duration_nano / 1000000.0::DOUBLE AS ms, code = 2 AS is_error, start_time + to_microseconds(duration_nano // 1000) AS end_time FROM spans)
"""

SPANS_FROM_EVENTS = """
s AS (
  SELECT *, duration_nano / 1000000.0::DOUBLE AS ms, code = 2 AS is_error, start_time + to_microseconds(duration_nano // 1000) AS end_time FROM (
    SELECT 'e' || event_id AS trace_id, 'e' || event_id AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, event_type AS name, 2 AS kind, CAST(ts AS TIMESTAMP) AS start_time,
      CAST(round(value * 1000000) AS BIGINT) AS duration_nano, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS code, 'svc-' || (user_id % 10) AS service FROM events))
"""

LOGS_FROM_EVENTS = """
logs AS (
  SELECT CAST(ts AS TIMESTAMP) AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity, 'svc-' || (user_id % 10) AS service,
    CASE WHEN event_id % 4 <> 0 THEN 'e' || event_id END AS trace_id, 'i' || event_id AS insert_id, user_id, event_id,
    'event ' || event_type || ' user ' || user_id || ' took ' || CAST(value AS DECIMAL(18,2)) || 'ms props ' || props AS body FROM events)
"""

LOGS_FROM_CONVERSATIONS = """
lines AS (
  SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS message, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations),
talk AS (
  SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS BIGINT)) + to_seconds(CAST(line AS BIGINT)) AS timestamp,
    CASE role WHEN 'assistant' THEN 'INFO' WHEN 'user' THEN 'WARNING' ELSE 'ERROR' END AS severity, message, 'conv-' || (conv_id % 10) AS resource_id FROM lines)
"""


def with_orders(rest: str) -> str:
    return f"WITH {SPANS_FROM_ORDERS} {_join(rest)}"


def with_events(rest: str) -> str:
    return f"WITH {SPANS_FROM_EVENTS} {_join(rest)}"


def with_logs(rest: str) -> str:
    return f"WITH {LOGS_FROM_EVENTS} {_join(rest)}"


def with_events_and_logs(rest: str) -> str:
    return f"WITH {SPANS_FROM_EVENTS}, {LOGS_FROM_EVENTS} {_join(rest)}"


def with_talk(rest: str) -> str:
    return f"WITH {LOGS_FROM_CONVERSATIONS} {_join(rest)}"


def _join(rest: str) -> str:
    """Further table expressions follow with a comma, a SELECT without."""
    rest = rest.strip()
    return rest if rest.upper().startswith("SELECT") else f", {rest}"


LATENCY = "round(quantile_disc(ms, 0.5), 2) AS p50_ms, round(quantile_disc(ms, 0.95), 2) AS p95_ms, round(quantile_disc(ms, 0.99), 2) AS p99_ms"
COUNTS = "count(*) AS request_count, count(*) FILTER (is_error) AS error_count, round(count(*) FILTER (is_error) / count(*) * 100, 2) AS error_rate_pct"


def sample(col: str, n: int = 5) -> str:
    return f"array_to_string(list_slice(list_sort(list(DISTINCT {col}) FILTER ({col} IS NOT NULL)), 1, {n}), ',')"
