"""Trace and tree operators over the order traces; pairs are consecutive orders of a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import traces as O
from ..operators import tree as T
from ..sources.adapters import spans_from_events, spans_from_orders
from . import sql as Q


def _orders(f):
    return lambda spark, d: f(spans_from_orders(spark, d))


def customer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"))
    return o.filter("before is not null").select(F.concat(F.lit("t"), "before").alias("baseline_trace_id"), F.concat(F.lit("t"), "o_orderkey").alias("target_trace_id"))


def customer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the three orders of its customer before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.array(*[F.lag("o_orderkey", k).over(w) for k in (1, 2, 3)]).alias("before")).select("o_orderkey", F.explode("before").alias("b"))
    return o.filter("b is not null").select(F.concat(F.lit("t"), "o_orderkey").alias("target_trace_id"), F.concat(F.lit("t"), "b").alias("baseline_trace_id"))


def _pairs(f):
    return lambda spark, d: f(spans_from_orders(spark, d), customer_pairs(spark, d))


PAIRS = "pairs AS (SELECT 't' || b AS baseline_trace_id, 't' || o_orderkey AS target_trace_id FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)"
_MS = "epoch_us({})::DOUBLE / 1000"
_TRACE_MS = f"({_MS.format('max(end_time)')} - {_MS.format('min(start_time)')})"
_DEPTHS = (
    "d(trace_id, span_id, depth) AS (SELECT trace_id, span_id, 0 FROM s WHERE parent_span_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, d.depth + 1 FROM s JOIN d ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id)"
)
_E = "SELECT *, epoch_us(start_time)::DOUBLE / 1000 AS start_ms, epoch_us(end_time)::DOUBLE / 1000 AS end_ms FROM s"
_LONGEST = (
    "busy AS (SELECT trace_id, parent_span_id AS span_id, sum(ms) AS child_ms FROM s WHERE parent_span_id IS NOT NULL GROUP BY 1, 2), "
    "x AS (SELECT s.*, greatest(0.0::DOUBLE, ms - coalesce(child_ms, 0.0)) AS self_ms, row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY ms DESC, start_time, span_id) AS rk FROM s LEFT JOIN busy USING (trace_id, span_id)), "
    "w AS (SELECT trace_id, span_id, 0 AS depth, name, service, ms, self_ms, is_error FROM x WHERE parent_span_id IS NULL AND rk = 1 UNION ALL SELECT x.trace_id, x.span_id, w.depth + 1, x.name, x.service, x.ms, x.self_ms, x.is_error FROM x JOIN w ON x.trace_id = w.trace_id AND x.parent_span_id = w.span_id WHERE x.rk = 1), "
    "cp AS (SELECT trace_id, span_id, depth, name, service AS service_name, ms AS duration_ms, self_ms AS self_time_ms, round(CASE WHEN sum(self_ms) OVER t <> 0 THEN self_ms / sum(self_ms) OVER t END * 100, 1) AS self_time_pct, self_ms = max(self_ms) OVER t AS is_bottleneck, is_error FROM w WINDOW t AS (PARTITION BY trace_id))"
)
_SIBLINGS = "sib AS (SELECT trace_id, parent_span_id, service AS service_name, count(*) AS sibling_count, sum(ms) AS total_ms, max(ms) AS max_ms, sum(ms) - max(ms) AS savings_ms FROM s WHERE parent_span_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND sum(ms) - max(ms) > 10)"
_BLOCKING = (
    f"e AS ({_E}), k AS (SELECT trace_id, parent_span_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY trace_id, parent_span_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e WHERE parent_span_id IS NOT NULL), "
    "i AS (SELECT *, sum(CASE WHEN r IS NULL OR start_ms > r THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, parent_span_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM k), "
    "c AS (SELECT trace_id, parent_span_id AS span_id, sum(l) AS covered FROM (SELECT trace_id, parent_span_id, island, max(end_ms) - min(start_ms) AS l FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "y AS (SELECT e.*, greatest(0.0::DOUBLE, ms - coalesce(covered, 0.0)) AS self_ms FROM e LEFT JOIN c USING (trace_id, span_id)), "
    "b AS (SELECT trace_id, span_id AS root_id, span_id, ms AS root_ms, start_ms, end_ms, 0 AS depth, 1.0::DOUBLE AS weight, self_ms AS blocking, [span_id] AS path FROM y WHERE parent_span_id IS NULL UNION ALL "
    "SELECT y.trace_id, b.root_id, y.span_id, b.root_ms, y.start_ms, y.end_ms, b.depth + 1, b.weight * CASE WHEN b.end_ms - y.end_ms > 5 THEN 0.5 ELSE 1.0 END, b.blocking + b.weight * CASE WHEN b.end_ms - y.end_ms > 5 THEN 0.5 ELSE 1.0 END * y.self_ms, list_append(b.path, y.span_id) FROM y JOIN b ON y.trace_id = b.trace_id AND y.parent_span_id = b.span_id), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, root_id ORDER BY blocking DESC, depth, start_ms, span_id) AS rn FROM b) WHERE rn = 1)"
)
# ties as critical_path_blocking has them
_BLOCKING_TIES = _BLOCKING.replace("ORDER BY blocking DESC, depth", "ORDER BY round(blocking, 9) DESC, depth")


def half_up(x: str) -> str:
    """A ratio rounded half up to two places once it is taken to eight, so the order of a sum decides no rounding."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 8)), 2) AS DOUBLE)"


_CHAIN = (
    "h AS (SELECT *, ms >= 45 AS hit FROM s), "
    "w AS (SELECT trace_id, span_id, hit, CASE WHEN hit THEN [name] ELSE CAST([] AS VARCHAR[]) END AS names, CASE WHEN hit THEN ms ELSE 0.0 END AS total FROM h WHERE parent_span_id IS NULL UNION ALL "
    "SELECT h.trace_id, h.span_id, h.hit, CASE WHEN h.hit THEN list_concat([h.name], w.names) ELSE w.names END, w.total + CASE WHEN h.hit THEN h.ms ELSE 0.0 END FROM h JOIN w ON h.trace_id = w.trace_id AND h.parent_span_id = w.span_id), "
    "ch AS (SELECT *, len(names) AS n FROM w WHERE hit AND len(names) >= 2), "
    "casc AS (SELECT trace_id, n AS chain_length, names[1] AS origin_span, array_to_string(names, ',') AS affected_spans, round(total, 3) AS total_timeout_ms FROM ch a WHERE NOT EXISTS (SELECT 1 FROM ch b WHERE b.trace_id = a.trace_id AND (b.n > a.n OR b.n = a.n AND b.span_id < a.span_id) AND list_has_all(b.names, a.names)))"
)
_RETRY = (
    f"e AS ({_E}), q AS (SELECT *, lag(end_ms) OVER z AS pe, lag(ms) OVER z AS pm FROM e WINDOW z AS (PARTITION BY trace_id, name ORDER BY start_ms, span_id)), "
    "g AS (SELECT trace_id, name AS span_name, count(*) AS retry_count, 1 + count(*) FILTER (start_ms - pe >= 0 AND start_ms - pe < 1000) AS sequential, count(*) FILTER (pm > 1.5 * ms) AS drops, round(sum(ms), 2) AS total_ms FROM q GROUP BY 1, 2), "
    "rs AS (SELECT trace_id, span_name, retry_count, sequential, total_ms, retry_count >= 3 AND drops = 0 AS has_exponential_backoff, CASE WHEN retry_count >= 5 THEN 'high' ELSE 'medium' END AS impact FROM g WHERE retry_count >= 2 AND sequential >= 2)"
)
_POOL = (
    "pi AS (SELECT trace_id, span_id, name AS span_name, round(ms, 2) AS wait_ms, CAST(NULL AS VARCHAR) AS pool_size, CAST(NULL AS VARCHAR) AS active_connections, CAST(NULL AS VARCHAR) AS waiting_requests, CASE WHEN ms >= 500 THEN 'high' WHEN ms >= 200 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE contains(name, 'order') AND ms >= 100), "
    "pool AS (SELECT *, round(sum(wait_ms) OVER (PARTITION BY trace_id), 2) AS total_wait_ms, round(sum(wait_ms) OVER (PARTITION BY trace_id), 2) >= 300 AS pool_exhaustion FROM pi)"
)

_WORDS = ["order"]


def _cascade(spans: DataFrame) -> DataFrame:
    out = T.cascading_timeout(spans, 45)
    return out.withColumn("affected_spans", F.array_join("affected_spans", ",")).withColumn("total_timeout_ms", F.round("total_timeout_ms", 3))


def _blocking(spans: DataFrame) -> DataFrame:
    return T.critical_path_blocking(spans).withColumn("critical_path", F.array_join(F.transform("critical_path", lambda p: p["span_id"]), ">"))


def _stats_sql(key: str, source: str) -> str:
    picks = ", ".join(f"round(min(ms) FILTER (rn = least(floor(n * {p}), n - 1) + 1), 3) AS p{int(p * 100)}_ms" for p in (0.9, 0.95, 0.99))
    return (
        f"v AS ({source}), r AS (SELECT key, ms, row_number() OVER (PARTITION BY key ORDER BY ms) AS rn, count(*) OVER (PARTITION BY key) AS n FROM v) "
        f"SELECT key, count(*) AS n, round(min(ms), 3) AS min_ms, round(max(ms), 3) AS max_ms, round(avg(ms), 3) AS mean_ms, round(median(ms), 3) AS median_ms, {picks}, round(coalesce(stddev_samp(ms), 0.0), 3) AS stdev_ms, round(coalesce(var_samp(ms), 0.0), 3) AS variance FROM r GROUP BY key"
    )


QUERIES = {
    "list_traces": (
        _orders(lambda s: O.list_traces(s, 100, min_latency_ms=100, error_only=True)),
        Q.with_orders("SELECT trace_id, name, start_time, round(ms, 2) AS duration_ms, http_status AS status, http_target AS url FROM s WHERE parent_span_id IS NULL AND round(ms, 2) >= 100 AND is_error ORDER BY start_time DESC, trace_id LIMIT 100"),
    ),
    "trace_predicates": (
        _orders(lambda s: O.list_traces(s, 200, terms=[("root", F.col("name").startswith("order 1")), ("any", O.C.service() == "svc-7"), ("any", O.C.attr("db.name") == "db2"), ("root", O.C.ms() <= 300)])),
        Q.with_orders("SELECT trace_id, name, start_time, round(ms, 2) AS duration_ms, http_status AS status, http_target AS url FROM s WHERE parent_span_id IS NULL AND name LIKE 'order 1%' AND ms <= 300 AND trace_id IN (SELECT trace_id FROM s WHERE service = 'svc-7') AND trace_id IN (SELECT trace_id FROM s WHERE db_name = 'db2') ORDER BY start_time DESC, trace_id LIMIT 200"),
    ),
    "span_labels": (
        _orders(lambda s: s.select("span_id", O.C.kind_name().alias("kind"), O.C.status_name().alias("status"), O.C.call_type().alias("call_type"), O.C.dependency_type().alias("dependency_type"), O.C.span_service_name().alias("service"), O.C.target_service().alias("target"), O.C.error_by_labels().alias("http_error"), F.round(O.C.span_duration_ms(), 3).alias("duration_ms"))),
        Q.with_orders("SELECT span_id, CASE kind WHEN 2 THEN 'SERVER' ELSE 'CLIENT' END AS kind, CASE code WHEN 2 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN db_system IS NOT NULL THEN 'DATABASE' WHEN rpc_system IS NOT NULL THEN 'RPC' WHEN http_method IS NOT NULL THEN 'HTTP' ELSE 'INTERNAL' END AS call_type, CASE WHEN db_system IS NOT NULL THEN 'DATABASE' WHEN rpc_system = 'grpc' THEN 'GRPC_SERVICE' ELSE 'INTERNAL_SERVICE' END AS dependency_type, service, coalesce(peer, db_system, name) AS target, coalesce(http_status, '') = '500' AS http_error, round(epoch_us(end_time)::DOUBLE / 1000 - epoch_us(start_time)::DOUBLE / 1000, 3) AS duration_ms FROM s"),
    ),
    "extract_errors": (
        _orders(O.extract_errors),
        Q.with_orders("SELECT trace_id, span_id, name, 'http_error' AS error_type, http_status AS error_message FROM s WHERE http_status = '500'"),
    ),
    "validate_trace_quality": (
        _orders(O.validate_trace_quality),
        # microseconds from the root's start; a child hangs from the root or from the item before it, and starts after it
        "WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, CAST(l_quantity * 1000000 AS BIGINT) // 1000 AS us FROM lineitem), "
        "k AS (SELECT *, 20000 * rn + us AS ends, lag(20000 * rn + us) OVER (PARTITION BY l_orderkey ORDER BY rn) AS before FROM i) "
        "SELECT 't' || l_orderkey AS trace_id, 'l' || l_orderkey || '-' || rn AS span_id, 'clock_skew' AS issue FROM k JOIN orders ON l_orderkey = o_orderkey WHERE ends > CASE WHEN rn % 3 = 1 THEN CAST(round(o_totalprice * 1000) AS BIGINT) // 1000 ELSE before END",
    ),
    "validate_trace": (
        _orders(lambda s: O.validate_trace(s, max_spans=12, max_ms=300)),
        Q.with_orders(f"g AS (SELECT trace_id, count(*) AS span_count, {_TRACE_MS} AS d FROM s GROUP BY 1) SELECT trace_id, span_count, round(d, 3) AS duration_ms, span_count <= 12 AND d > 0 AND d <= 300 AS is_valid, concat_ws(',', CASE WHEN span_count > 12 THEN 'too_many_spans' END, CASE WHEN d <= 0 THEN 'no_duration' END, CASE WHEN d > 300 THEN 'too_long' END) AS issues FROM g"),
    ),
    "call_graph": (
        _orders(T.call_graph),
        Q.with_orders(f"z AS (SELECT 1), {_DEPTHS}, f AS (SELECT trace_id, max(n) AS m FROM (SELECT trace_id, parent_span_id, count(*) AS n FROM s WHERE parent_span_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1), g AS (SELECT trace_id, count(*) AS total_spans, count(DISTINCT name) AS distinct_names FROM s GROUP BY 1), e AS (SELECT trace_id, max(depth) AS max_depth, count(*) FILTER (depth = 0) AS root_count FROM d GROUP BY 1) SELECT trace_id, total_spans, root_count, max_depth, distinct_names, coalesce(m, 0) AS max_fan_out FROM g JOIN e USING (trace_id) LEFT JOIN f USING (trace_id)").replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "summarize_trace": (
        _orders(O.summarize_trace),
        Q.with_orders(f"SELECT trace_id, count(*) AS span_count, round({_TRACE_MS}, 3) AS duration_ms, count(*) FILTER (is_error) AS error_count, coalesce(array_to_string(list_slice(list(name ORDER BY start_time, span_id) FILTER (is_error), 1, 5), ','), '') AS error_spans, array_to_string(list_slice(list(name ORDER BY ms DESC, span_id), 1, 5), ',') AS slowest_spans FROM s GROUP BY 1"),
    ),
    "latency_statistics": (_orders(O.latency_statistics), Q.with_orders(_stats_sql("key", "SELECT name AS key, ms FROM s"))),
    "latency_statistics_of_traces": (_orders(lambda s: O.latency_statistics(s, "trace")), Q.with_orders(_stats_sql("key", f"SELECT 'trace' AS key, {_TRACE_MS} AS ms FROM s GROUP BY trace_id"))),
    "latency_anomalies": (
        _orders(O.latency_anomalies),
        Q.with_orders("g AS (SELECT name, avg(ms) AS m, coalesce(stddev_samp(ms), 0.0) AS sd FROM s GROUP BY 1), j AS (SELECT *, (ms - m) / sd AS z FROM s JOIN g USING (name) WHERE sd > 0) SELECT trace_id, span_id, name, round(ms, 3) AS duration_ms, round(z, 2) AS z_score, CASE WHEN z > 0 THEN 'slow' ELSE 'fast' END AS anomaly_type FROM j WHERE abs(z) > 2 AND ms > 50"),
    ),
    "anomalies_against_baselines": (
        lambda spark, d: O.anomalies_against_baselines(spans_from_orders(spark, d), customer_sets(spark, d), 1.5, 20),
        Q.with_orders(
            f"sets AS (SELECT * FROM (SELECT 't' || o_orderkey AS target_trace_id, unnest([lag(o_orderkey, 1) OVER w, lag(o_orderkey, 2) OVER w, lag(o_orderkey, 3) OVER w]) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE b IS NOT NULL), "
            f"wh AS (SELECT trace_id, {_TRACE_MS} AS ms FROM s GROUP BY 1), "
            "r AS (SELECT target_trace_id, 'trace' AS level, CAST(NULL AS VARCHAR) AS span_id, CAST(NULL AS VARCHAR) AS name, wh.ms, m, sd FROM wh JOIN (SELECT target_trace_id, avg(ms) AS m, coalesce(stddev_samp(ms), 0.0) AS sd FROM sets JOIN wh ON trace_id = 't' || b GROUP BY 1) ON trace_id = target_trace_id "
            "UNION ALL SELECT target_trace_id, 'span', s.span_id, s.name, s.ms, m, sd FROM s JOIN (SELECT target_trace_id, name, avg(ms) AS m, coalesce(stddev_samp(ms), 0.0) AS sd FROM sets JOIN s ON trace_id = 't' || b GROUP BY 1, 2) g ON trace_id = target_trace_id AND s.name = g.name), "
            "z AS (SELECT *, CASE WHEN sd > 0 THEN (ms - m) / sd WHEN ms > m THEN 100.0::DOUBLE WHEN ms < m THEN -100.0::DOUBLE ELSE 0.0::DOUBLE END AS z FROM r) "
            "SELECT target_trace_id, level, span_id, name, round(ms, 3) AS duration_ms, round(m, 3) AS baseline_mean_ms, round(sd, 3) AS baseline_stdev_ms, round(z, 2) AS z_score, abs(z) > 1.5 AS is_anomaly, CASE WHEN abs(z) > 1.5 THEN CASE WHEN z > 0 THEN 'slow' ELSE 'fast' END END AS anomaly_type FROM z WHERE level = 'trace' OR abs(z) > 1.5 AND ms > 20"
        ),
    ),
    "critical_path_longest_child": (_orders(T.critical_path_longest_child), Q.with_orders(f"{_LONGEST} SELECT * FROM cp").replace("WITH ", "WITH RECURSIVE ", 1)),
    "critical_path_blocking": (
        _orders(_blocking),
        Q.with_orders(f"{_BLOCKING_TIES} SELECT trace_id, root_id AS root_span_id, array_to_string(path, '>') AS critical_path, round(blocking, 8) AS total_critical_ms, round(root_ms, 8) AS trace_duration_ms, {half_up('root_ms / blocking')} AS parallelism_ratio, CASE WHEN root_ms / blocking > 1 THEN {half_up('(1 - 1 / (root_ms / blocking)) * 100')} ELSE 0.0 END AS parallelism_pct FROM best").replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "parallel_opportunities": (_orders(T.parallel_opportunities), Q.with_orders(f"{_SIBLINGS} SELECT * FROM sib")),
    "optimization_recommendations": (
        _orders(T.optimization_recommendations),
        Q.with_orders(
            f"{_LONGEST}, {_SIBLINGS}, f AS (SELECT trace_id, count(*) AS n, count(*) FILTER (is_error) AS errors, max(self_time_pct) AS share, arg_max(name, (self_time_ms, -depth)) AS b FROM cp GROUP BY 1), v AS (SELECT trace_id, round(sum(savings_ms), 2) AS savings FROM sib GROUP BY 1) "
            "SELECT trace_id, 'bottleneck' AS type, 'HIGH' AS priority, b AS target FROM f WHERE share > 0 UNION ALL SELECT trace_id, 'parallelization', 'MEDIUM', CAST(savings AS VARCHAR) FROM v JOIN f USING (trace_id) UNION ALL SELECT trace_id, 'errors', 'HIGH', CAST(errors AS VARCHAR) FROM f WHERE errors > 0 UNION ALL SELECT trace_id, 'path_length', 'LOW', CAST(n AS VARCHAR) FROM f WHERE n > 5"
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "compare_span_timings": (
        _pairs(O.compare_span_timings),
        Q.with_orders(
            f"{PAIRS}, g AS (SELECT baseline_trace_id, target_trace_id, name, avg(ms) FILTER (side = 0) AS b, avg(ms) FILTER (side = 1) AS t FROM (SELECT *, baseline_trace_id AS tid, 0 AS side FROM pairs UNION ALL SELECT *, target_trace_id, 1 FROM pairs) JOIN s ON tid = trace_id GROUP BY 1, 2, 3) "
            "SELECT baseline_trace_id, target_trace_id, name, round(b, 6) AS baseline_ms, round(t, 6) AS target_ms, round(t - b, 6) AS diff_ms, CASE WHEN t - b IS NOT NULL THEN round((t - b) / b * 100, 2) END AS diff_pct, CASE WHEN b IS NULL THEN 'new' WHEN t IS NULL THEN 'missing' WHEN (t - b) / b * 100 > 10 OR t - b > 50 THEN 'slower' WHEN (t - b) / b * 100 < -10 OR t - b < -50 THEN 'faster' ELSE 'same' END AS change FROM g"
        ),
    ),
    "n_plus_one": (
        _orders(lambda s: O.n_plus_one(s, min_run=2, min_ms=30)),
        Q.with_orders(
            "a AS (SELECT *, CASE WHEN name = lag(name) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS UNBOUNDED PRECEDING) AS run FROM a) "
            "SELECT trace_id, min(name) AS span_name, count(*) AS count, sum(ms) AS total_ms, CASE WHEN sum(ms) > 200 THEN 'high' ELSE 'medium' END AS impact FROM b GROUP BY trace_id, run HAVING count(*) >= 2 AND sum(ms) > 30"
        ),
    ),
    "serial_chains": (
        _orders(lambda s: O.serial_chains(s, 10, 2, 20)),
        Q.with_orders(
            f"e AS ({_E}), a AS (SELECT *, lag(end_ms) OVER w AS pe, lag(span_id) OVER w AS ps, lag(parent_span_id) OVER w AS pp FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)), "
            "b AS (SELECT *, CASE WHEN start_ms - pe BETWEEN 0 AND 10 AND NOT coalesce(ps = parent_span_id, false) AND NOT coalesce(span_id = pp, false) THEN 0 ELSE 1 END AS fresh FROM a), c AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS UNBOUNDED PRECEDING) AS chain FROM b) "
            "SELECT trace_id, array_to_string(list(name ORDER BY start_ms, span_id), ' > ') AS span_names, count(*) AS count, round(sum(ms), 2) AS total_ms, CASE WHEN sum(ms) > 500 THEN 'high' ELSE 'medium' END AS impact FROM c GROUP BY trace_id, chain HAVING count(*) >= 2 AND sum(ms) > 20"
        ),
    ),
    "structural_differences": (
        _pairs(O.structural_differences),
        Q.with_orders(
            f"{PAIRS}, {_DEPTHS}, g AS (SELECT trace_id, list(DISTINCT name) AS names, count(*) AS n, max(depth) AS depth FROM s JOIN d USING (trace_id, span_id) GROUP BY 1), "
            "j AS (SELECT baseline_trace_id, target_trace_id, array_to_string(list_sort(list_filter(b.names, lambda x: NOT list_contains(t.names, x))), ',') AS missing_names, array_to_string(list_sort(list_filter(t.names, lambda x: NOT list_contains(b.names, x))), ',') AS new_names, len(list_intersect(b.names, t.names)) AS common_names, t.n - b.n AS span_count_change, t.depth - b.depth AS depth_change FROM pairs JOIN g b ON b.trace_id = baseline_trace_id JOIN g t ON t.trace_id = target_trace_id) "
            "SELECT *, missing_names <> '' OR new_names <> '' OR depth_change <> 0 AS structure_changed FROM j"
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "retry_storm": (_orders(lambda s: O.retry_storm(s, 2)), Q.with_orders(f"{_RETRY} SELECT * FROM rs")),
    "cascading_timeout": (_orders(_cascade), Q.with_orders(f"{_CHAIN} SELECT * FROM casc").replace("WITH ", "WITH RECURSIVE ", 1)),
    "connection_pool_issues": (_orders(lambda s: O.connection_pool_issues(s, 100, _WORDS)), Q.with_orders(f"{_POOL} SELECT * FROM pool")),
    "all_patterns": (
        _orders(lambda s: O.all_patterns(s, _WORDS, with_healthy=False)),
        Q.with_orders(
            f"{_RETRY.replace('retry_count >= 2 AND sequential >= 2', 'retry_count >= 3 AND sequential >= 3')}, {_CHAIN.replace('ms >= 45', 'ms >= 1000')}, {_POOL}, "
            "u AS (SELECT trace_id, 1 AS k, CASE impact WHEN 'high' THEN 2 ELSE 1 END AS rk FROM rs UNION ALL SELECT trace_id, 2, 3 FROM casc UNION ALL SELECT trace_id, 3, CASE WHEN pool_exhaustion THEN 3 WHEN severity = 'high' THEN 2 ELSE 1 END FROM pool) "
            "SELECT trace_id, count(*) FILTER (k = 1) AS retry_storms, count(*) FILTER (k = 2) AS cascading_timeouts, count(*) FILTER (k = 3) AS connection_pool_issues, CASE max(rk) WHEN 3 THEN 'critical' WHEN 2 THEN 'degraded' ELSE 'warning' END AS health FROM u GROUP BY 1"
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "causal_analysis": (
        _pairs(T.causal_analysis),
        Q.with_orders(
            f"{PAIRS}, {_DEPTHS}, {_BLOCKING}, base AS (SELECT baseline_trace_id, target_trace_id, name, avg(ms) AS bm FROM pairs JOIN s ON trace_id = baseline_trace_id GROUP BY 1, 2, 3), onp AS (SELECT trace_id, unnest(path) AS span_id FROM best), "
            "j AS (SELECT baseline_trace_id, target_trace_id, y.span_id, y.name, ms - bm AS diff, (ms - bm) / bm * 100 AS pct, d.depth, y.self_ms, o.span_id IS NOT NULL AS onpath FROM base JOIN y ON y.trace_id = target_trace_id AND y.name = base.name JOIN d ON d.trace_id = y.trace_id AND d.span_id = y.span_id LEFT JOIN onp o ON o.trace_id = y.trace_id AND o.span_id = y.span_id), "
            "scored AS (SELECT *, diff * least(1 + 0.1::DOUBLE * depth, 1.5::DOUBLE) * CASE WHEN onpath THEN 2.0::DOUBLE ELSE 1.0 END * CASE WHEN onpath AND self_ms > 0.3::DOUBLE * diff THEN 1.3::DOUBLE ELSE 1.0 END AS score FROM j WHERE diff >= 10 OR pct >= 10), r AS (SELECT *, row_number() OVER (PARTITION BY baseline_trace_id, target_trace_id ORDER BY score DESC, span_id) AS rank FROM scored) "
            "SELECT baseline_trace_id, target_trace_id, rank, span_id, name, round(diff, 2) AS diff_ms, round(pct, 2) AS diff_pct, depth, onpath AS on_critical_path, round(score, 2) AS score, onpath AND (self_ms > 50 OR rank = 1) AS is_root_cause FROM r WHERE rank <= 10"
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "trace_patterns": (
        _orders(O.trace_patterns),
        Q.with_orders(
            "g AS (SELECT name AS span_name, count(*) AS occurrences, avg(ms) AS m, coalesce(stddev_samp(ms), 0.0) AS sd, coalesce(stddev_samp(ms), 0.0) / avg(ms) AS cv FROM s GROUP BY 1 HAVING count(*) >= 2), u AS (SELECT 'recurring_slowdown' AS pattern_type, *, m * occurrences AS w FROM g WHERE m > 100 AND cv < 0.3 UNION ALL SELECT 'intermittent', *, sd FROM g WHERE cv > 0.5 AND m > 50 UNION ALL SELECT 'high_variance', *, cv FROM g WHERE cv > 0.7 AND occurrences >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY pattern_type ORDER BY w DESC, span_name) AS rank FROM u) "
            "SELECT pattern_type, span_name, occurrences, round(m, 2) AS avg_ms, round(cv, 2) AS cv, rank FROM r WHERE rank <= 5"
        ),
    ),
    "trace_trend": (
        lambda spark, d: O.trace_trend(spans_from_events(spark, d).withColumn("service_name", O.C.service()), ["service_name"]),
        Q.with_events(
            "a AS (SELECT service AS service_name, ms, row_number() OVER (PARTITION BY service ORDER BY start_time, trace_id) <= floor(count(*) OVER (PARTITION BY service) / 2) AS early FROM s), g AS (SELECT service_name, count(*) AS traces, avg(ms) FILTER (early) AS a, avg(ms) FILTER (NOT early) AS b FROM a GROUP BY 1 HAVING count(*) >= 3) "
            "SELECT service_name, traces, round((b - a) / a * 100, 2) AS change_pct, CASE WHEN (b - a) / a * 100 > 15 THEN 'degrading' WHEN (b - a) / a * 100 < -15 THEN 'improving' ELSE 'stable' END AS trend FROM g"
        ),
    ),
    "statistical_outliers": (
        _orders(lambda s: O.statistical_outliers(s)),
        Q.with_orders("SELECT trace_id, ms AS duration_ms FROM s WHERE parent_span_id IS NULL AND ms > (SELECT avg(ms) + 2 * stddev_samp(ms) FROM s WHERE parent_span_id IS NULL)"),
    ),
    "select_traces": (
        lambda spark, d: O.select_traces(spans_from_orders(spark, d), spark.read.parquet(f"{d}/orders.parquet").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("t"), "o_orderkey").alias("trace_id"))).select("trace_id", "span_id", "name"),
        Q.with_orders("SELECT trace_id, span_id, name FROM s WHERE trace_id IN (SELECT 't' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    ),
    "example_traces": (
        _orders(O.example_traces),
        Q.with_orders(
            "r AS (SELECT trace_id, service AS service_name, name, ms, is_error FROM s WHERE parent_span_id IS NULL), g AS (SELECT service_name, count(*) AS n, avg(ms) AS m, stddev_samp(ms) AS sd, median(ms) AS p50 FROM r GROUP BY 1), c AS (SELECT r.*, n, p50, greatest(0.0, (ms - m) / sd) + CASE WHEN is_error THEN 5 ELSE 0 END + CASE WHEN ms > 3 * m THEN 2 ELSE 0 END AS score FROM r JOIN g USING (service_name)), "
            "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY score DESC, trace_id) AS k FROM c) WHERE k = 1), nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY abs(ms - p50), trace_id) AS k FROM c WHERE NOT is_error) WHERE k = 1), "
            "md AS (SELECT * FROM (SELECT r.service_name, r.trace_id, r.ms, row_number() OVER (PARTITION BY r.service_name ORDER BY r.ms, r.trace_id) - 1 AS k, count(*) OVER (PARTITION BY r.service_name) AS q FROM r JOIN a ON a.service_name = r.service_name AND a.name = r.name WHERE r.ms < 0.8 * a.ms) WHERE k = floor(q / 2)) "
            "SELECT a.service_name, a.n AS traces, a.trace_id AS anomaly_trace_id, round(a.score, 3) AS anomaly_score, round(a.ms, 3) AS anomaly_ms, coalesce(md.trace_id, nr.trace_id) AS baseline_trace_id, round(coalesce(md.ms, nr.ms), 3) AS baseline_ms FROM a LEFT JOIN md USING (service_name) LEFT JOIN nr USING (service_name)"
        ),
    ),
}
