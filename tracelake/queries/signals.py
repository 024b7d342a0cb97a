"""Log, metric, objective, cluster and cross-signal operators over the event and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cluster as K
from ..operators import correlate as X
from ..operators import logs as L
from ..operators import metrics as M
from ..operators.fleet import trend_changes
from ..sources import adapters as A
from ..sources import readers as R
from . import sql as Q

END = "2024-01-31"


def _svc() -> Column:
    return F.col("resource.attributes")["service.name"]


def _body() -> Column:
    return F.col("body.string_value")


def _events(f):
    return lambda spark, d: f(A.spans_from_events(spark, d))


def _logs(f):
    return lambda spark, d: f(A.logs_from_events(spark, d))


def _talk(f):
    return lambda spark, d: f(A.logs_from_conversations(spark, d))


def _both(f):
    return lambda spark, d: f(A.spans_from_events(spark, d), A.logs_from_events(spark, d))


def _points(f):
    return lambda spark, d: f(A.metrics_from_events(spark, d).withColumn("shard", F.col("metric_labels")["shard"]))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Raw log entries with each kind of payload, from events."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind, said = F.col("event_type"), F.concat(F.lit("user "), "user_id", F.lit(" did "), "event_type")
    return e.select(
        "event_id", F.when(kind == "view", F.concat(F.lit("  "), said)).alias("textPayload"),
        F.when(kind == "click", F.to_json(F.struct("props", said.alias("Message"), F.lit("x").alias("id")))).when(kind == "signup", F.to_json(F.struct(F.lit(7).alias("message"), F.concat(F.lit("Started session of "), said).alias("log_line"), F.lit("a somewhat longer note without signs").alias("note")))).when(kind == "purchase", F.col("props")).alias("jsonPayload"),
        F.when(kind == "error", F.to_json(F.struct(F.lit("Delete").alias("methodName"), F.concat(F.lit("users/"), "user_id").alias("resourceName"), F.struct(F.lit(5).alias("code"), F.lit("gone").alias("message")).alias("status")))).alias("protoPayload"),
        F.concat(F.lit("projects/p/traces/t"), "event_id").alias("trace"),
    )


def _slos(spark: SparkSession, d: str) -> DataFrame:
    """An objective for each service: the goal follows from the service's number."""
    ids = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 10).alias("k")).distinct()
    return ids.select(F.concat(F.lit("svc-"), "k").alias("service_name"), F.concat(F.lit("slo-"), "k").alias("name"), (0.7 + F.col("k") * 0.02).alias("goal"), F.when(F.col("k") % 2 == 0, F.lit(7)).otherwise(F.lit(None)).cast("int").alias("rolling_days"))


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    """Each day of a service with errors is an incident that lasts ten minutes an error."""
    s = A.spans_from_events(spark, d).filter(C.is_error())
    return s.groupBy(C.service().alias("service_name"), F.to_date("start_time").alias("day")).agg((F.count("*") * 10).cast("double").alias("duration_minutes"))


def _budget(spark: SparkSession, d: str) -> DataFrame:
    """Remaining budget of each service: what its errors leave of 100, point by point."""
    from pyspark.sql import Window

    s = A.spans_from_events(spark, d).select(C.service().alias("service_name"), F.col("start_time").alias("ts"), "trace_id", C.is_error().cast("int").alias("bad"))
    used = F.sum("bad").over(Window.partitionBy("service_name").orderBy("ts", "trace_id").rowsBetween(Window.unboundedPreceding, 0))
    return s.select("service_name", "ts", (400 - used).cast("double").alias("value"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups and purchases stand for deployments and reads."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type in ('signup', 'purchase')")
    return e.select(F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("service_name"), "ts", F.col("event_id").alias("change_id"), F.when(F.col("event_type") == "signup", "services.Update").otherwise("services.Get").alias("method"))


def _change_correlation(spark: SparkSession, d: str) -> DataFrame:
    t = trend_changes(A.spans_from_events(spark, d), END, 24 * 31, "p95", 24, 5, by_service=True, exact=True)
    starts = t.filter("change_class = 'SIGNIFICANT'").groupBy("service_name").agg(F.min("bucket").alias("anomaly_start"))
    return X.change_correlation(starts, _changes(spark, d), 24 * 60)


def _node_points(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    metric = F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "view", "memory").when(F.col("event_type") == "error", "disk").when(F.col("event_type") == "signup", "pid")
    return e.select(F.concat(F.lit("node-"), F.col("user_id") % 50).alias("node"), metric.alias("metric"), "ts", (F.least(F.col("value"), F.lit(100.0)) / 100).alias("value"))


def _disk_points(spark: SparkSession, d: str) -> DataFrame:
    """Used and total bytes of nodes' disks, as two series."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type in ('click', 'view')")
    used = F.col("event_type") == "click"
    return e.select(F.concat(F.lit("node-"), F.col("user_id") % 50).alias("node"), F.when(used, "disk_used").otherwise("disk_total").alias("metric"), F.struct("ts", F.col("value").alias("raw")).alias("ts"), F.when(used, F.least("value", F.lit(100.0))).otherwise(100 + F.col("value") / 50).alias("value"))


def _pod_points(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    metric = F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "view", "memory").when(F.col("event_type") == "error", "restarts")
    value = F.when(F.col("event_type") == "error", F.floor(F.col("value") / 100)).otherwise(F.least(F.col("value"), F.lit(100.0)) / 100)
    return e.filter(metric.isNotNull()).select(F.lit("shop").alias("namespace"), F.concat(F.lit("web-"), F.col("user_id") % 10, F.lit("-a1-"), F.col("event_id") % 7).alias("pod"), F.lit("web").alias("container"), metric.alias("metric"), "ts", value.cast("double").alias("value"))


_P = "p AS (SELECT event_type AS metric_type, CAST(user_id % 10 AS VARCHAR) AS shard, 'svc-' || (user_id % 10) AS service_name, CAST(ts AS TIMESTAMP) AS ts, value, event_id FROM events)"
_SLO = "slo AS (SELECT DISTINCT 'svc-' || (user_id % 10) AS service_name, 'slo-' || (user_id % 10) AS name, 0.7::DOUBLE + (user_id % 10) * 0.02::DOUBLE AS goal, CASE WHEN user_id % 2 = 0 THEN 7 END AS rolling_days FROM events)"
_NODE = "np AS (SELECT 'node-' || (user_id % 50) AS node, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'memory' WHEN 'error' THEN 'disk' WHEN 'signup' THEN 'pid' END AS metric, ts, least(value, 100.0) / 100 AS value FROM events)"
_NODEC = _NODE + ", nl AS (SELECT node, metric, arg_max(value, (ts, value)) AS value FROM np WHERE metric IS NOT NULL GROUP BY 1, 2), nc AS (SELECT node, metric, value, upper(metric) || '_PRESSURE' AS condition, CASE WHEN value >= CASE metric WHEN 'pid' THEN 0.9 ELSE 0.95 END THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM nl WHERE value > CASE metric WHEN 'pid' THEN 0.8 ELSE 0.85 END)"
_POD = "pp AS (SELECT 'shop' AS namespace, 'web-' || (user_id % 10) || '-a1-' || (event_id % 7) AS pod, 'web-' || (user_id % 10) AS workload, 'web' AS container, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'memory' WHEN 'error' THEN 'restarts' END AS metric, ts, CASE WHEN event_type = 'error' THEN floor(value / 100) ELSE least(value, 100.0) / 100 END AS value FROM events WHERE event_type IN ('click', 'view', 'error'))"
_BURN = "bp AS (SELECT service, start_time, 400 - sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY start_time, trace_id ROWS UNBOUNDED PRECEDING) AS value FROM s), bg AS (SELECT service AS service_name, count(*) AS points, arg_min(value, start_time)::DOUBLE AS oldest, arg_max(value, start_time)::DOUBLE AS newest FROM bp GROUP BY 1), bh AS (SELECT *, (oldest - newest) / 720 AS rate FROM bg), burn AS (SELECT service_name, points, oldest, newest, round(rate, 6) AS burn_rate_per_hour, CASE WHEN rate > 0 THEN round(CASE WHEN newest <= 0 THEN 0.0 ELSE newest / rate END, 1) END AS hours_to_exhaustion, CASE WHEN points < 2 THEN 'UNKNOWN' WHEN NOT rate > 0 THEN 'HEALTHY' WHEN newest / rate < 24 THEN 'CRITICAL' WHEN newest / rate < 72 THEN 'HIGH' WHEN newest / rate < 168 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM bh)"


def _mask_sql(text: str, masks: list) -> str:
    for pattern, name in masks:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


def _grade(v: str, w: float, c: float) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'NO_DATA' WHEN {v} > {c} THEN 'CRITICAL' WHEN {v} > {w} THEN 'WARNING' ELSE 'GOOD' END"


_BOUNDS = [5.0, 10.0, 20.0, 50.0, 100.0, 200.0]
_TEMPLATES = (
    f"m0 AS (SELECT {_mask_sql('message', L.VARIABLE_MASKS)} AS m, message, severity, timestamp, resource_id, CASE WHEN timestamp < TIMESTAMP '2024-01-01 00:02:00' THEN 1 ELSE 2 END AS period FROM talk)"
)


def _shared_sql(rows: str, group: str, id_col: str, share: float, out: str) -> str:
    """The stages of _shared_key as tables with suffix ``out``."""
    return (
        f"at{out} AS (SELECT {id_col} AS i, {group} AS g, len(tk) AS size, unnest(tk) AS token, generate_subscripts(tk, 1) AS pos FROM {rows}), "
        f"kn{out} AS (SELECT g, pos, token, count(*) AS n FROM at{out} WHERE token <> '<*>' GROUP BY 1, 2, 3 HAVING count(*) > 1), "
        f"rk{out} AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, pos) AS k FROM at{out} JOIN kn{out} USING (g, pos, token)), "
        f"key{out} AS (SELECT i, string_agg(pos || ':' || token, chr(1) ORDER BY pos) AS key FROM rk{out} WHERE k <= ceil(size * {share}::DOUBLE) GROUP BY i HAVING count(*) >= ceil(any_value(size) * {share}::DOUBLE))"
    )


def _merged_sql(rows: str, group: str, out: str) -> str:
    return (
        f"mt{out} AS (SELECT {group}, pos, CASE WHEN min(token) = max(token) THEN min(token) ELSE '<*>' END AS t, count(*) AS parts FROM (SELECT {group}, unnest(tk) AS token, generate_subscripts(tk, 1) AS pos FROM {rows}) GROUP BY {group}, pos), "
        f"mg{out} AS (SELECT {group}, list(t ORDER BY pos) AS shape, max(parts) AS parts FROM mt{out} GROUP BY {group})"
    )


def _template_sql(where: str, n: str, source: str = "m0", lead: int = 2, many: int = 10) -> str:
    """The stages of template_patterns, as tables with suffix n."""
    return (
        f"d{n} AS (SELECT m, list_filter(regexp_split_to_array(m, '\\s+'), lambda t: t <> '') AS tk FROM (SELECT DISTINCT m FROM {source} WHERE {where})), "
        f"l{n} AS (SELECT m, tk, len(tk) || chr(1) || array_to_string(list_transform(tk[1:{lead}], lambda t: CASE WHEN regexp_matches(t, '\\d') THEN '<*>' ELSE t END), chr(1)) AS lead FROM d{n}), "
        f"{_shared_sql(f'l{n}', 'lead', 'm', 0.4, f'1{n}')}, f{n} AS (SELECT m, tk, lead, coalesce(key, chr(2) || m) AS key FROM l{n} LEFT JOIN key1{n} ON i = m), {_merged_sql(f'f{n}', 'lead, key', f'1{n}')}, "
        f"o{n} AS (SELECT m, array_to_string(coalesce(shape, tk), ' ') AS template, coalesce(shape, tk) AS tk FROM f{n} LEFT JOIN mg1{n} USING (lead, key)), h{n} AS (SELECT DISTINCT template, tk, len(tk) AS size FROM o{n}), "
        f"{_shared_sql(f'h{n}', 'size', 'template', 0.6, f'2{n}')}, c{n} AS (SELECT template, tk, size, key FROM h{n} JOIN key2{n} ON i = template), {_merged_sql(f'c{n}', 'size, key', f'2{n}')}, "
        f"w{n} AS (SELECT template, array_to_string(shape, ' ') AS wider FROM c{n} JOIN mg2{n} USING (size, key) WHERE parts >= {many}), n{n} AS (SELECT m, coalesce(wider, template) AS template FROM o{n} LEFT JOIN w{n} USING (template)), "
        f"t{n} AS (SELECT substr(md5(template), 1, 8) AS pattern_id, template, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos FROM {source} JOIN n{n} USING (m) WHERE {where} GROUP BY 1, 2)"
    )


_COMPARE = (
    "cmp AS (SELECT coalesce(a.pattern_id, b.pattern_id) AS pattern_id, coalesce(b.template, a.template) AS template, coalesce(a.count, 0) AS baseline_count, coalesce(b.count, 0) AS count, ((b.count / n2) - (a.count / n1)) / (a.count / n1) AS c, coalesce(b.errors, 0) AS error_count, a.pattern_id IS NULL AS fresh, b.pattern_id IS NULL AS gone "
    "FROM ta a FULL JOIN tb b ON a.pattern_id = b.pattern_id, (SELECT greatest(sum(count), 1)::DOUBLE AS n1 FROM ta), (SELECT greatest(sum(count), 1)::DOUBLE AS n2 FROM tb)), "
    "comp AS (SELECT pattern_id, template, baseline_count, count, round(c * 100, 1) AS change_pct, error_count, CASE WHEN fresh THEN 'new' WHEN gone THEN 'disappeared' WHEN c > 0.5 THEN 'increased' WHEN c < -0.5 THEN 'decreased' ELSE 'stable' END AS change FROM cmp)"
)
_PERIODS = f"{_TEMPLATES}, {_template_sql('period = 1', 'a')}, {_template_sql('period = 2', 'b')}, {_COMPARE}"
_ALL_TEMPLATES = f"{_TEMPLATES}, {_template_sql('period > 0', 'a')}"


def periods(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    edge = F.lit("2024-01-01 00:02:00").cast("timestamp_ntz")
    return tuple(L.template_patterns(logs.filter(p), resource="resource_id") for p in (F.col("timestamp") < edge, F.col("timestamp") >= edge))


def _flat(patterns: DataFrame) -> DataFrame:
    count = lambda k: F.coalesce(F.col("severity_counts")[k], F.lit(0))
    return patterns.select("pattern_id", "template", "count", "first_seen", "last_seen", count("ERROR").alias("errors"), count("WARNING").alias("warnings"), count("INFO").alias("infos"))


_KW = [("the", "articles", "medium"), ("thion", "words", "high"), ("and", "joins", "medium")]

QUERIES = {
    "list_log_entries": (
        _logs(lambda l: R.list_log_entries(l, min_severity="WARN", contains="took", resource_type="k8s_container", limit=100).select("insert_id", "timestamp", "severity_text")),
        Q.with_logs("SELECT insert_id, timestamp, severity AS severity_text FROM logs WHERE severity IN ('WARN', 'ERROR') ORDER BY timestamp DESC, insert_id LIMIT 100"),
    ),
    "normalize_log_entries": (
        lambda spark, d: R.normalize_log_entries(entries(spark, d)).select("event_id", "payload", "trace_id"),
        """SELECT event_id, CASE event_type WHEN 'view' THEN '  user ' || user_id || ' did view' WHEN 'click' THEN '{"props":' || to_json(props) || ',"Message":"user ' || user_id || ' did click","id":"x"}' WHEN 'signup' THEN '{"message":7,"log_line":"Started session of user ' || user_id || ' did signup","note":"a somewhat longer note without signs"}' WHEN 'purchase' THEN props WHEN 'error' THEN '{"methodName":"Delete","resourceName":"users/' || user_id || '","status":{"code":5,"message":"gone"}}' END AS payload, 't' || event_id AS trace_id FROM events""",
    ),
    "extract_log_message": (
        lambda spark, d: L.extract_log_message(entries(spark, d)).select("event_id", "message"),
        """SELECT event_id, CASE event_type WHEN 'view' THEN 'user ' || user_id || ' did view' WHEN 'click' THEN 'user ' || user_id || ' did click' WHEN 'signup' THEN 'Started session of user ' || user_id || ' did signup' WHEN 'purchase' THEN replace(props, ': ', ':') WHEN 'error' THEN '[Delete] users/' || user_id || ' status=5: gone' ELSE '' END AS message FROM events""",
    ),
    "logs_for_trace": (
        _both(lambda s, l: X.logs_for_trace(l, s.filter(C.is_error())).select("insert_id", "trace_id")),
        Q.with_events_and_logs("SELECT insert_id, trace_id FROM logs WHERE trace_id IN (SELECT trace_id FROM s WHERE is_error)"),
    ),
    "read_error_events": (
        _logs(lambda l: R.error_events(l, END, 24 * 60 * 31)),
        Q.with_logs("SELECT timestamp AS event_time, body AS message, service, CAST(NULL AS VARCHAR) AS version FROM logs WHERE severity = 'ERROR' AND timestamp >= TIMESTAMP '2023-12-31'"),
    ),
    "read_error_events_at": (
        _logs(lambda l: R.error_events(l, "2024-01-10 00:00:00", 24 * 60)),
        Q.with_logs("SELECT timestamp AS event_time, body AS message, service, CAST(NULL AS VARCHAR) AS version FROM logs WHERE severity = 'ERROR' AND timestamp BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-10'"),
    ),
    "log_signature_patterns": (
        _logs(lambda l: L.log_signature_patterns(l, _body())),
        Q.with_logs(f"SELECT {_mask_sql('body', L.SIGNATURE_MASKS)} AS pattern_signature, count(*) AS occurrence_count, min(body) AS sample_log, array_to_string(list_sort(list(DISTINCT severity)), ',') AS severities, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM logs GROUP BY 1 ORDER BY occurrence_count DESC, pattern_signature LIMIT 100"),
    ),
    "mask_variables": (
        _logs(lambda l: L.mask_variables(l.select("insert_id", _body().alias("message"))).select("insert_id", "masked")),
        Q.with_logs(f"SELECT insert_id, {_mask_sql('body', L.VARIABLE_MASKS)} AS masked FROM logs"),
    ),
    "template_patterns": (
        _talk(lambda l: _flat(L.template_patterns(l, resource="resource_id"))),
        Q.with_talk(f"{_ALL_TEMPLATES} SELECT * FROM ta"),
    ),
    "compare_log_patterns": (_talk(lambda l: L.compare_log_patterns(*periods(l))), Q.with_talk(f"{_PERIODS} SELECT * FROM comp")),
    "alert_level": (
        _talk(lambda l: L.alert_level(L.compare_log_patterns(*periods(l)))),
        Q.with_talk(f"{_PERIODS}, g AS (SELECT count(*) FILTER (change = 'new') AS new_patterns, count(*) FILTER (change = 'new' AND error_count > 0) AS new_error_patterns, count(*) FILTER (change = 'increased' AND change_pct > 200) AS surges FROM comp) SELECT *, CASE WHEN new_error_patterns > 0 THEN 'HIGH' WHEN new_patterns > 5 OR surges > 0 THEN 'MEDIUM' ELSE 'LOW' END AS alert_level FROM g"),
    ),
    "log_anomalies": (
        _talk(lambda l: L.log_anomalies(L.template_patterns(l))),
        Q.with_talk(f"{_ALL_TEMPLATES} SELECT pattern_id, template, count, errors * 10 + warnings * 5 AS severity_score, errors > 0 AS has_errors, warnings > 0 AS has_warnings FROM ta ORDER BY severity_score DESC, count DESC, pattern_id LIMIT 20"),
    ),
    "pattern_summary": (
        _talk(lambda l: L.pattern_summary(L.template_patterns(l), 2000)),
        Q.with_talk(f"{_ALL_TEMPLATES}, o AS (SELECT *, row_number() OVER (ORDER BY count DESC, pattern_id) AS rank FROM ta), z AS (SELECT rank, rank || '. (' || count || 'x) [' || concat_ws(',', CASE WHEN errors > 0 THEN 'ERROR:' || errors END, CASE WHEN infos > 0 THEN 'INFO:' || infos END, CASE WHEN warnings > 0 THEN 'WARNING:' || warnings END) || '] ' || template AS line FROM o WHERE rank <= 100) SELECT rank, line FROM (SELECT *, sum(length(line) + 1) OVER (ORDER BY rank) AS used FROM z) WHERE used <= 2000"),
    ),
    "classify_findings": (
        _talk(lambda l: L.classify_findings(l, rules=_KW).groupBy("categories", "severity_class").agg(F.count("*").alias("n"))),
        Q.with_talk("c AS (SELECT contains(lower(message), 'thion') AS h, contains(lower(message), 'the') AS t, contains(lower(message), 'and') AS a FROM talk) SELECT concat_ws(',', CASE WHEN h THEN 'words' END, CASE WHEN t THEN 'articles' END, CASE WHEN a THEN 'joins' END) AS categories, CASE WHEN h THEN 'high' ELSE 'medium' END AS severity_class, count(*) AS n FROM c WHERE h OR t OR a GROUP BY 1, 2"),
    ),
    "change_risk": (
        lambda spark, d: L.change_risk(spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_type") == "error", "Delete database rows").when(F.col("event_type") == "signup", "Scale up after restart").otherwise("Change config").alias("action"))).select("event_id", "risk_level", "risk_factors", "require_approval"),
        "SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'low' ELSE 'medium' END AS risk_level, CASE event_type WHEN 'error' THEN 'data_integrity' WHEN 'signup' THEN 'interruption' ELSE 'unexpected_effects' END AS risk_factors, event_type = 'error' AS require_approval FROM events",
    ),
    "series_stats": (
        _points(lambda p: M.series_stats(p, ["metric_type", "shard"])),
        f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY metric_type, shard ORDER BY value) AS rn, count(*) OVER (PARTITION BY metric_type, shard) AS c FROM p) SELECT metric_type, shard, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 8) AS mean, round(median(value), 8) AS median, round(coalesce(stddev_samp(value), 0.0), 4) AS stdev, " + ", ".join(f"min(value) FILTER (rn = floor(c * {q}) + 1) AS p{int(q * 100)}" for q in (0.9, 0.95, 0.99)) + " FROM r GROUP BY 1, 2",
    ),
    "metric_anomalies": (
        _points(lambda p: M.metric_anomalies(p, ["metric_type", "shard"])),
        f"WITH {_P}, g AS (SELECT metric_type, shard, avg(value) AS m, stddev_samp(value) AS sd FROM p GROUP BY 1, 2) SELECT metric_type, shard, ts, value, round((value - m) / sd, 2) AS z_score, CASE WHEN value > m THEN 'high' ELSE 'low' END AS anomaly_type FROM p JOIN g USING (metric_type, shard) WHERE sd > 0 AND abs((value - m) / sd) > 3",
    ),
    "compare_metric_windows": (
        _points(lambda p: M.compare_metric_windows(p, ["metric_type", "shard"], F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))),
        f"WITH {_P}, g AS (SELECT metric_type, shard, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS t FROM p GROUP BY 1, 2) SELECT metric_type, shard, round(b, 4) AS baseline_mean, round(t, 4) AS target_mean, round(t - b, 4) AS mean_shift, round((t - b) / b * 100, 2) AS pct_change, abs((t - b) / b * 100) > 10 AS is_significant FROM g",
    ),
    "golden_signals": (
        lambda spark, d: M.golden_signals(A.metrics_from_events(spark, d), spark.createDataFrame([("latency", "absent", 1), ("latency", "view", 2), ("traffic", "click", 1), ("errors", "error", 1), ("saturation", "signup", 1)], "signal string, metric_type string, rank int"), F.col("resource_labels")["service.name"]),
        f"WITH {_P}, g AS (SELECT service_name, avg(value) FILTER (metric_type = 'view') AS l, avg(value) FILTER (metric_type = 'click') AS t, avg(value) FILTER (metric_type = 'error') AS e, avg(value) FILTER (metric_type = 'signup') AS s FROM p GROUP BY 1), h AS (SELECT service_name, round(l, 2) AS latency_ms, round(t, 2) AS traffic, round(e, 3) AS error_pct, round(s, 2) AS saturation_pct, {_grade('l', 200, 500)} AS latency_status, {_grade('e', 0.1, 1)} AS error_status, {_grade('s', 70, 85)} AS saturation_status FROM g) SELECT *, CASE WHEN 'CRITICAL' IN (latency_status, error_status, saturation_status) THEN 'CRITICAL' WHEN 'WARNING' IN (latency_status, error_status, saturation_status) THEN 'WARNING' WHEN 'GOOD' IN (latency_status, error_status, saturation_status) THEN 'HEALTHY' ELSE 'UNKNOWN' END AS overall_status FROM h",
    ),
    "golden_signals_from_spans": (
        _events(lambda s: M.golden_signals_from_spans(s, 720)),
        Q.with_events(f"g AS (SELECT service AS service_name, avg(ms) AS l, count(*) AS n, count(*) FILTER (is_error) / count(*) * 100 AS e FROM s GROUP BY 1), h AS (SELECT service_name, round(l, 2) AS latency_ms, round(n / 2592000, 6) AS traffic_rps, round(e, 3) AS error_pct, {_grade('l', 200, 500)} AS latency_status, {_grade('e', 0.1, 1)} AS error_status FROM g) SELECT *, CASE WHEN 'CRITICAL' IN (latency_status, error_status) THEN 'CRITICAL' WHEN 'WARNING' IN (latency_status, error_status) THEN 'WARNING' ELSE 'HEALTHY' END AS overall_status FROM h"),
    ),
    "counter_rate": (
        lambda spark, d: M.counter_rate(A.counters_from_events(spark, d), ["metric_type"], 3600, ("ts", "event_id")),
        "WITH c AS (SELECT event_type AS metric_type, CAST(ts AS TIMESTAMP) AS ts, event_id, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id)::DOUBLE AS value FROM events), d AS (SELECT *, lag(value) OVER (PARTITION BY metric_type ORDER BY ts, event_id) AS o FROM c) SELECT metric_type, date_trunc('hour', ts) AS step, sum(CASE WHEN o IS NULL THEN 0 WHEN value < o THEN value ELSE value - o END) AS increase, round(sum(CASE WHEN o IS NULL THEN 0 WHEN value < o THEN value ELSE value - o END) / 3600, 8) AS rate FROM d GROUP BY 1, 2",
    ),
    "histogram_quantile": (
        _points(lambda p: M.histogram_quantile(M.histogram_buckets(p, ["metric_type"], _BOUNDS), ["metric_type"], 0.95)),
        f"WITH {_P}, b AS (SELECT metric_type, le, lo, count(*) FILTER (value <= le) AS c, count(*) FILTER (value <= lo) AS below, count(*) AS n FROM p, (VALUES " + ", ".join(f"({b}::DOUBLE, {a}::DOUBLE)" for a, b in zip([0.0, *_BOUNDS], [*_BOUNDS, "'Infinity'"])) + ") v(le, lo) GROUP BY 1, 2, 3), f AS (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY le) AS k FROM b WHERE c >= 0.95 * n) SELECT metric_type, round(CASE WHEN le = 'Infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * (0.95::DOUBLE * n - CASE WHEN lo = 0 THEN 0 ELSE below END) / (c - CASE WHEN lo = 0 THEN 0 ELSE below END) END, 6) AS quantile FROM f WHERE k = 1",
    ),
    "gauge_latest": (
        _points(lambda p: M.gauge_latest(p, ["metric_type", "shard"], ("ts", "event_id"))),
        f"WITH {_P} SELECT metric_type, shard, arg_max(value, (ts, event_id)) AS latest, max(ts) AS at FROM p GROUP BY 1, 2",
    ),
    "range_query_step": (
        _points(lambda p: M.range_query_step(p, ["metric_type"], 21600)),
        f"WITH {_P} SELECT metric_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS step, round(avg(value), 8) AS avg, max(value) AS max, arg_max(value, (ts, value)) AS last, count(*) AS n FROM p GROUP BY 1, 2",
    ),
    "slo_status": (lambda spark, d: M.slo_status(_slos(spark, d)), f"WITH {_SLO} SELECT name, round(goal * 100, 4) AS goal_pct, round((1 - goal) * 100, 4) AS error_budget_pct, coalesce(rolling_days, 30) AS rolling_days FROM slo"),
    "slo_compliance": (
        lambda spark, d: M.slo_compliance(A.spans_from_events(spark, d), _slos(spark, d), END),
        Q.with_events(f"{_SLO}, g AS (SELECT service_name, goal, count(*) AS total, count(*) FILTER (NOT is_error) AS good FROM s JOIN slo ON service = service_name WHERE start_time <= TIMESTAMP '{END}' AND start_time >= TIMESTAMP '{END}' - to_days(coalesce(rolling_days, 30)) GROUP BY 1, 2) SELECT *, round(good / total, 6) AS good_ratio, good / total >= goal AS is_met, round((1 - good / total) / (1 - goal) * 100, 2) AS budget_used_pct FROM g"),
    ),
    "error_budget_burn": (lambda spark, d: M.error_budget_burn(_budget(spark, d), ["service_name"], 720), Q.with_events(f"{_BURN} SELECT * FROM burn")),
    "predict_slo_violation": (
        lambda spark, d: M.predict_slo_violation(M.error_budget_burn(_budget(spark, d), ["service_name"], 720), ["service_name"], 800),
        Q.with_events(f"{_BURN} SELECT service_name, hours_to_exhaustion, coalesce(hours_to_exhaustion <= 800, false) AS will_violate, CASE WHEN hours_to_exhaustion <= 800 AND hours_to_exhaustion >= 400 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, CASE WHEN hours_to_exhaustion > 800 THEN round(hours_to_exhaustion - 800, 1) END AS buffer_hours FROM burn"),
    ),
    "incident_slo_impact": (
        lambda spark, d: M.incident_slo_impact(_incidents(spark, d), _slos(spark, d)).select("service_name", "day", "duration_minutes", "budget_minutes", "budget_used_pct", "impact"),
        Q.with_events(f"{_SLO}, i AS (SELECT service AS service_name, CAST(start_time AS DATE) AS day, count(*) * 10.0::DOUBLE AS duration_minutes FROM s WHERE is_error GROUP BY 1, 2), j AS (SELECT *, coalesce(rolling_days, 30) * 1440 * (1 - goal) AS b FROM i JOIN slo USING (service_name)) SELECT service_name, day, duration_minutes, round(b, 4) AS budget_minutes, round(duration_minutes / b * 100, 2) AS budget_used_pct, CASE WHEN duration_minutes / b * 100 >= 50 THEN 'CRITICAL' WHEN duration_minutes / b * 100 >= 20 THEN 'HIGH' WHEN duration_minutes / b * 100 >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM j"),
    ),
    "logs_for_traces_direct_and_nearby": (
        _both(lambda s, l: X.logs_for_traces_direct_and_nearby(s, l, _svc(), 3600)),
        Q.with_events_and_logs(
            "n AS (SELECT s.trace_id, l.insert_id, l.timestamp, l.severity, row_number() OVER (PARTITION BY s.trace_id ORDER BY l.timestamp, l.insert_id) AS k FROM s JOIN logs l ON l.service = s.service AND l.timestamp BETWEEN s.start_time - INTERVAL 1 HOUR AND s.end_time + INTERVAL 1 HOUR WHERE l.severity IN ('ERROR', 'WARN') AND (l.trace_id IS NULL OR l.trace_id <> s.trace_id)) "
            "SELECT s.trace_id, insert_id, timestamp, severity, 'direct' AS correlation FROM s JOIN logs l ON l.trace_id = s.trace_id UNION ALL SELECT trace_id, insert_id, timestamp, severity, 'nearby' FROM n WHERE k <= 20"
        ),
    ),
    "trace_context": (
        lambda spark, d: X.trace_context(A.spans_from_orders(spark, d)),
        Q.with_orders("SELECT trace_id, min(start_time) AS started, max(end_time) AS ended, round(epoch_us(max(end_time))::DOUBLE / 1000 - epoch_us(min(start_time))::DOUBLE / 1000, 3) AS total_ms, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, '' AS hosts, count(*) AS span_count, count(*) FILTER (is_error) AS error_count, array_to_string(list_slice(list(span_id ORDER BY ms DESC, span_id), 1, 5), ',') AS slowest_span_ids FROM s GROUP BY 1"),
    ),
    "metrics_during_trace": (
        lambda spark, d: X.metrics_during_trace(A.spans_from_events(spark, d).filter(C.is_error()), A.metrics_from_events(spark, d), F.col("resource_labels")["service.name"], 1800),
        Q.with_events(f"{_P} SELECT s.trace_id, service_name, metric_type, count(*) AS points, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM s JOIN p ON p.service_name = s.service AND p.ts BETWEEN s.start_time - INTERVAL 30 MINUTE AND s.end_time + INTERVAL 30 MINUTE WHERE s.is_error GROUP BY 1, 2, 3"),
    ),
    "cross_signal_timeline": (
        _both(lambda s, l: X.cross_signal_timeline(s, l, _svc(), 1800)),
        Q.with_events_and_logs(
            "n AS (SELECT s.trace_id, l.*, row_number() OVER (PARTITION BY s.trace_id ORDER BY l.timestamp, l.insert_id) AS k, s.start_time FROM s JOIN (SELECT insert_id, timestamp, severity, service, trace_id AS lt, body FROM logs) l ON l.service = s.service AND l.timestamp BETWEEN s.start_time - INTERVAL 30 MINUTE AND s.end_time + INTERVAL 30 MINUTE WHERE l.severity IN ('ERROR', 'WARN') AND (l.lt IS NULL OR l.lt <> s.trace_id)), "
            "u AS (SELECT trace_id, 'SPAN' AS event_type, start_time AS event_time, end_time, span_id AS event_id, span_id, parent_span_id, name AS event_name, service AS service_name, CASE code WHEN 2 THEN 'ERROR' ELSE 'OK' END AS status, round(ms, 2) AS duration_ms, 'SERVER' AS span_kind, start_time AS a FROM s "
            "UNION ALL SELECT s.trace_id, 'LOG_DIRECT', l.timestamp, NULL, insert_id, NULL, NULL, '[' || severity || '] ' || body, l.service, severity, NULL, 'LOG', s.start_time FROM s JOIN logs l ON l.trace_id = s.trace_id UNION ALL SELECT trace_id, 'LOG_TEMPORAL', timestamp, NULL, insert_id, NULL, NULL, '[' || severity || '] ' || body, service, severity, NULL, 'LOG', start_time FROM n WHERE k <= 50) "
            "SELECT * EXCLUDE (a), CAST(NULL AS VARCHAR) AS http_method, CAST(NULL AS VARCHAR) AS http_url, CAST(NULL AS VARCHAR) AS http_status, CAST(NULL AS VARCHAR) AS db_system, CAST(NULL AS VARCHAR) AS db_statement, round(epoch_us(event_time)::DOUBLE / 1000 - epoch_us(a)::DOUBLE / 1000, 3) AS relative_time_ms FROM u"
        ),
    ),
    "signal_correlation_strength": (
        _both(lambda s, l: X.signal_correlation_strength(s, l, _svc())),
        Q.with_events_and_logs("a AS (SELECT service AS service_name, count(*) AS span_count, count(DISTINCT trace_id) AS t FROM s GROUP BY 1), b AS (SELECT service AS service_name, count(*) AS log_count, count(trace_id) AS w, count(DISTINCT trace_id) AS x FROM logs GROUP BY 1), c AS (SELECT service_name, span_count, log_count, least(100.0::DOUBLE, w / log_count * 100) AS p, least(100.0::DOUBLE, x / t * 100) AS q FROM a FULL JOIN b USING (service_name)) SELECT service_name, span_count, log_count, round(p, 1) AS log_trace_pct, round(q, 1) AS trace_log_pct, 0.0::DOUBLE AS log_span_pct, round(0.4::DOUBLE * p + 0.4::DOUBLE * q + 10, 1) AS score, CASE WHEN 0.4::DOUBLE * p + 0.4::DOUBLE * q + 10 < 50 THEN 'LOW' WHEN 0.4::DOUBLE * p + 0.4::DOUBLE * q + 10 < 80 THEN 'MEDIUM' ELSE 'GOOD' END AS status FROM c"),
    ),
    "trace_to_pods": (
        _logs(X.trace_to_pods),
        Q.with_logs("SELECT DISTINCT trace_id, 'shop' AS namespace, 'web-' || (user_id % 10) || '-a1-' || (event_id % 7) AS pod, 'web' AS container, 'c' || (user_id % 2) AS cluster FROM logs WHERE trace_id IS NOT NULL"),
    ),
    "change_correlation": (
        _change_correlation,
        Q.with_events(
            "g AS (SELECT service AS service_name, date_trunc('day', start_time) AS bucket, round(quantile_disc(ms, 0.95), 2) AS v FROM s GROUP BY 1, 2 HAVING count(*) >= 5), h AS (SELECT *, lag(v) OVER (PARTITION BY service_name ORDER BY bucket) AS o FROM g), st AS (SELECT service_name, min(bucket) AS anomaly_start FROM h WHERE abs((v - o) / o * 100) >= 20 GROUP BY 1), "
            "ch AS (SELECT 'svc-' || (user_id % 10) AS service_name, CAST(ts AS TIMESTAMP) AS ts, event_id AS change_id, 'services.Update' AS method FROM events WHERE event_type = 'signup') SELECT service_name, anomaly_start, count(*) AS changes, arg_max(change_id, (ts, change_id)) AS change_id, 'services.Update' AS method, max(ts) AS changed_at FROM st JOIN ch USING (service_name) WHERE ts BETWEEN anomaly_start - INTERVAL 1440 MINUTE AND anomaly_start GROUP BY 1, 2"
        ),
    ),
    "node_conditions": (lambda spark, d: K.node_conditions(_node_points(spark, d)), f"WITH {_NODEC} SELECT * FROM nc"),
    "node_summary": (lambda spark, d: K.node_summary(_node_points(spark, d)), f"WITH {_NODEC}, t AS (SELECT (SELECT count(DISTINCT node) FROM np) AS nodes, (SELECT count(DISTINCT node) FROM nc) AS affected) SELECT *, CASE WHEN affected / nodes > 0.5 THEN 'CRITICAL' WHEN affected > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM t"),
    "node_conditions_of_disks": (
        lambda spark, d: K.node_conditions(_disk_points(spark, d)),
        "WITH p AS (SELECT 'node-' || (user_id % 50) AS node, event_type, ts, value FROM events), l AS (SELECT node, arg_max(least(value, 100.0), (ts, value)) FILTER (event_type = 'click') AS used, arg_max(100 + value / 50, (ts, value)) FILTER (event_type = 'view') AS total FROM p GROUP BY 1) "
        "SELECT node, 'disk' AS metric, used / total AS value, 'DISK_PRESSURE' AS condition, CASE WHEN used / total >= 0.95 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM l WHERE used / total > 0.85",
    ),
    "pod_restarts": (
        lambda spark, d: K.pod_restarts(_pod_points(spark, d).filter("metric = 'restarts'"), 50),
        f"WITH {_POD}, r AS (SELECT namespace, pod, arg_max(value, ts) - arg_min(value, ts) AS restarts FROM pp WHERE metric = 'restarts' GROUP BY 1, 2, container) SELECT namespace, pod, restarts, CASE WHEN restarts > 50 THEN 'CRITICAL' WHEN restarts > 10 THEN 'WARNING' ELSE 'INFO' END AS severity FROM r WHERE restarts > 0 ORDER BY restarts DESC, namespace, pod LIMIT 50",
    ),
    "hpa_events": (
        _points(lambda p: K.hpa_events(p.withColumn("value", F.floor(F.col("value") / 20).cast("double")), ["metric_type", "shard"], ("ts", "event_id"))),
        f"WITH {_P}, h AS (SELECT metric_type, shard, ts, event_id, floor(value / 20) AS v, floor(value / 20) - lag(floor(value / 20)) OVER (PARTITION BY metric_type, shard ORDER BY ts, event_id) AS step FROM p) SELECT metric_type, shard, count(*) FILTER (step > 0) AS scale_ups, count(*) FILTER (step < 0) AS scale_downs, min(v) AS min_replicas, max(v) AS max_replicas, arg_max(v, (ts, event_id)) AS current_replicas, count(*) FILTER (step <> 0) > 20 AS is_thrashing, arg_max(v, (ts, event_id)) = max(v) AS at_max FROM h GROUP BY 1, 2",
    ),
    "oom_events": (
        _logs(lambda l: K.oom_events(l, _body(), "event error")),
        Q.with_logs("SELECT 'shop' AS namespace, 'web-' || (user_id % 10) || '-a1-' || (event_id % 7) AS pod, 'web' AS container, count(*) AS events, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM logs WHERE contains(body, 'event error') GROUP BY 1, 2, 3"),
    ),
    "memory_risks": (
        lambda spark, d: K.memory_risks(_pod_points(spark, d).filter("metric = 'memory'")),
        f"WITH {_POD} SELECT namespace, pod, container, max(value) AS max_utilization, CASE WHEN max(value) > 0.95 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM pp WHERE metric = 'memory' GROUP BY 1, 2, 3 HAVING max(value) > 0.85",
    ),
    "oom_report": (
        lambda spark, d: K.oom_report(A.logs_from_events(spark, d), _body(), _pod_points(spark, d).filter("metric = 'memory'"), "event error"),
        Q.with_logs(f"{_POD}, r AS (SELECT max(value) AS v FROM pp WHERE metric = 'memory' GROUP BY namespace, pod, container) SELECT (SELECT count(*) FROM logs WHERE contains(body, 'event error')) AS oom_events, (SELECT count(*) FROM (SELECT DISTINCT user_id % 10, event_id % 7, user_id % 2 FROM logs WHERE contains(body, 'event error'))) AS killed_containers, (SELECT count(*) FROM r WHERE v > 0.85) AS containers_at_risk, (SELECT count(*) FROM r WHERE v > 0.95) AS high_risk_containers, CASE WHEN (SELECT count(*) FROM logs WHERE contains(body, 'event error')) > 0 THEN 'CRITICAL' WHEN (SELECT count(*) FROM r WHERE v > 0.85) > 0 THEN 'WARNING' ELSE 'NORMAL' END AS severity"),
    ),
    "workload_health": (
        lambda spark, d: K.workload_health(_pod_points(spark, d)),
        f"WITH {_POD}, a AS (SELECT namespace, workload, pod, max(value) FILTER (metric = 'cpu') AS cpu, max(value) FILTER (metric = 'memory') AS memory, coalesce(max(value) FILTER (metric = 'restarts'), 0.0) AS restarts FROM pp GROUP BY 1, 2, 3), b AS (SELECT namespace, workload, count(*) AS pods, max(cpu) AS max_cpu, max(memory) AS max_memory, sum(restarts) AS restarts FROM a GROUP BY 1, 2) SELECT *, CASE WHEN restarts > 5 OR coalesce(max_memory, 0) > 0.95 THEN 'CRITICAL' WHEN restarts > 0 OR coalesce(max_memory, 0) > 0.85 OR coalesce(max_cpu, 0) > 0.9 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM b",
    ),
}
