"""Composed pipelines and the streaming operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import logs as L
from ..plans import pipelines as P
from ..sources import adapters as A
from ..streaming.patterns import stream_log_patterns
from . import sql as Q
from .fleet import ORDERS_END, ORDERS_HOURS
from .fleet import QUERIES as FLEET
from .signals import QUERIES as SIGNALS
from .traces import QUERIES as TRACES
from .traces import customer_pairs


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream, run to its end, in append mode. A row far in the future comes with the last events and
    ends the stream: the watermark then closes every window before it, so that all of them are handed over, and the state of
    none is kept. All files are one batch, since rows of one file may be older than all of another."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 2**31 - 1).parquet(f"{d}/events.parquet*")
    body = F.concat(F.lit("event "), "event_type", F.lit(" user "), "user_id", F.lit(" props "), "props")
    rows = events.select(F.col("ts").alias("timestamp"), body.alias("body"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO").alias("severity_text"))
    spark.range(1).select(F.lit("9999-01-01").cast(rows.schema["timestamp"].dataType).alias("timestamp"), F.lit("").alias("body"), F.lit("INFO").alias("severity_text")).write.parquet(f"{top}-end")
    out = stream_log_patterns(rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{top}-end")), F.col("body"), window="6 hours")
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{top}-counts").option("checkpointLocation", top).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}-counts")


def _log_periods(spark: SparkSession, d: str) -> DataFrame:
    logs = A.logs_from_conversations(spark, d)
    edge = F.lit("2024-01-01 00:02:00").cast("timestamp_ntz")
    return P.log_pattern_pipeline(logs.filter(F.col("timestamp") < edge), logs.filter(F.col("timestamp") >= edge), resource="resource_id")


def order_logs(spark: SparkSession, d: str) -> DataFrame:
    """A log of each order's service up to fifty seconds after its root span's start; every other one names its trace."""
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 50).cast("decimal(18,6)"))
    return o.select(F.concat(F.lit("n"), k).alias("insert_id"), at.alias("timestamp"), F.when(F.col("o_orderstatus") == "F", "ERROR").otherwise("INFO").alias("severity_text"), F.concat(F.lit("svc-"), F.col("o_custkey") % 13).alias("service"), F.when(k % 2 == 0, F.concat(F.lit("t"), k)).alias("trace_id"))


def order_changes(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderkey % 10 = 0")
    return o.select(F.concat(F.lit("svc-"), F.col("o_custkey") % 10).alias("service_name"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("change_id"), F.lit("services.Deploy").alias("method"))


_METRICS = FLEET["aggregate_metrics"][1]
_EXAMPLES = TRACES["example_traces"][1]
_MASKED = "body"
for _p, _n in L.SIGNATURE_MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{_n}', 'g')"

QUERIES = {
    "aggregate_pipeline": (
        lambda spark, d: P.aggregate_pipeline(A.spans_from_orders(spark, d), ORDERS_END, ORDERS_HOURS, 30, 300, exact=True),
        f"SELECT m.service_name, request_count, error_rate_pct, p95_ms, p99_ms, anomaly_trace_id, anomaly_ms, baseline_trace_id, baseline_ms FROM ({_METRICS}) m JOIN ({_EXAMPLES}) e USING (service_name) WHERE error_rate_pct > 30 OR p99_ms > 300",
    ),
    "triage_pipeline": (
        lambda spark, d: P.triage_pipeline(A.spans_from_orders(spark, d), customer_pairs(spark, d)),
        "WITH pr AS (SELECT 't' || b AS baseline_trace_id, 't' || o_orderkey AS target_trace_id FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL) "
        f"SELECT baseline_trace_id, target_trace_id, 'timing_' || change AS finding, name AS subject FROM ({TRACES['compare_span_timings'][1]}) WHERE change IN ('slower', 'missing', 'new') "
        f"UNION ALL SELECT baseline_trace_id, target_trace_id, 'structure', missing_names || '|' || new_names FROM ({TRACES['structural_differences'][1]}) WHERE structure_changed "
        f"UNION ALL SELECT baseline_trace_id, target_trace_id, 'error', span_id FROM pr JOIN ({TRACES['extract_errors'][1]}) ON trace_id = target_trace_id "
        f"UNION ALL SELECT baseline_trace_id, target_trace_id, 'latency_anomaly', span_id FROM pr JOIN ({TRACES['latency_anomalies'][1]}) ON trace_id = target_trace_id "
        f"UNION ALL SELECT baseline_trace_id, target_trace_id, 'pattern', health FROM pr JOIN ({TRACES['all_patterns'][1].replace(chr(39) + 'order' + chr(39), chr(39) + 'connection' + chr(39))}) ON trace_id = target_trace_id",
    ),
    "triage_pipeline_with_logs": (
        lambda spark, d: P.triage_pipeline(A.spans_from_orders(spark, d), customer_pairs(spark, d), order_logs(spark, d), F.col("service")).filter("finding like 'log_%'"),
        Q.with_orders(
            "pr AS (SELECT 't' || b AS baseline_trace_id, 't' || o_orderkey AS target_trace_id FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL), "
            "lg AS (SELECT 'n' || o_orderkey AS insert_id, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 50 AS BIGINT)) AS ts, CASE o_orderstatus WHEN 'F' THEN 'ERROR' ELSE 'INFO' END AS severity, 'svc-' || (o_custkey % 13) AS service, CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey END AS lt FROM orders), "
            "rt AS (SELECT * FROM s WHERE parent_span_id IS NULL AND trace_id IN (SELECT target_trace_id FROM pr)), nr AS (SELECT rt.trace_id, insert_id, row_number() OVER (PARTITION BY rt.trace_id ORDER BY ts, insert_id) AS k FROM rt JOIN lg ON lg.service = rt.service AND ts BETWEEN start_time - INTERVAL 30 SECOND AND end_time + INTERVAL 30 SECOND WHERE severity = 'ERROR' AND (lt IS NULL OR lt <> rt.trace_id)) "
            "SELECT baseline_trace_id, target_trace_id, 'log_direct' AS finding, insert_id AS subject FROM pr JOIN lg ON lt = target_trace_id UNION ALL SELECT baseline_trace_id, target_trace_id, 'log_nearby', insert_id FROM pr JOIN nr ON trace_id = target_trace_id WHERE k <= 20"
        ),
    ),
    "deep_dive_pipeline_with_changes": (
        lambda spark, d: P.deep_dive_pipeline(A.spans_from_orders(spark, d), customer_pairs(spark, d), 2, order_changes(spark, d), 2 * 1440),
        f"WITH c AS ({TRACES['causal_analysis'][1]}), x AS ({Q.with_orders('SELECT trace_id, span_id, service, start_time FROM s')}), b AS ({FLEET['blast_radius'][1]}), ch AS (SELECT 'svc-' || (o_custkey % 10) AS service, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey FROM orders WHERE o_orderkey % 10 = 0), "
        "st AS (SELECT DISTINCT service, start_time FROM c JOIN x ON x.trace_id = target_trace_id AND x.span_id = c.span_id WHERE is_root_cause), "
        "l AS (SELECT st.service, start_time, count(*) AS changes, max({'ts': ts, 'k': o_orderkey}) AS m FROM st JOIN ch ON ch.service = st.service AND ts BETWEEN start_time - INTERVAL 2 DAY AND start_time GROUP BY 1, 2) "
        "SELECT baseline_trace_id, target_trace_id, c.span_id, x.service AS service_name, diff_ms, score, affected_services, changes, m.k AS change_id, CASE WHEN m IS NOT NULL THEN 'services.Deploy' END AS method, m.ts AS changed_at FROM c JOIN x ON x.trace_id = target_trace_id AND x.span_id = c.span_id LEFT JOIN b ON b.service_name = x.service LEFT JOIN l ON l.service = x.service AND l.start_time = x.start_time WHERE is_root_cause",
    ),
    "deep_dive_pipeline": (
        lambda spark, d: P.deep_dive_pipeline(A.spans_from_orders(spark, d), customer_pairs(spark, d), 2),
        f"SELECT baseline_trace_id, target_trace_id, c.span_id, service AS service_name, diff_ms, score, affected_services FROM ({TRACES['causal_analysis'][1]}) c JOIN ({Q.with_orders('SELECT trace_id, span_id, service FROM s')}) x ON x.trace_id = c.target_trace_id AND x.span_id = c.span_id LEFT JOIN ({FLEET['blast_radius'][1]}) b ON b.service_name = service WHERE is_root_cause",
    ),
    "log_pattern_pipeline": (
        _log_periods,
        f"SELECT c.*, alert_level FROM ({SIGNALS['compare_log_patterns'][1]}) c, (SELECT alert_level FROM ({SIGNALS['alert_level'][1]})) WHERE change <> 'stable'",
    ),
    "stream_log_patterns": (
        _stream,
        f"WITH l AS (SELECT 'event ' || event_type || ' user ' || user_id || ' props ' || props AS body, CAST(ts AS TIMESTAMP) AS t, event_type FROM events) SELECT time_bucket(INTERVAL 6 HOUR, t, TIMESTAMP '1970-01-01') AS window_start, {_MASKED} AS pattern_signature, count(*) AS occurrence_count, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings, min(t) AS first_seen, max(t) AS last_seen FROM l GROUP BY 1, 2",
    ),
}
