"""Readers and document operators over documents that are derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import cluster as K
from ..operators import logs as L
from ..sources import adapters as A
from ..sources import readers as R
from . import sql as Q

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def trace_documents(spark: SparkSession, d: str) -> DataFrame:
    """The order traces as documents with times as text."""
    iso = lambda c: F.date_format(F.col(c), _ISO)
    s = A.spans_from_orders(spark, d)
    one = F.struct("span_id", "name", iso("start_time").alias("start_time"), iso("end_time").alias("end_time"), "parent_span_id", F.col("attributes").alias("labels"))
    return s.groupBy("trace_id").agg(F.collect_list(one).alias("spans")).withColumn("project_id", F.lit("p"))


def _as_files(documents: DataFrame) -> str:
    """The documents as compressed JSON files in the shared folder: their path."""
    path = f"{shared_folder(documents.sparkSession)}/documents-{uuid.uuid4().hex}"
    documents.write.json(path, compression="gzip")
    return path


def series_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document for each series and hour, as they are polled, so none grows with the history."""
    p = A.metrics_from_events(spark, d)
    point = F.struct(F.date_format("ts", _ISO).alias("timestamp"), "value")
    g = p.groupBy("metric_type", F.col("metric_labels")["shard"].alias("shard"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.collect_list(point).alias("points"))
    return g.select(F.struct(F.col("metric_type").alias("type"), F.create_map(F.lit("shard"), "shard").alias("labels")).alias("metric"), F.struct(F.lit("service").alias("type"), F.create_map(F.lit("k"), F.lit("v")).alias("labels")).alias("resource"), "points")


def alerts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Error events are alerts, services their policies; those of service 9 have none."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'")
    raised = e.select("event_id", F.concat(F.lit("policy-"), F.col("user_id") % 10).alias("policy_name"), F.when(F.col("event_id") % 2 == 0, "OPEN").otherwise("CLOSED").alias("state"), F.col("ts").alias("open_time"))
    k = e.select((F.col("user_id") % 10).alias("k")).filter("k < 9").distinct()
    policies = k.select(F.concat(F.lit("policy-"), "k").alias("name"), F.concat(F.lit("Policy "), "k").alias("display_name"), F.create_map(F.lit("team"), F.concat(F.lit("t"), "k")).alias("user_labels"), F.array_repeat(F.lit("c"), F.col("k").cast("int")).alias("conditions"), (F.col("k") % 2 == 0).alias("enabled"))
    return raised, policies


def slo_documents(spark: SparkSession, d: str) -> DataFrame:
    """An objective for each customer segment by nation: latency for even ones, availability for odd ones."""
    n = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("k")).distinct()
    limit = F.struct((F.col("k") % 3).cast("long").alias("seconds"), (F.col("k") * 1_000_000).cast("long").alias("nanos"))
    even = F.col("k") % 2 == 0
    basic = F.struct(F.when(even, F.struct(limit.alias("threshold"))).alias("latency"), F.when(~even, F.struct(F.lit(1).alias("x"))).alias("availability"))
    sli = F.struct(F.when(F.col("k") % 5 != 0, basic).alias("basicSli"), F.when(F.col("k") % 5 == 0, F.struct(F.lit(1).alias("x"))).alias("requestBased"), F.lit(None).cast("struct<x:int>").alias("windowsBased"))
    return n.select(F.concat(F.lit("slo-"), "k").alias("name"), F.concat(F.lit("Objective "), "k").alias("displayName"), (0.9 + F.col("k") / 1000).alias("goal"), F.struct((F.col("k") % 30).cast("int").alias("days")).alias("rollingPeriod"), sli.alias("serviceLevelIndicator"))


def cluster_documents(spark: SparkSession, d: str) -> DataFrame:
    """A cluster for each nation of the suppliers, a node pool for each supplier."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    pool = F.struct(F.concat(F.lit("pool-"), k).alias("name"), F.when(k % 4 == 0, "RECONCILING").otherwise("RUNNING").alias("status"), (k % 7).cast("int").alias("initialNodeCount"), F.when(k % 2 == 0, F.struct(F.lit(True).alias("enabled"), F.lit(1).alias("minNodeCount"), (k % 9).cast("int").alias("maxNodeCount"))).alias("autoscaling"))
    g = s.groupBy("s_nationkey").agg(F.collect_list(pool).alias("nodePools"))
    n = F.col("s_nationkey")
    condition = F.array(F.struct(F.lit("Ready").alias("type"), F.when(n % 3 == 0, "False").otherwise("True").alias("status")))
    return g.select(F.concat(F.lit("c"), n).alias("name"), F.lit("x").alias("location"), F.when(n % 4 == 0, "DEGRADED").when(n % 4 == 1, "RECONCILING").otherwise("RUNNING").alias("status"), "nodePools", condition.alias("conditions"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return R.read_trace_documents(spark, _as_files(trace_documents(spark, d))).select("trace_id", "span_id", "parent_span_id", "name", "start_time", (F.col("duration_nano") / 1000).cast("long").alias("duration_us"), F.col("attributes")["peer.service"].alias("peer"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return R.read_time_series(spark, _as_files(series_documents(spark, d))).select("metric_type", F.col("metric_labels")["shard"].alias("shard"), "ts", "value")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return R.alerts_with_policy(*alerts(spark, d)).select("event_id", "policy_name", "open_time", "policy_display_name", F.col("policy_labels")["team"].alias("team"), "condition_count", "policy_enabled")


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    logs = A.logs_from_events(spark, d)
    patterns = L.log_signature_patterns(logs, F.col("body.string_value"), limit=None).select(F.md5(F.col("pattern_signature").cast("binary")).alias("pattern_id"), F.col("pattern_signature").alias("template"))
    kinds = spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct()
    known = kinds.select(F.concat(F.lit("i-"), "event_type").alias("incident_id"), F.when(F.col("event_type").isin("error", "click"), F.concat(F.lit("event "), "event_type")).otherwise("nothing like it").alias("pattern"), F.concat(F.lit("Too many "), "event_type").alias("title"), F.lit("").alias("root_cause"), F.lit("s").alias("service"), F.lit("2024-01-01").alias("date"))
    return L.similar_incidents(patterns, known).select("pattern_id", "incident_id", "match")


_SIG = "body"
for _p, _n in L.SIGNATURE_MASKS:
    _SIG = f"regexp_replace({_SIG}, '{_p}', '{_n}', 'g')"

QUERIES = {
    "read_trace_documents": (_spans, Q.with_orders("SELECT trace_id, span_id, parent_span_id, name, start_time, CAST(epoch_us(end_time) - epoch_us(start_time) AS BIGINT) AS duration_us, peer FROM s")),
    "read_time_series": (_points, "SELECT event_type AS metric_type, CAST(user_id % 10 AS VARCHAR) AS shard, CAST(ts AS TIMESTAMP) AS ts, value FROM events"),
    "alerts_with_policy": (
        _alerts,
        "SELECT event_id, 'policy-' || k AS policy_name, CAST(ts AS TIMESTAMP) AS open_time, CASE WHEN k < 9 THEN 'Policy ' || k END AS policy_display_name, CASE WHEN k < 9 THEN 't' || k END AS team, CASE WHEN k < 9 THEN CAST(k AS INTEGER) END AS condition_count, CASE WHEN k < 9 THEN k % 2 = 0 END AS policy_enabled FROM (SELECT *, user_id % 10 AS k FROM events WHERE event_type = 'error' AND event_id % 2 = 0)",
    ),
    "read_slos": (
        lambda spark, d: R.slo_definitions(slo_documents(spark, d)),
        "SELECT 'slo-' || k AS name, 'Objective ' || k AS display_name, 0.9::DOUBLE + k / 1000::DOUBLE AS goal, CAST(k % 30 AS INTEGER) AS rolling_days, CASE WHEN k % 5 = 0 THEN 'request_based' ELSE 'basic' END AS sli_type, CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'latency' ELSE 'availability' END END AS sli_metric, CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN (k % 3) * 1000 + k::DOUBLE END AS latency_threshold_ms FROM (SELECT DISTINCT c_nationkey AS k FROM customer)",
    ),
    "cluster_health": (
        lambda spark, d: K.cluster_health(cluster_documents(spark, d)),
        "SELECT 'c' || s_nationkey AS name, 'x' AS location, CASE WHEN s_nationkey % 4 = 0 THEN 'DEGRADED' WHEN s_nationkey % 4 = 1 THEN 'UPDATING' ELSE 'HEALTHY' END AS health, CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS bad_conditions, 'pool-' || s_suppkey AS pool, CASE WHEN s_suppkey % 4 = 0 THEN 'RECONCILING' ELSE 'RUNNING' END AS pool_status, CAST(s_suppkey % 7 AS INTEGER) AS node_count, s_suppkey % 2 = 0 AS autoscaling, CASE WHEN s_suppkey % 2 = 0 THEN 1 END AS min_nodes, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 9 AS INTEGER) END AS max_nodes, s_suppkey % 4 = 0 AS is_upgrading FROM supplier",
    ),
    "similar_incidents": (
        _incidents,
        Q.with_logs(f"p AS (SELECT DISTINCT {_SIG} AS t FROM logs), i AS (SELECT DISTINCT event_type AS e FROM events), d AS (SELECT t, e FROM p, i WHERE e IN ('error', 'click') AND contains(lower(t), 'event ' || e)), w AS (SELECT DISTINCT t, unnest(string_split(lower(t), ' ')) AS word FROM p WHERE t NOT IN (SELECT t FROM d)) SELECT md5(t) AS pattern_id, 'i-' || e AS incident_id, 'pattern' AS match FROM d UNION ALL SELECT DISTINCT md5(t), 'i-' || e, 'word' FROM w, i WHERE word <> '' AND contains('too many ' || e, word)"),
    ),
}
