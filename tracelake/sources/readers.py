"""Readers and normalisers of span, log, metric and policy tables, and the writer of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import severity_rank, time_window
from ..schema import LOG_ENTRY_SCHEMA, SERIES_SCHEMA, SPAN_SCHEMA, TRACE_DOCUMENT_SCHEMA


def read_spans(spark: SparkSession, path: str | None = None, table: str | None = None) -> DataFrame:
    """Spans in the fixed schema, from Parquet or a table; columns that are missing come out null."""
    return spark.table(table) if table else spark.read.schema(SPAN_SCHEMA).parquet(path)


def _time(text: F.Column) -> F.Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def trace_documents_to_spans(documents: DataFrame) -> DataFrame:
    """Trace documents (trace_id, project_id, spans) as a row for each span with its trace's duration; times that cannot
    be read are null."""
    at = lambda name, pick: F.unix_micros(pick(F.transform("spans", lambda s: _time(s[name]))).cast("timestamp"))
    whole = (at("end_time", F.array_max) - at("start_time", F.array_min)) / 1000
    df = documents.select("trace_id", "project_id", whole.alias("trace_duration_ms"), F.explode("spans").alias("s"))
    start, end = _time(F.col("s.start_time")), _time(F.col("s.end_time"))
    nano = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) * 1000
    labels = F.coalesce(F.col("s.labels"), F.create_map().cast("map<string,string>"))
    return df.select(
        "trace_id", "project_id", F.col("s.span_id").alias("span_id"), F.nullif(F.col("s.parent_span_id"), F.lit("")).alias("parent_span_id"), F.col("s.name").alias("name"), F.lit(None).cast("int").alias("kind"),
        start.alias("start_time"), end.alias("end_time"), nano.alias("duration_nano"), F.struct(F.lit(0).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"), labels.alias("attributes"), F.struct(labels.alias("attributes")).alias("resource"), "trace_duration_ms",
    )


def read_trace_documents(spark: SparkSession, path: str) -> DataFrame:
    return trace_documents_to_spans(spark.read.schema(TRACE_DOCUMENT_SCHEMA).json(path))


def read_log_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_ENTRY_SCHEMA).json(path)


def list_log_entries(logs: DataFrame, min_severity: str | None = None, resource_type: str | None = None, contains: str | None = None, trace_id: str | None = None, labels: dict[str, str] | None = None, start: str | None = None, end: str | None = None, limit: int = 50) -> DataFrame:
    """Log rows that meet all the given conditions, newest first."""
    df = logs
    if min_severity:
        df = df.filter(severity_rank(F.col("severity_text")) >= severity_rank(F.lit(min_severity)))
    if resource_type:
        df = df.filter(F.col("resource.type") == resource_type)
    if contains:
        df = df.filter(F.contains(F.lower("body.string_value"), F.lit(contains.lower())))
    if trace_id:
        df = df.filter(F.col("trace_id") == trace_id)
    for k, v in (labels or {}).items():
        df = df.filter(F.col("resource.attributes")[k] == v)
    if start:
        df = df.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    return df.orderBy(F.desc("timestamp"), "insert_id").limit(limit)


def entries_with_fields(entries: DataFrame, fields: dict[str, str], payload: str = "jsonPayload") -> DataFrame:
    """Log entries whose JSON payload has the given values at the given paths ("user.id"), compared as text."""
    for path, value in fields.items():
        entries = entries.filter(F.get_json_object(payload, f"$.{path}") == value)
    return entries


def normalize_log_entries(entries: DataFrame, longest: int = 2000) -> DataFrame:
    """Log entries with one payload (cut at ``longest`` characters) and the bare trace id."""
    payload = F.coalesce("textPayload", "jsonPayload", "protoPayload")
    cut = F.when(F.length(payload) > longest, F.concat(F.substring(payload, 1, longest), F.lit("...(truncated)"))).otherwise(payload)
    parts = F.split("trace", "/")
    trace = F.when(F.size(parts) >= 4, F.element_at(parts, -1)).otherwise(F.col("trace"))
    return entries.withColumn("payload", cut).withColumn("trace_id", trace)


def error_events(logs: DataFrame, as_of: str, minutes: float) -> DataFrame:
    """Logs of severity ERROR or above of the last minutes up to ``as_of``, with service and version."""
    at = F.col("resource.attributes")
    df = time_window(logs, minutes / 60, as_of, "timestamp").filter(severity_rank(F.col("severity_text")) >= severity_rank(F.lit("ERROR")))
    return df.select(F.col("timestamp").alias("event_time"), F.col("body.string_value").alias("message"), at["service.name"].alias("service"), at["service.version"].alias("version"))


def time_series_points(series: DataFrame) -> DataFrame:
    """Series documents (metric, resource, points) as one row for each point."""
    df = series.select("metric", "resource", F.explode("points").alias("p"))
    return df.select(F.col("metric.type").alias("metric_type"), F.col("metric.labels").alias("metric_labels"), F.col("resource.type").alias("resource_type"), F.col("resource.labels").alias("resource_labels"), _time(F.col("p.timestamp")).alias("ts"), F.col("p.value").cast("double").alias("value"))


def read_time_series(spark: SparkSession, path: str) -> DataFrame:
    return time_series_points(spark.read.schema(SERIES_SCHEMA).json(path))


def select_points(points: DataFrame, metric_type: str | None = None, labels: dict[str, str] | None = None, resource_labels: dict[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Points of a metric type, with the given labels, in a time range (both ends included)."""
    df = points if metric_type is None else points.filter(F.col("metric_type") == metric_type)
    for column, wanted in (("metric_labels", labels), ("resource_labels", resource_labels)):
        for k, v in (wanted or {}).items():
            df = df.filter(F.col(column)[k] == v)
    df = df if start is None else df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def slo_definitions(documents: DataFrame) -> DataFrame:
    """Objective documents (name, displayName, goal, rollingPeriod, serviceLevelIndicator) flattened."""
    sli = F.col("serviceLevelIndicator")
    kind = F.when(sli["basicSli"].isNotNull(), "basic").when(sli["requestBased"].isNotNull(), "request_based").when(sli["windowsBased"].isNotNull(), "windows_based")
    metric = F.when(sli["basicSli"]["latency"].isNotNull(), "latency").when(sli["basicSli"]["availability"].isNotNull(), "availability")
    limit = sli["basicSli"]["latency"]["threshold"]
    return documents.select("name", F.col("displayName").alias("display_name"), "goal", F.col("rollingPeriod.days").alias("rolling_days"), kind.alias("sli_type"), metric.alias("sli_metric"), (limit["seconds"] * 1000 + limit["nanos"] / 1e6).alias("latency_threshold_ms"))


def alerts_with_policy(alerts: DataFrame, policies: DataFrame, state: str | None = "OPEN") -> DataFrame:
    """Alerts, newest first, with the policy that raised them."""
    df = alerts if state is None else alerts.filter(F.col("state") == state)
    flat = policies.select(F.col("name").alias("policy_name"), F.col("display_name").alias("policy_display_name"), F.col("user_labels").alias("policy_labels"), F.size("conditions").alias("condition_count"), F.col("enabled").alias("policy_enabled"))
    return df.join(flat, "policy_name", "left").orderBy(F.desc("open_time"))


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


#: The column that span tables are partitioned by: the day on which a span starts.
SPAN_DATE = "start_date"


def write_spans(spans: DataFrame, table: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Spans as a catalogue table by day of their start, in buckets of their trace's id. Joins and groupings by trace id then
    need no exchange, and a time window reads its days alone. Spans are dealt to their bucket's task first, so a day has one
    file a bucket. Choose buckets so that one of a day holds some hundred megabytes."""
    dealt = spans.withColumn(SPAN_DATE, F.to_date("start_time")).repartition(buckets, "trace_id")
    dealt.write.mode(mode).format("parquet").partitionBy(SPAN_DATE).bucketBy(buckets, "trace_id").sortBy("trace_id").saveAsTable(table)


def spans_between(spark: SparkSession, table: str, start: str, end: str) -> DataFrame:
    """Spans of a table that ``write_spans`` wrote which start in [start, end); other days are not read."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    df = spark.table(table).filter((F.col(SPAN_DATE) >= F.to_date(a)) & (F.col(SPAN_DATE) <= F.to_date(b)))
    return df.filter((F.col("start_time") >= a) & (F.col("start_time") < b)).drop(SPAN_DATE)
