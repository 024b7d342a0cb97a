"""Aggregations over all spans of a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.groups import beside, distinct_count, samples
from ..functions.lineage import cut
from ..functions.quantiles import percentiles, quantile, running_counts, summarise

#: Upper bounds of the latency histogram, in milliseconds.
LATENCY_BOUNDS = [10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]


#: Percentiles of the column ms that most aggregates give.
LATENCY = {"p50_ms": ("ms", 0.5), "p95_ms": ("ms", 0.95), "p99_ms": ("ms", 0.99)}


def _counts() -> list[Column]:
    return [F.count("*").alias("request_count"), F.count_if(C.is_error()).alias("error_count"), C.error_rate().alias("error_rate_pct")]


def aggregate_metrics(spans: DataFrame, as_of: str, hours: float = 24, group_by: str = "service_name", service: str | None = None, operation: str | None = None, min_duration_ms: float | None = None, limit: int = 50, exact: bool = False) -> DataFrame:
    """Requests, errors and latency of root spans by service_name, operation_name or status_code; worst first."""
    keys = {"service_name": C.service(), "operation_name": F.col("name"), "status_code": C.status_code()}
    df = C.min_duration_filter(C.operation_filter(C.service_filter(C.root_spans(C.time_window(spans, hours, as_of)), service), operation), min_duration_ms)
    df = df.select(keys[group_by].alias(group_by), "start_time", "status", C.ms().alias("ms"))
    out = summarise(df, [group_by], [*_counts(), F.round(F.avg("ms"), 2).alias("avg_ms"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen")], LATENCY, exact)
    return out.orderBy(F.desc("error_rate_pct"), F.desc("p99_ms"), group_by).limit(limit)


def service_stats_all_spans(spans: DataFrame, start: str, end: str, exact: bool = False) -> DataFrame:
    """All spans with a service that start in [start, end], by service; busiest first."""
    df = spans.filter(F.col("start_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")) & C.service().isNotNull())
    df = df.select(C.service().alias("service_name"), C.ms().alias("ms"), C.is_error().alias("bad"))
    out = summarise(df, ["service_name"], [F.count("*").alias("span_count"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.count_if("bad").alias("error_count")], LATENCY, exact)
    return out.orderBy(F.desc("span_count"), "service_name")


def baseline_traces_near_p50(spans: DataFrame, service: str, limit: int = 10) -> DataFrame:
    """Root spans of a service whose duration is nearest to its continuous median."""
    df = cut(C.service_filter(C.root_spans(spans), service).select("trace_id", "span_id", C.ms().alias("duration_ms")))
    middle = percentiles(df, [], "duration_ms", continuous={"p50": 0.5})
    return df.crossJoin(F.broadcast(middle)).select("trace_id", "duration_ms", F.abs(F.col("duration_ms") - F.col("p50")).alias("distance")).orderBy("distance", "trace_id").limit(limit).select("trace_id", "duration_ms")


def anomaly_traces_p99_or_error(spans: DataFrame, service: str, limit: int = 10) -> DataFrame:
    """Root spans of a service at or over its continuous 99th percentile, or with an error; slowest first."""
    df = cut(C.service_filter(C.root_spans(spans), service).select("trace_id", C.ms().alias("duration_ms"), C.is_error().alias("is_error")))
    top = percentiles(df, [], "duration_ms", continuous={"p99": 0.99})
    return df.crossJoin(F.broadcast(top)).filter((F.col("duration_ms") >= F.col("p99")) | F.col("is_error")).orderBy(F.desc("duration_ms"), "trace_id").limit(limit).select("trace_id", "duration_ms", "is_error")


def exemplars(spans: DataFrame, as_of: str, strategy: str = "outliers", hours: float = 24, service: str | None = None, limit: int = 10, exact: bool = False) -> DataFrame:
    """Example traces: outliers (at or over p95), errors (newest), baseline (within 10 % of p50, no error), or comparison
    (half baseline, half outliers)."""
    df = C.service_filter(C.root_spans(C.time_window(spans, hours, as_of)), service)
    df = df.select("trace_id", "start_time", C.service().alias("service_name"), "name", F.round(C.ms(), 2).alias("duration_ms"), C.is_error().alias("is_error"))
    if strategy == "errors":
        return df.filter("is_error").orderBy(F.desc("start_time"), "trace_id").limit(limit).select("trace_id", "service_name", "name", "duration_ms", F.lit("error_trace").alias("selection_reason"))
    marks = {"outliers": 0.95, "baseline": 0.5}
    if exact:
        df = cut(df)
        level = percentiles(df, [], "duration_ms", discrete=marks)
    else:
        level = df.agg(*[quantile(F.col("duration_ms"), p).alias(n) for n, p in marks.items()])
    df = df.crossJoin(F.broadcast(level))

    def chosen(kind: str, n: int) -> DataFrame:
        mark = F.col(kind)
        if kind == "outliers":
            above = F.round((F.col("duration_ms") - mark) / mark * 100, 2).alias("pct_above_p95")
            return df.filter(F.col("duration_ms") >= mark).orderBy(F.desc("duration_ms"), "trace_id").limit(n).select("trace_id", "service_name", "name", "duration_ms", above)
        distance = F.abs(F.col("duration_ms") - mark)
        return df.filter(~F.col("is_error") & (distance < 0.1 * mark)).orderBy(distance, "trace_id").limit(n).select("trace_id", "service_name", "name", "duration_ms")

    if strategy != "comparison":
        return chosen(strategy, limit)
    parts = [chosen(k, max(1, limit // 2)).select("trace_id", "duration_ms", F.lit(k).alias("selection_reason")) for k in ("baseline", "outliers")]
    return parts[0].unionByName(parts[1]).orderBy("selection_reason", "duration_ms", "trace_id")


def compare_time_periods(spans: DataFrame, as_of: str, baseline: tuple[float, float], anomaly: tuple[float, float], exact: bool = False) -> DataFrame:
    """Root spans of two windows (hours before as_of, from and until) by service and period, with the change from
    baseline to anomaly on the anomaly row."""
    parts = [C.time_window(C.root_spans(spans), p[0], as_of, until_hours=p[1]).withColumn("period", F.lit(n)).withColumn("step", F.lit(k)) for k, (n, p) in enumerate((("baseline", baseline), ("anomaly", anomaly)))]
    both = parts[0].unionByName(parts[1]).select(C.service().alias("service_name"), "period", "step", "status", C.ms().alias("ms"))
    out = summarise(both, ["service_name", "period", "step"], _counts(), {"p95_ms": ("ms", 0.95)}, exact)
    w = Window.partitionBy("service_name").orderBy("step")
    old, rate = F.lag("p95_ms").over(w), F.lag("error_rate_pct").over(w)
    return out.select(
        "service_name", "period", "request_count", "error_count", "error_rate_pct", "p95_ms", F.round(F.col("p95_ms") - old, 2).alias("p95_delta_ms"),
        F.round(F.try_divide(F.col("p95_ms") - old, old) * 100, 1).alias("p95_change_pct"), F.round(F.col("error_rate_pct") - rate, 2).alias("error_rate_delta"),
    )


def trend_changes(spans: DataFrame, as_of: str, hours: float, metric: str = "p95", bucket_hours: int = 1, min_samples: int = 10, by_service: bool = False, exact: bool = False) -> DataFrame:
    """Buckets of root spans with at least min_samples, their three-bucket moving average and the change since the last one.

    One bucket is one row, so the ordered window holds hours divided by bucket_hours rows, not spans."""
    tails = {"p95": {"value": ("ms", 0.95)}, "p99": {"value": ("ms", 0.99)}}
    rates = {"error_rate": F.count_if("bad") / F.count("*") * 100, "throughput": F.count("*").cast("double")}
    keys = ["service_name"] if by_service else []
    df = C.time_window(C.root_spans(spans), hours, as_of).withColumn("service_name", C.service())
    size = bucket_hours * 3_600_000_000
    bucket = F.expr(f"cast(timestamp_micros(unix_micros(cast(start_time as timestamp)) div {size} * {size}) as timestamp_ntz)")
    df = df.select(*keys, bucket.alias("bucket"), C.ms().alias("ms"), C.is_error().alias("bad"))
    facts = [F.count("*").alias("sample_count"), *([F.round(rates[metric], 2).alias("value")] if metric in rates else [])]
    out = summarise(df, [*keys, "bucket"], facts, tails.get(metric, {}), exact).filter(F.col("sample_count") >= min_samples)
    w = Window.partitionBy(*keys).orderBy("bucket")
    old = F.lag("value").over(w)
    change = F.try_divide(F.col("value") - old, old) * 100
    size_of = F.abs(change)
    return out.select(
        *keys, "bucket", "sample_count", "value", F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving_avg"), F.round(F.col("value") - old, 2).alias("delta"),
        F.round(change, 1).alias("pct_change"), F.when(size_of >= 20, "SIGNIFICANT").when(size_of >= 10, "MODERATE").otherwise("STABLE").alias("change_class"),
    )


def span_events(spans: DataFrame, event_name: str | None = None, service: str | None = None, limit: int = 100) -> DataFrame:
    """The newest events of spans with their exception labels."""
    df = C.service_filter(spans, service).select("trace_id", "span_id", C.service().alias("service_name"), "name", F.explode("events").alias("e"))
    df = df if event_name is None else df.filter(F.col("e.name") == event_name)
    labels = [F.col("e.attributes")[f"exception.{k}"].alias(f"exception_{k}") for k in ("type", "message", "stacktrace")]
    return df.select("trace_id", "span_id", "service_name", F.col("name").alias("span_name"), F.col("e.name").alias("event_name"), F.col("e.time").alias("event_time"), *labels).orderBy(F.desc("event_time"), "span_id", "event_name", *[f"exception_{k}" for k in ("type", "message", "stacktrace")]).limit(limit)


def exception_patterns(spans: DataFrame, group_by: str = "exception_type", limit: int = 50) -> DataFrame:
    """Exception events by exception_type or service_name."""
    df = spans.select("trace_id", C.service().alias("service_name"), F.explode("events").alias("e")).filter("e.name = 'exception'")
    df = df.select("trace_id", "service_name", F.col("e.attributes")["exception.type"].alias("exception_type"), F.col("e.attributes")["exception.message"].alias("message"))
    out = df.groupBy(group_by).agg(F.count("*").alias("exception_count"), F.countDistinct("trace_id").alias("affected_traces"), F.countDistinct("service_name").alias("affected_services"))
    out = beside(out, [group_by], samples(df, [group_by], "message", "sample_messages"), otherwise={"sample_messages": ""})
    return out.orderBy(F.desc("exception_count"), group_by).limit(limit)


def span_links(spans: DataFrame, limit: int = 100) -> DataFrame:
    """Links of spans, whichever of the two label spellings they use."""
    df = spans.select("trace_id", "span_id", C.service().alias("service_name"), "name", F.explode("links").alias("l"))
    label = lambda k: F.coalesce(F.col("l.attributes")[k], F.col("l.attributes")[f"link.{k}"])
    out = df.select("trace_id", "span_id", "service_name", F.col("name").alias("span_name"), F.col("l.trace_id").alias("linked_trace_id"), F.col("l.span_id").alias("linked_span_id"), label("type").alias("link_type"), label("reason").alias("link_reason"), F.to_json("l.attributes").alias("link_attributes"))
    return out.orderBy("trace_id", "span_id", "linked_trace_id", "linked_span_id", "link_attributes").limit(limit)


def link_patterns(spans: DataFrame) -> DataFrame:
    """Services with linked spans: how many, and links a linked span."""
    n = F.size("links")
    out = spans.filter(n > 0).groupBy(C.service().alias("service_name")).agg(F.count("*").alias("spans_with_links"), F.sum(n).alias("total_links"), F.round(F.avg(n), 2).alias("avg_links_per_span"))
    return out.orderBy(F.desc("total_links"), "service_name")


def instrumentation_libraries(spans: DataFrame) -> DataFrame:
    scope = [F.col(f"instrumentation_scope.{k}").alias(f"library_{k}") for k in ("name", "version", "schema_url")]
    df = spans.select("trace_id", C.service().alias("service_name"), *scope)
    keys = ["library_name", "library_version", "library_schema_url"]
    out = df.groupBy(*keys).agg(F.count("*").alias("span_count"), F.countDistinct("service_name").alias("service_count"), F.countDistinct("trace_id").alias("trace_count"))
    out = beside(out, keys, samples(df, keys, "service_name", "sample_services"), otherwise={"sample_services": ""})
    return out.orderBy(F.desc("span_count"), "library_name")


def http_attributes(spans: DataFrame, min_count: int = 10, exact: bool = False) -> DataFrame:
    """Server spans by method, target and status."""
    size = lambda k: F.round(F.avg(C.attr(k).try_cast("double")), 2)
    keys = {"http_method": "http.method", "http_target": "http.target", "http_status": "http.status_code"}
    df = C.kind_filter(spans, C.SERVER).select(*[C.attr(a).alias(k) for k, a in keys.items()], "attributes", C.ms().alias("ms"))
    out = summarise(df, list(keys), [F.count("*").alias("request_count"), size("http.request_content_length").alias("avg_request_size"), size("http.response_content_length").alias("avg_response_size")], LATENCY, exact)
    return out.filter(F.col("request_count") >= min_count).orderBy(F.desc("request_count"), "http_method", "http_target", "http_status")


def database_operations(spans: DataFrame, db_system: str | None = None, exact: bool = False) -> DataFrame:
    """Client spans by database system, name and operation; spans without a database are one group."""
    df = C.kind_filter(spans, C.CLIENT)
    df = df if db_system is None else df.filter(C.attr("db.system") == db_system)
    df = df.select(C.attr("db.system").alias("db_system"), C.attr("db.name").alias("db_name"), C.attr("db.operation").alias("db_operation"), C.attr("db.statement").alias("statement"), C.ms().alias("ms"))
    df = cut(df)
    keys = ["db_system", "db_name", "db_operation"]
    out = summarise(df, keys, [F.count("*").alias("call_count"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.min("statement").alias("any_statement")], {"p95_ms": ("ms", 0.95)}, exact)
    out = beside(out, keys, samples(df, keys, "statement", "sample_statements", 3), otherwise={"sample_statements": ""})
    return out.orderBy(F.desc("call_count"), "db_system", "db_name", "db_operation")


def service_level_stats(spans: DataFrame) -> DataFrame:
    """All spans by the service they name in any of the usual places."""
    out = spans.groupBy(C.span_service_name().alias("service_name")).agg(F.count("*").alias("span_count"), F.round(F.count_if(C.error_by_text()) / F.count("*") * 100, 2).alias("error_rate"), F.round(F.avg(C.ms()), 2).alias("avg_latency_ms"))
    return out.orderBy("service_name")


def bottleneck_services(spans: DataFrame, min_traces: int = 10, limit: int = 20, exact: bool = False) -> DataFrame:
    """Which operations take the largest share of their traces, over traces with at least two spans."""
    keys = ["service_name", "operation_name"]
    df = spans.select("trace_id", "span_id", "parent_span_id", C.service().alias("service_name"), F.col("name").alias("operation_name"), C.ms().alias("ms"), C.is_error().alias("is_error"))
    totals = df.groupBy("trace_id").agg(F.sum(F.when(F.col("parent_span_id").isNull(), F.col("ms"))).alias("trace_ms"), F.count("*").alias("n")).filter("n >= 2")
    parents = df.filter("parent_span_id is not null").select("trace_id", F.col("parent_span_id").alias("span_id"), F.lit(1).alias("has_child")).distinct()
    flagged = df.join(totals.select("trace_id", "trace_ms"), "trace_id").join(parents, ["trace_id", "span_id"], "left")
    flagged = cut(flagged.select(*keys, "trace_id", "ms", "is_error", "has_child", F.try_divide(F.col("ms"), F.col("trace_ms")).alias("share")).withColumn("share", F.col("share") * 100))
    facts = [F.round(F.avg("share"), 2).alias("avg_contribution_pct"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.count_if(F.col("has_child").isNull()).alias("leaf_count"), F.round(F.count_if("is_error") / F.count("*") * 100, 2).alias("error_rate_pct")]
    out = summarise(flagged, keys, facts, {"p95_contribution_pct": ("share", 0.95), "p95_ms": ("ms", 0.95)}, exact)
    # traces are counted apart: next to a distinct count every percentile would keep a sketch for each trace
    out = beside(out, keys, distinct_count(flagged, keys, "trace_id", "trace_count"))
    score = 0.4 * F.col("avg_contribution_pct") + 0.3 * F.col("p95_contribution_pct") / 100 + 0.3 * F.col("trace_count") / min_traces
    return out.filter(F.col("trace_count") >= min_traces).withColumn("bottleneck_score", F.round(score, 2)).orderBy(F.desc("bottleneck_score"), "service_name", "operation_name").limit(limit)


def critical_path_contribution(spans: DataFrame, service: str, operation: str | None = None, exact: bool = False) -> DataFrame:
    """How much the spans of a service (and operation) take of their traces' longest root span."""
    mine = C.operation_filter(C.service_filter(spans, service), operation).select("trace_id", C.service().alias("service_name"), F.col("name").alias("operation_name"), C.ms().alias("ms"), C.is_error().alias("is_error"))
    totals = C.root_spans(spans).groupBy("trace_id").agg(F.max(C.ms()).alias("trace_ms"))
    df = mine.join(totals, "trace_id").withColumn("share", F.try_divide(F.col("ms"), F.col("trace_ms")) * 100)
    facts = [
        F.count("*").alias("span_count"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.round(F.avg("share"), 2).alias("avg_contribution_pct"), F.round(F.avg("trace_ms"), 2).alias("avg_trace_ms"),
        F.round(F.count_if("is_error") / F.count("*") * 100, 2).alias("error_rate_pct"),
    ]
    out = summarise(df, ["service_name", "operation_name"], facts, LATENCY | {"p50_contribution_pct": ("share", 0.5), "p95_contribution_pct": ("share", 0.95)}, exact)
    return out.withColumn("weighted_impact", F.round(F.col("avg_ms") * F.col("avg_contribution_pct") / 100, 2)).orderBy(F.desc("weighted_impact"), "operation_name")


def latency_histogram(spans: DataFrame, exact: bool = False) -> DataFrame:
    """Cumulative counts of spans at or under each latency bound, by service."""
    bounds = [F.count_if(F.col("ms") <= b).alias(f"le_{b}") for b in LATENCY_BOUNDS]
    df = spans.select(C.service().alias("service_name"), C.ms().alias("ms"))
    return summarise(df, ["service_name"], [*bounds, F.count("*").alias("le_inf")], LATENCY, exact).orderBy("service_name")


def latency_exemplars_by_percentile(spans: DataFrame, threshold: float = 95, limit: int = 20, exact: bool = False) -> DataFrame:
    """The slowest server root spans at or over a percentile rank of their service.

    The rank is taken over the distinct durations of a service with their counts, not over its spans one by one."""
    df = cut(C.kind_filter(C.root_spans(spans), C.SERVER).select("trace_id", C.service().alias("service_name"), C.ms().alias("ms")))
    counts = running_counts(df, ["service_name"], "ms")
    ranked = counts.select("service_name", "ms", F.coalesce(F.try_divide(F.col("_upto") - F.col("_n"), F.col("_all") - 1), F.lit(0.0)).alias("rank")).filter(F.col("rank") * 100 >= threshold)
    marks = summarise(df, ["service_name"], [F.count("*").alias("_rows")], {"service_p95_ms": ("ms", 0.95), "service_p99_ms": ("ms", 0.99)}, exact).drop("_rows")
    label = F.lit("+Inf")
    for b in reversed(LATENCY_BOUNDS):
        label = F.when(F.col("ms") <= b, f"<={b}ms").otherwise(label)
    out = df.join(ranked, ["service_name", "ms"]).join(marks, "service_name")
    return out.select("trace_id", "service_name", F.round("ms", 2).alias("duration_ms"), F.round(F.col("rank") * 100, 2).alias("percentile"), label.alias("latency_bucket"), "service_p95_ms", "service_p99_ms").orderBy(F.desc("duration_ms"), "trace_id").limit(limit)
