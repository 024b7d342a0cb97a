"""Compositions of operators that answer a whole question in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import cut
from ..operators import correlate, fleet, graph, logs, traces, tree


def aggregate_pipeline(spans: DataFrame, as_of: str, hours: float, max_error_pct: float = 1, max_p99_ms: float = 1000, exact: bool = False) -> DataFrame:
    """Services with too many errors or too slow a tail, each with its slowest and its most typical trace."""
    metrics = fleet.aggregate_metrics(spans, as_of, hours, exact=exact).filter((F.col("error_rate_pct") > max_error_pct) | (F.col("p99_ms") > max_p99_ms))
    found = traces.example_traces(C.time_window(spans, hours, as_of))
    return metrics.select("service_name", "request_count", "error_rate_pct", "p95_ms", "p99_ms").join(found.select("service_name", "anomaly_trace_id", "anomaly_ms", "baseline_trace_id", "baseline_ms"), "service_name")


def triage_pipeline(spans: DataFrame, pairs: DataFrame, logs_of: DataFrame | None = None, log_service: Column | None = None, window_seconds: float = 30) -> DataFrame:
    """What sets the target of each (baseline, target) pair apart, as one long table of findings: timings, structure,
    errors, patterns, and with ``logs_of`` the target's own logs and the troubled ones around it. Latencies are held against all
    spans. Of few pairs only spans of the targets are looked through otherwise; of many, all spans are written once and read by
    every part."""
    keys = ["baseline_trace_id", "target_trace_id"]
    slim = spans.select("trace_id", "span_id", "parent_span_id", "name", "start_time", "end_time", "duration_nano", "status", "attributes", "resource")
    pairs = cut(pairs)
    ids = pairs.select("target_trace_id").distinct()
    if ids.limit(traces.FEW + 1).count() <= traces.FEW:
        targets = cut(traces.of_pairs(slim, pairs, ("target",), exact=False))
    else:
        targets = spans = cut(slim)
    timing = traces.compare_span_timings(spans, pairs).filter("change in ('slower', 'missing', 'new')").select(*keys, F.concat(F.lit("timing_"), "change").alias("finding"), F.col("name").alias("subject"))
    shape = traces.structural_differences(spans, pairs).filter("structure_changed").select(*keys, F.lit("structure").alias("finding"), F.concat_ws("|", "missing_names", "new_names").alias("subject"))
    of_target = lambda df, finding, subject: pairs.join(df, F.col("target_trace_id") == F.col("trace_id")).select(*keys, finding.alias("finding"), subject.cast("string").alias("subject"))
    found = [
        timing, shape, of_target(traces.extract_errors(targets), F.lit("error"), F.col("span_id")), of_target(traces.latency_anomalies(spans), F.lit("latency_anomaly"), F.col("span_id")),
        of_target(traces.all_patterns(targets, with_healthy=False), F.lit("pattern"), F.col("health")),
    ]
    if logs_of is not None:
        near = correlate.logs_for_traces_direct_and_nearby(targets, logs_of, log_service, window_seconds)
        found.append(of_target(near, F.concat(F.lit("log_"), "correlation"), F.col("insert_id")))
    return reduce(DataFrame.unionByName, found)


def deep_dive_pipeline(spans: DataFrame, pairs: DataFrame, depth: int = 1, changes: DataFrame | None = None, minutes: float = 30) -> DataFrame:
    """The root causes of each pair with the services that a failure of theirs reaches, and with ``changes`` the last change of
    the service in the minutes before the span began."""
    causes = cut(tree.causes(spans, pairs).filter("is_root_cause and span_id is not null"))
    found, several = causes.filter("is_single"), causes.filter("not is_single").drop("service_name", "start_time")
    if not several.isEmpty():  # an id may be of several spans: each of them is meant
        services = spans.select(F.col("trace_id").alias("target_trace_id"), "span_id", C.service().alias("service_name"), "start_time")
        found = found.unionByName(several.join(services, ["target_trace_id", "span_id"]))
    radius = graph.blast_radius(spans, depth)
    out = found.join(radius, "service_name", "left").select("baseline_trace_id", "target_trace_id", "span_id", "service_name", "start_time", "diff_ms", "score", "affected_services")
    if changes is None:
        return out.drop("start_time")
    out = cut(out)
    starts = out.select("service_name", F.col("start_time").alias("anomaly_start")).distinct()
    last = correlate.change_correlation(starts, changes, minutes).select("service_name", F.col("anomaly_start").alias("start_time"), "changes", "change_id", "method", "changed_at")
    return out.join(last, ["service_name", "start_time"], "left").drop("start_time")


def log_pattern_pipeline(before: DataFrame, after: DataFrame, **options) -> DataFrame:
    """Patterns of two periods compared, with the alert level of the whole on every row."""
    compared = logs.compare_log_patterns(logs.template_patterns(before, **options), logs.template_patterns(after, **options))
    return compared.filter("change <> 'stable'").crossJoin(F.broadcast(logs.alert_level(compared).select("alert_level")))


def change_pipeline(spans: DataFrame, changes: DataFrame, as_of: str, hours: float, minutes: float = 30, exact: bool = False, bucket_hours: int = 1, min_samples: int = 10) -> DataFrame:
    """The last change before each service's first significant shift of its 95th percentile."""
    shifts = fleet.trend_changes(spans, as_of, hours, bucket_hours=bucket_hours, min_samples=min_samples, by_service=True, exact=exact).filter("change_class = 'SIGNIFICANT'")
    return correlate.change_correlation(shifts.groupBy("service_name").agg(F.min("bucket").alias("anomaly_start")), changes, minutes)
