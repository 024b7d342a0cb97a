"""Analyses of single traces and pairs of traces, done for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.groups import parts_of
from ..functions.lineage import cut
from ..functions.quantiles import percentiles, quantile, ranked
from .tree import shapes, slim

# Words in span names and labels that speak of retries, timeouts and connection pools.
RETRY_WORDS = ["retry", "attempt", "backoff", "reconnect"]
TIMEOUT_WORDS = ["timeout", "deadline", "exceeded", "timed out", "context deadline"]
POOL_WORDS = ["connection", "pool", "acquire", "checkout", "wait"]


def _has(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w))
    return F.coalesce(found, F.lit(False))


def _labels_text() -> Column:
    return F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


def is_timeout() -> Column:
    return _has(F.col("name"), TIMEOUT_WORDS) | _has(_labels_text(), TIMEOUT_WORDS)


def list_traces(spans: DataFrame, limit: int = 50, min_latency_ms: float | None = None, error_only: bool = False, terms: list | None = None) -> DataFrame:
    """A row for each trace from its root span, newest first."""
    df = C.root_spans(C.trace_predicates(spans, terms or []))
    status = F.coalesce(C.attr("/http/status_code"), C.attr("http.status_code"), F.lit("0"))
    out = df.select("trace_id", "name", "start_time", F.round(C.ms(), 2).alias("duration_ms"), status.alias("status"), F.coalesce(C.attr("/http/url"), C.attr("http.target")).alias("url"), C.is_error().alias("is_error"))
    out = out if min_latency_ms is None else out.filter(F.col("duration_ms") >= min_latency_ms)
    return (out.filter("is_error") if error_only else out).drop("is_error").orderBy(F.desc("start_time"), "trace_id").limit(limit)


def extract_errors(spans: DataFrame) -> DataFrame:
    """A row for each label of a span that tells of an error."""
    df = spans.select("trace_id", "span_id", "name", F.explode("attributes").alias("key", "value"))
    code, text = F.col("value").try_cast("int"), F.lower("value")
    http = F.col("key").contains("/http/status_code") | F.col("key").contains("http.status_code")
    kind = (
        F.when(http, F.when(code >= 400, "http_error"))
        .when(F.col("key").contains("grpc.status"), F.when(~text.isin("ok", "0"), "grpc_error"))
        .when(F.lower("key").contains("status") | F.lower("key").contains("code"), F.when(code >= 400, "http_error"))
        .when(_has(F.col("key"), ["error", "exception", "fault", "failure"]) & ~text.isin(C.NOT_ERRORS), F.col("key"))
    )
    return df.withColumn("error_type", kind).filter("error_type is not null").select("trace_id", "span_id", "name", "error_type", F.col("value").alias("error_message"))


def validate_trace_quality(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, issue): missing ids, orphans, negative durations, children outside their parents, bad times."""
    df = spans.select("trace_id", "span_id", "parent_span_id", "start_time", "end_time")
    p = df.filter("span_id is not null").select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("start_time").alias("p_start"), F.col("end_time").alias("p_end"), F.lit(True).alias("known"))
    j = df.join(p, ["trace_id", "parent_span_id"], "left")
    missing = F.col("start_time").isNull() | F.col("end_time").isNull()
    issues = F.array_compact(F.array(
        F.when(F.col("span_id").isNull(), "missing_span_id"), F.when(F.col("parent_span_id").isNotNull() & F.col("known").isNull(), "orphaned_span"),
        F.when(F.col("end_time") < F.col("start_time"), "negative_duration"), F.when((F.col("start_time") < F.col("p_start")) | (F.col("end_time") > F.col("p_end")), "clock_skew"), F.when(missing, "timestamp_error"),
    ))
    return j.select("trace_id", "span_id", F.explode(issues).alias("issue"))


def validate_trace(spans: DataFrame, max_spans: int = 1000, max_ms: float = 300_000) -> DataFrame:
    """Per trace: whether it is fit for analysis, and why not."""
    out = spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"), F.count_if(F.col("span_id").isNull()).alias("no_id"), F.count_if(F.col("name").isNull()).alias("no_name"), F.count_if(F.col("start_time").isNull() | F.col("end_time").isNull()).alias("no_time"),
        (F.max(C.epoch_ms(F.col("end_time"))) - F.min(C.epoch_ms(F.col("start_time")))).alias("duration_ms"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("no_id") > 0, "missing_span_id"), F.when(F.col("no_name") > 0, "missing_name"), F.when(F.col("no_time") > 0, "missing_time"), F.when(F.col("span_count") > max_spans, "too_many_spans"),
        F.when(F.col("duration_ms") <= 0, "no_duration"), F.when(F.col("duration_ms") > max_ms, "too_long"),
    ))
    return out.select("trace_id", "span_count", F.round("duration_ms", 3).alias("duration_ms"), (F.size(issues) == 0).alias("is_valid"), F.array_join(issues, ",").alias("issues"))


def summarize_trace(spans: DataFrame, top: int = 5) -> DataFrame:
    """Per trace: spans, duration, errors, the spans of the first errors and the slowest spans. A trace's spans are ranked
    by a window that keeps ``top`` of them, so a large trace is not gathered."""
    df = spans.select("trace_id", "span_id", "name", C.ms().alias("ms"), C.epoch_ms(F.col("start_time")).alias("a"), C.epoch_ms(F.col("end_time")).alias("b"), (C.is_error() | C.error_by_text()).alias("bad"))
    whole = df.groupBy("trace_id").agg(F.count("*").alias("span_count"), F.round(F.max("b") - F.min("a"), 3).alias("duration_ms"), F.count_if("bad").alias("error_count"))

    def first(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
        kept = rows.withColumn("k", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order))).filter(F.col("k") <= top)
        return kept.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda s: s["name"]), ",").alias(name))

    slow = first(df, [F.desc("ms"), F.col("span_id")], "slowest_spans")
    bad = first(df.filter("bad"), [F.col("a"), F.col("span_id")], "error_spans")
    return whole.join(slow, "trace_id", "left").join(bad, "trace_id", "left").select("trace_id", "span_count", "duration_ms", "error_count", F.coalesce("error_spans", F.lit("")).alias("error_spans"), F.coalesce("slowest_spans", F.lit("")).alias("slowest_spans"))


def latency_statistics(spans: DataFrame, by: str = "name") -> DataFrame:
    """Count, range, mean, median, floor-index percentiles, sample deviation and variance of span durations by name, or of
    trace durations (by='trace')."""
    if by == "trace":
        df = spans.groupBy("trace_id").agg((F.max(C.epoch_ms(F.col("end_time"))) - F.min(C.epoch_ms(F.col("start_time")))).alias("ms")).withColumn("key", F.lit("trace"))
    else:
        df = spans.select(F.col("name").alias("key"), C.ms().alias("ms"))
    facts = [
        F.count("ms").alias("n"), F.round(F.min("ms"), 3).alias("min_ms"), F.round(F.max("ms"), 3).alias("max_ms"), F.round(F.avg("ms"), 3).alias("mean_ms"),
        F.round(F.coalesce(F.stddev_samp("ms"), F.lit(0.0)), 3).alias("stdev_ms"), F.round(F.coalesce(F.var_samp("ms"), F.lit(0.0)), 3).alias("variance"),
    ]
    out = percentiles(df, ["key"], "ms", {"p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99}, {"median_ms": 0.5}, facts=facts)
    return out.select("key", "n", "min_ms", "max_ms", "mean_ms", *[F.round(c, 3).alias(c) for c in ("median_ms", "p90_ms", "p95_ms", "p99_ms")], "stdev_ms", "variance")


def latency_anomalies(spans: DataFrame, sigma: float = 2.0, min_ms: float = 50) -> DataFrame:
    """Spans over min_ms whose duration is over sigma sample deviations from their name's mean."""
    df = spans.select("trace_id", "span_id", "name", C.ms().alias("ms"))
    stats = df.groupBy("name").agg(F.avg("ms").alias("mean"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("sd"))
    out = df.join(stats, "name").withColumn("z", _z_score(F.col("ms"), F.col("mean"), F.col("sd"))).filter((F.abs("z") > sigma) & (F.col("ms") > min_ms))
    return out.select("trace_id", "span_id", "name", F.round("ms", 3).alias("duration_ms"), F.round("z", 2).alias("z_score"), F.when(F.col("z") > 0, "slow").otherwise("fast").alias("anomaly_type"))


def _z_score(value: Column, mean: Column, sd: Column) -> Column:
    """Deviations from a mean; 100 or -100 where the others do not vary at all."""
    return F.when(sd > 0, (value - mean) / sd).when(value > mean, 100.0).when(value < mean, -100.0).otherwise(0.0)


def anomalies_against_baselines(spans: DataFrame, sets: DataFrame, sigma: float = 2.0, min_ms: float = 50) -> DataFrame:
    """Each target trace against its own set of baseline traces, of which it is no part. sets: (target_trace_id,
    baseline_trace_id), a row for each baseline trace of a target.

    One row for the target as a whole (level trace), anomalous or not, and one for each of its spans over min_ms (level span)
    that is over sigma sample deviations from the mean of its name in the baseline. A baseline that does not vary makes any
    difference a deviation of 100. A target without a baseline has no rows.
    """
    sets = cut(sets.filter("target_trace_id <> baseline_trace_id").distinct())
    df = cut(of_pairs(spans.select("trace_id", "span_id", "name", C.ms().alias("ms"), C.epoch_ms(F.col("start_time")).alias("a"), C.epoch_ms(F.col("end_time")).alias("b")), sets))
    whole = df.groupBy("trace_id").agg((F.max("b") - F.min("a")).alias("ms"))
    stats = lambda rows, *keys: rows.groupBy("target_trace_id", *keys).agg(F.avg("ms").alias("mean"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("sd"))
    of_baseline = lambda rows: sets.join(rows.withColumnRenamed("trace_id", "baseline_trace_id"), "baseline_trace_id")
    targets = sets.select("target_trace_id").distinct()
    of_target = lambda rows: targets.join(rows.withColumnRenamed("trace_id", "target_trace_id"), "target_trace_id")
    traces = of_target(whole).join(stats(of_baseline(whole)), "target_trace_id").select("target_trace_id", F.lit("trace").alias("level"), F.lit(None).cast("string").alias("span_id"), F.lit(None).cast("string").alias("name"), "ms", "mean", "sd")
    each = of_target(df.select("trace_id", "span_id", "name", "ms")).join(stats(of_baseline(df.select("trace_id", "name", "ms")), "name"), ["target_trace_id", "name"])
    both = traces.unionByName(each.select("target_trace_id", F.lit("span").alias("level"), "span_id", "name", "ms", "mean", "sd")).withColumn("z", _z_score(F.col("ms"), F.col("mean"), F.col("sd")))
    anomalous = F.abs("z") > sigma
    out = both.withColumn("is_anomaly", anomalous).filter((F.col("level") == "trace") | (anomalous & (F.col("ms") > min_ms)))
    return out.select(
        "target_trace_id", "level", "span_id", "name", F.round("ms", 3).alias("duration_ms"), F.round("mean", 3).alias("baseline_mean_ms"), F.round("sd", 3).alias("baseline_stdev_ms"), F.round("z", 2).alias("z_score"), "is_anomaly",
        F.when(F.col("is_anomaly"), F.when(F.col("z") > 0, "slow").otherwise("fast")).alias("anomaly_type"),
    )


#: So many traces that are asked for are looked up in every task; if they are more, spans are not moved only to leave some out.
FEW = 100_000


def of_pairs(spans: DataFrame, pairs: DataFrame, sides: tuple[str, ...] = ("baseline", "target"), exact: bool = True) -> DataFrame:
    """The spans of the traces that stand in pairs, on either side or on one. exact=False: maybe others with them, where there are more
    than FEW such traces."""
    ids = pairs.select(F.explode(F.array(*[F.col(f"{s}_trace_id") for s in sides])).alias("trace_id")).distinct()
    if exact:
        return spans.join(ids, "trace_id", "left_semi")
    return spans.join(F.broadcast(ids), "trace_id", "left_semi") if ids.limit(FEW + 1).count() <= FEW else spans


def compare_span_timings(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair of traces and span name: both means, the change, and slower, faster, same, new or missing."""
    # all names of a trace stay where the trace is dealt to, so its pairs find them there
    named = of_pairs(spans.select("trace_id", "name", C.ms().alias("ms")), pairs, exact=False)
    n = parts_of(named)
    per = named.repartition(n, "trace_id").groupBy("trace_id", "name").agg(F.avg("ms").alias("ms"))
    both = pairs.select("baseline_trace_id", "target_trace_id", F.explode(F.array(F.struct(F.col("baseline_trace_id").alias("t"), F.lit(0).alias("side")), F.struct(F.col("target_trace_id").alias("t"), F.lit(1).alias("side")))).alias("x")).select("baseline_trace_id", "target_trace_id", F.col("x.t").alias("trace_id"), "x.side")
    g = both.repartition(n, "trace_id").join(per, "trace_id").groupBy("baseline_trace_id", "target_trace_id", "name").agg(F.max(F.when(F.col("side") == 0, F.col("ms"))).alias("b"), F.max(F.when(F.col("side") == 1, F.col("ms"))).alias("t"))
    diff = F.col("t") - F.col("b")
    pct = F.coalesce(F.try_divide(diff, F.col("b")) * 100, F.lit(0.0))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("t").isNull(), "missing").when((pct > 10) | (diff > 50), "slower").when((pct < -10) | (diff < -50), "faster").otherwise("same")
    return g.select("baseline_trace_id", "target_trace_id", "name", F.round("b", 6).alias("baseline_ms"), F.round("t", 6).alias("target_ms"), F.round(diff, 6).alias("diff_ms"), F.when(diff.isNotNull(), F.round(pct, 2)).alias("diff_pct"), kind.alias("change"))


def _impact(total: Column, high: float) -> Column:
    return F.when(total > high, "high").otherwise("medium")


def n_plus_one(spans: DataFrame, min_run: int = 3, min_ms: float = 50) -> DataFrame:
    """Runs of one span name in start order within a trace."""
    w = Window.partitionBy("trace_id").orderBy("start_time", "span_id")
    df = spans.filter("start_time is not null").select("trace_id", "span_id", "name", "start_time", C.ms().alias("ms"))
    df = df.withColumn("fresh", F.when(F.col("name").eqNullSafe(F.lag("name").over(w)) & F.lag("span_id").over(w).isNotNull(), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = df.groupBy("trace_id", "run").agg(F.first("name").alias("span_name"), F.count("*").alias("count"), F.sum("ms").alias("total_ms"))
    return g.filter((F.col("count") >= min_run) & (F.col("total_ms") > min_ms)).select("trace_id", "span_name", "count", "total_ms", _impact(F.col("total_ms"), 200).alias("impact"))


def serial_chains(spans: DataFrame, max_gap_ms: float = 10, min_length: int = 3, min_ms: float = 100) -> DataFrame:
    """Spans of a trace that start within max_gap_ms after the one before ends, and are not its parent or child. A span
    without an end is passed over."""
    w = Window.partitionBy("trace_id").orderBy("start_time", "span_id")
    df = slim(spans).filter("start_time is not null and end_ms is not null")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    related = F.coalesce((F.lag("span_id").over(w) == F.col("parent_span_id")) | (F.col("span_id") == F.lag("parent_span_id").over(w)), F.lit(False))
    joined = F.coalesce(gap.between(0, max_gap_ms) & ~related, F.lit(False))
    df = df.withColumn("fresh", F.when(joined, 0).otherwise(1)).withColumn("chain", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = df.groupBy("trace_id", "chain").agg(F.count("*").alias("count"), F.sum("ms").alias("total_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "span_id", "name"))), lambda s: s["name"]), " > ").alias("span_names"))
    return g.filter((F.col("count") >= min_length) & (F.col("total_ms") > min_ms)).select("trace_id", "span_names", "count", F.round("total_ms", 2).alias("total_ms"), _impact(F.col("total_ms"), 500).alias("impact"))


def structural_differences(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair of traces: span names only one of them has, shared names, and the change in spans and depth."""
    t = shapes(of_pairs(spans.select("trace_id", "span_id", "parent_span_id", "name"), pairs, exact=False))
    b, c = (t.select(F.col("trace_id").alias(f"{k}_trace_id"), F.col("names").alias(f"{k}_names"), F.col("n").alias(f"{k}_n"), F.col("depth").alias(f"{k}_depth")) for k in ("baseline", "target"))
    j = pairs.join(b, "baseline_trace_id").join(c, "target_trace_id")
    diff = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    out = j.select(
        "baseline_trace_id", "target_trace_id", diff("baseline_names", "target_names").alias("missing_names"), diff("target_names", "baseline_names").alias("new_names"), F.size(F.array_intersect("baseline_names", "target_names")).alias("common_names"),
        (F.col("target_n") - F.col("baseline_n")).alias("span_count_change"), (F.col("target_depth") - F.col("baseline_depth")).alias("depth_change"),
    )
    return out.withColumn("structure_changed", (F.col("missing_names") != "") | (F.col("new_names") != "") | (F.col("depth_change") != 0))


def retry_storm(spans: DataFrame, threshold: int = 3) -> DataFrame:
    """Span names that repeat within a trace one after another, or that speak of retries."""
    w = Window.partitionBy("trace_id", "name").orderBy("start_ms", "span_id")
    df = slim(spans)
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    df = df.withColumn("close", F.when((gap >= 0) & (gap < 1000), 1).otherwise(0)).withColumn("drops", F.when(F.lag("ms").over(w) > 1.5 * F.col("ms"), 1).otherwise(0))
    g = df.groupBy("trace_id", "name").agg(F.count("*").alias("n"), (1 + F.sum("close")).alias("sequential"), F.sum("drops").alias("drops"), F.round(F.sum("ms"), 2).alias("total_ms"))
    named = _has(F.col("name"), RETRY_WORDS)
    out = g.filter(named | ((F.col("n") >= threshold) & (F.col("sequential") >= threshold)))
    return out.select("trace_id", F.col("name").alias("span_name"), F.col("n").alias("retry_count"), "sequential", "total_ms", ((F.col("n") >= 3) & (F.col("drops") == 0)).alias("has_exponential_backoff"), F.when(F.col("n") >= 5, "high").otherwise("medium").alias("impact"))


def connection_pool_issues(spans: DataFrame, threshold_ms: float = 100, words: list[str] = POOL_WORDS) -> DataFrame:
    """Long waits in spans that speak of connections, with their trace's total wait."""
    waited = C.ms()
    either = lambda a, b: F.coalesce(C.attr(a), C.attr(b))
    df = spans.filter(_has(F.col("name"), words) & (waited >= threshold_ms))
    total = F.sum("wait_ms").over(Window.partitionBy("trace_id"))
    out = df.select("trace_id", "span_id", F.col("name").alias("span_name"), F.round(waited, 2).alias("wait_ms"), either("pool.size", "db.pool_size").alias("pool_size"), either("pool.active", "db.active_connections").alias("active_connections"), either("pool.waiting", "db.waiting_requests").alias("waiting_requests"), F.when(waited >= 5 * threshold_ms, "high").when(waited >= 2 * threshold_ms, "medium").otherwise("low").alias("severity"))
    return out.withColumn("total_wait_ms", F.round(total, 2)).withColumn("pool_exhaustion", F.col("total_wait_ms") >= 3 * threshold_ms)


def all_patterns(spans: DataFrame, pool_words: list[str] = POOL_WORDS, with_healthy: bool = True) -> DataFrame:
    """Per trace: how many findings of each kind, and its health; those without findings only ``with_healthy``."""
    from .tree import cascading_timeout

    parts = [
        retry_storm(spans).select("trace_id", F.lit("retry_storm").alias("kind"), F.when(F.col("impact") == "high", 2).otherwise(1).alias("rank")),
        cascading_timeout(spans).select("trace_id", F.lit("cascading_timeout").alias("kind"), F.lit(3).alias("rank")),
        connection_pool_issues(spans, words=pool_words).select("trace_id", F.lit("connection_pool_issue").alias("kind"), F.when(F.col("pool_exhaustion"), 3).when(F.col("severity") == "high", 2).otherwise(1).alias("rank")),
    ]
    g = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("trace_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("retry_storm", "cascading_timeout", "connection_pool_issue")], F.max("rank").alias("rank"))
    g = g.withColumn("health", F.when(F.col("rank") == 3, "critical").when(F.col("rank") == 2, "degraded").otherwise("warning")).drop("rank")
    return spans.select("trace_id").distinct().join(g, "trace_id", "left").fillna(0).fillna("healthy", "health") if with_healthy else g


def trace_patterns(spans: DataFrame, top: int = 5) -> DataFrame:
    """Span names that are recurrently slow, intermittently slow, or vary much; the first ``top`` of each kind."""
    g = spans.groupBy(F.col("name").alias("span_name")).agg(F.count("*").alias("occurrences"), F.avg(C.ms()).alias("mean"), F.coalesce(F.stddev_samp(C.ms()), F.lit(0.0)).alias("sd")).filter("occurrences >= 2")
    cv = F.coalesce(F.try_divide(F.col("sd"), F.col("mean")), F.lit(0.0))
    g = g.withColumn("cv", cv)
    kinds = [
        ("recurring_slowdown", (F.col("mean") > 100) & (F.col("cv") < 0.3), F.col("mean") * F.col("occurrences")), ("intermittent", (F.col("cv") > 0.5) & (F.col("mean") > 50), F.col("sd")), ("high_variance", (F.col("cv") > 0.7) & (F.col("occurrences") >= 3), F.col("cv")),
    ]
    parts = [g.filter(test).select(F.lit(k).alias("pattern_type"), "span_name", "occurrences", F.round("mean", 2).alias("avg_ms"), F.round("cv", 2).alias("cv"), weight.alias("w")) for k, test, weight in kinds]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("pattern_type").orderBy(F.desc("w"), "span_name"))).filter(F.col("rank") <= top).drop("w")


def trace_trend(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of root spans, whether the later half (by start) is over 15 % slower or faster than the earlier one. Spans
    without a start are left out."""
    df = cut(C.root_spans(spans).select(*keys, "start_time", "trace_id", C.ms().alias("ms")))
    df = ranked(df, keys, "start_time", "trace_id").withColumn("early", F.col("_place") <= F.floor(F.col("_all") / 2))
    g = df.groupBy(*keys).agg(F.count("*").alias("traces"), F.avg(F.when(F.col("early"), F.col("ms"))).alias("a"), F.avg(F.when(~F.col("early"), F.col("ms"))).alias("b"))
    change = F.try_divide(F.col("b") - F.col("a"), F.col("a")) * 100
    return g.filter("traces >= 3").select(*keys, "traces", F.round(change, 2).alias("change_pct"), F.when(change > 15, "degrading").when(change < -15, "improving").otherwise("stable").alias("trend"))


def statistical_outliers(spans: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Root spans slower than the mean and sigma sample deviations of all root spans."""
    df = C.root_spans(spans).select("trace_id", C.ms().alias("duration_ms"))
    limit = df.agg((F.avg("duration_ms") + sigma * F.coalesce(F.stddev_samp("duration_ms"), F.lit(0.0))).alias("limit"))
    return df.crossJoin(F.broadcast(limit)).filter("duration_ms > limit").select("trace_id", "duration_ms")


def select_traces(spans: DataFrame, ids: DataFrame) -> DataFrame:
    """The spans of the traces in ``ids`` (trace_id)."""
    return spans.join(ids.select("trace_id"), "trace_id", "left_semi")


def example_traces(spans: DataFrame) -> DataFrame:
    """Per service: its most anomalous root span, and as baseline the median of the same operation's traces under 0.8 of
    it, else the error-free one nearest to the median."""
    df = cut(C.root_spans(spans).select("trace_id", C.service().alias("service_name"), "name", C.ms().alias("ms"), C.is_error().alias("is_error")))
    facts = [F.count("*").alias("n"), F.avg("ms").alias("mean"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("sd")]
    stats = percentiles(df, ["service_name"], "ms", continuous={"p50": 0.5}, facts=facts)
    z = F.when(F.col("sd") > 0, F.greatest(F.lit(0.0), (F.col("ms") - F.col("mean")) / F.col("sd"))).when(F.col("ms") > F.col("mean"), 3.0).otherwise(0.0)
    scored = df.join(stats, "service_name").withColumn("score", z + F.when(F.col("is_error"), 5).otherwise(0) + F.when(F.col("ms") > 3 * F.col("mean"), 2).otherwise(0))
    worst = scored.groupBy("service_name").agg(F.min(F.struct((-F.col("score")).alias("x"), "trace_id", "name", "ms", "score")).alias("a"), F.min(F.when(~F.col("is_error"), F.struct(F.abs(F.col("ms") - F.col("p50")).alias("x"), "trace_id", "ms"))).alias("near"), F.first("n").alias("n"))
    same = df.join(worst.select("service_name", F.col("a.name").alias("name"), F.col("a.ms").alias("top_ms")), ["service_name", "name"]).filter(F.col("ms") < 0.8 * F.col("top_ms"))
    same = cut(same.select("service_name", "trace_id", "ms"))
    middle = ranked(same, ["service_name"], "ms", "trace_id").filter(F.col("_place") - 1 == F.floor(F.col("_all") / 2)).select("service_name", F.col("trace_id").alias("mid_id"), F.col("ms").alias("mid_ms"))
    return worst.join(middle, "service_name", "left").select(
        "service_name", F.col("n").alias("traces"), F.col("a.trace_id").alias("anomaly_trace_id"), F.round("a.score", 3).alias("anomaly_score"), F.round("a.ms", 3).alias("anomaly_ms"),
        F.coalesce("mid_id", F.col("near.trace_id")).alias("baseline_trace_id"), F.round(F.coalesce("mid_ms", F.col("near.ms")), 3).alias("baseline_ms"),
    )


def example_trace_report(spans: DataFrame, adequate: int = 20) -> DataFrame:
    """example_traces with each service's statistics and whether its sample can be trusted."""
    df = C.root_spans(spans).select(C.service().alias("service_name"), C.ms().alias("ms"), C.is_error().alias("bad")).filter("ms > 0")
    stats = df.groupBy("service_name").agg(
        F.count("*").alias("count"), F.round(quantile(F.col("ms"), 0.5), 2).alias("p50_ms"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.round(F.coalesce(F.stddev_samp("ms"), F.lit(0.0)), 2).alias("stdev_ms"), F.count_if("bad").alias("error_traces")
    )
    j = example_traces(spans).join(stats, "service_name", "left")
    return j.withColumns({"baseline_valid": F.col("baseline_trace_id").isNotNull(), "anomaly_valid": F.col("anomaly_trace_id").isNotNull(), "sample_adequate": F.coalesce(F.col("count") >= adequate, F.lit(False)), "latency_variance_detected": F.coalesce(F.col("stdev_ms") > 0, F.lit(False))})
