"""Rollups: a small table of mergeable parts for each service and bucket of time, from which any window is answered.

A bucket keeps counts, sums, extremes and two sketches: of its durations (quantiles) and of its trace ids (distinct values).
Sketches of buckets merge into the sketch of the window, so spans are read once, when their bucket is written, and
a question about months reads one row for each service and hour.

Windows begin and end at edges of buckets; other windows are refused. Counts, sums and rates are exact. A percentile is off by
less than RANK_ERROR of the window's rows in rank; distinct traces are within some per cent.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Size of the quantile sketches, and by which share of its rows a merged one may be off in rank (at 99 % confidence).
SKETCH_K, RANK_ERROR = 1600, 0.005


def _bucket(ts: Column, hours: int) -> Column:
    size = hours * 3_600_000_000
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(size))).cast("timestamp_ntz")


def rollup(spans: DataFrame, bucket_hours: int = 1, keys: dict[str, Column] | None = None, roots_only: bool = True) -> DataFrame:
    """(keys, bucket, requests, errors, sum_ms, min_ms, max_ms, latency, traces): one row for each group and bucket.
    keys: columns by name, the service by default. Spans without a start are left out, null durations in the sketch only."""
    keys = keys or {"service_name": C.service()}
    df = (C.root_spans(spans) if roots_only else spans).filter("start_time is not null")
    df = df.select(*[c.alias(n) for n, c in keys.items()], _bucket(F.col("start_time"), bucket_hours).alias("bucket"), C.ms().cast("double").alias("ms"), C.is_error().alias("bad"), "trace_id")
    return df.groupBy(*keys, "bucket").agg(
        F.count("*").alias("requests"), F.count_if("bad").alias("errors"), F.sum("ms").alias("sum_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
        F.kll_sketch_agg_double("ms", SKETCH_K).alias("latency"), F.hll_sketch_agg("trace_id").alias("traces"),
    )


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of groups put together; parts may be rows of a rollup or what merge gave before."""
    return parts.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("sum_ms").alias("sum_ms"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("latency").alias("latency"), F.hll_union_agg("traces").alias("traces"),
    )


def percentile(p: float) -> Column:
    """The share p of the durations that a row's sketch stands for; null without durations."""
    return F.when(F.kll_sketch_get_n_double("latency") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(p)))


def window(parts: DataFrame, as_of: str, hours: float, bucket_hours: int = 1, until_hours: float = 0) -> DataFrame:
    """The buckets from ``hours`` to ``until_hours`` before as_of, both of which must be edges of buckets."""
    at = dt.datetime.fromisoformat(as_of)
    edges = [at - dt.timedelta(hours=h) for h in (hours, until_hours)]
    size = dt.timedelta(hours=bucket_hours)
    if any((e - dt.datetime(1970, 1, 1)) % size for e in edges):
        raise ValueError("a window of a rollup begins and ends at edges of buckets")
    first, last = (F.lit(e.isoformat(sep=" ")).cast("timestamp_ntz") for e in edges)
    return parts.filter((F.col("bucket") >= first) & (F.col("bucket") < last))


def metrics(parts: DataFrame, as_of: str, hours: float, keys: tuple[str, ...] = ("service_name",), bucket_hours: int = 1) -> DataFrame:
    """Requests, errors, latency and distinct traces of each group in a window; worst first."""
    g = merge(window(parts, as_of, hours, bucket_hours), list(keys))
    picks = [F.round(percentile(p), 2).alias(n) for n, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))]
    out = g.select(*keys, F.col("requests").alias("request_count"), F.col("errors").alias("error_count"), _rate(), *picks, F.round(F.try_divide("sum_ms", "requests"), 2).alias("avg_ms"), "min_ms", "max_ms", F.hll_sketch_estimate("traces").alias("traces_estimate"))
    return out.orderBy(F.desc("error_rate_pct"), *keys)


def _rate() -> Column:
    return F.round(F.col("errors") / F.col("requests") * 100, 2).alias("error_rate_pct")


def compare_periods(parts: DataFrame, as_of: str, baseline: tuple[float, float], anomaly: tuple[float, float], bucket_hours: int = 1) -> DataFrame:
    """Two windows (hours before as_of, from and until) by service and period, with the change from baseline to anomaly on the
    anomaly row."""
    both = [window(parts, as_of, p[0], bucket_hours, p[1]).withColumns({"period": F.lit(n), "step": F.lit(k)}) for k, (n, p) in enumerate((("baseline", baseline), ("anomaly", anomaly)))]
    out = merge(both[0].unionByName(both[1]), ["service_name", "period", "step"]).select("service_name", "period", "step", F.col("requests").alias("request_count"), F.col("errors").alias("error_count"), _rate(), F.round(percentile(0.95), 2).alias("p95_ms"))
    w = Window.partitionBy("service_name").orderBy("step")
    old, rate = F.lag("p95_ms").over(w), F.lag("error_rate_pct").over(w)
    return out.select(
        "service_name", "period", "request_count", "error_count", "error_rate_pct", "p95_ms", F.round(F.col("p95_ms") - old, 2).alias("p95_delta_ms"),
        F.round(F.try_divide(F.col("p95_ms") - old, old) * 100, 1).alias("p95_change_pct"), F.round(F.col("error_rate_pct") - rate, 2).alias("error_rate_delta"),
    )


def trend_changes(parts: DataFrame, as_of: str, hours: float, metric: str = "p95", rollup_hours: int = 1, bucket_hours: int = 1, min_samples: int = 10, by_service: bool = False) -> DataFrame:
    """Buckets of ``bucket_hours`` (a multiple of the rollup's) with at least min_samples, their three-bucket moving average and
    the change since the last one. metric: p95, p99, error_rate or throughput."""
    if bucket_hours % rollup_hours:
        raise ValueError("buckets are put together from whole buckets of the rollup")
    keys = ["service_name"] if by_service else []
    wide = window(parts, as_of, hours, rollup_hours).withColumn("bucket", _bucket(F.col("bucket"), bucket_hours))
    value = {"p95": percentile(0.95), "p99": percentile(0.99), "error_rate": F.col("errors") / F.col("requests") * 100, "throughput": F.col("requests").cast("double")}[metric]
    out = merge(wide, [*keys, "bucket"]).select(*keys, "bucket", F.col("requests").alias("sample_count"), F.round(value, 2).alias("value")).filter(F.col("sample_count") >= min_samples)
    w = Window.partitionBy(*keys).orderBy("bucket")
    old = F.lag("value").over(w)
    change = F.try_divide(F.col("value") - old, old) * 100
    size_of = F.abs(change)
    return out.select(
        *keys, "bucket", "sample_count", "value", F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving_avg"), F.round(F.col("value") - old, 2).alias("delta"),
        F.round(change, 1).alias("pct_change"), F.when(size_of >= 20, "SIGNIFICANT").when(size_of >= 10, "MODERATE").otherwise("STABLE").alias("change_class"),
    )


def slo_compliance(parts: DataFrame, slos: DataFrame, as_of: str, bucket_hours: int = 1) -> DataFrame:
    """Good share of a service's requests over its objective's rolling period, from the rollup. slos: service_name, goal,
    rolling_days (30 where null). A rollup of all spans answers for all spans."""
    at = F.lit(as_of).cast("timestamp_ntz")
    if (dt.datetime.fromisoformat(as_of) - dt.datetime(1970, 1, 1)) % dt.timedelta(hours=bucket_hours):
        raise ValueError("a window of a rollup begins and ends at edges of buckets")
    inside = (F.col("bucket") < at) & (F.col("bucket") >= at - F.make_dt_interval(F.coalesce("rolling_days", F.lit(30))))
    g = parts.select("service_name", "bucket", "requests", "errors").join(slos, "service_name").filter(inside).groupBy("service_name", "goal").agg(F.sum("requests").alias("total"), F.sum(F.col("requests") - F.col("errors")).alias("good"))
    ratio = F.col("good") / F.col("total")
    return g.select("service_name", "goal", "total", "good", F.round(ratio, 6).alias("good_ratio"), (ratio >= F.col("goal")).alias("is_met"), F.round(F.try_divide(1 - ratio, 1 - F.col("goal")) * 100, 2).alias("budget_used_pct"))
