"""Metric series, golden signals and service level objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.groups import small
from ..functions.quantiles import percentiles


def series_stats(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count, range, mean, median, deviation and floor-index percentiles of each series."""
    facts = [F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("stdev")]
    out = percentiles(points.select(*keys, "value"), keys, "value", {"p90": 0.9, "p95": 0.95, "p99": 0.99}, {"median": 0.5}, facts=facts)
    return out.withColumn("median", F.round("median", 8))


def metric_anomalies(points: DataFrame, keys: list[str], sigma: float = 3.0) -> DataFrame:
    """Points over sigma sample deviations from their series' mean."""
    stats = points.groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")).filter("sd > 0")
    z = (F.col("value") - F.col("m")) / F.col("sd")
    return points.join(stats, keys).withColumn("z", z).filter(F.abs("z") > sigma).select(*keys, "ts", "value", F.round("z", 2).alias("z_score"), F.when(F.col("z") > 0, "high").otherwise("low").alias("anomaly_type"))


def compare_metric_windows(points: DataFrame, keys: list[str], is_target: Column, significant_pct: float = 10) -> DataFrame:
    """Per series the shift of the mean from the other points to the target ones."""
    g = points.groupBy(*keys).agg(F.avg(F.when(~is_target, F.col("value"))).alias("b"), F.avg(F.when(is_target, F.col("value"))).alias("t"))
    shift = F.col("t") - F.col("b")
    pct = F.when(F.col("b") == 0, F.when(shift > 0, 100.0).otherwise(0.0)).otherwise(F.try_divide(shift, F.col("b")) * 100)
    return g.select(*keys, F.round("b", 4).alias("baseline_mean"), F.round("t", 4).alias("target_mean"), F.round(shift, 4).alias("mean_shift"), F.round(pct, 2).alias("pct_change"), (F.abs(pct) > significant_pct).alias("is_significant"))


def _grade(value: Column, warning: float, critical: float) -> Column:
    return F.when(value.isNull(), "NO_DATA").when(value > critical, "CRITICAL").when(value > warning, "WARNING").otherwise("GOOD")


def _overall(*grades: str) -> Column:
    any_of = lambda what: F.array_contains(F.array(*[F.col(g) for g in grades]), what)
    return F.when(any_of("CRITICAL"), "CRITICAL").when(any_of("WARNING"), "WARNING").when(any_of("GOOD"), "HEALTHY").otherwise("UNKNOWN")


def golden_signals(points: DataFrame, signals: DataFrame, service: Column) -> DataFrame:
    """Latency (ms), traffic, errors (%) and saturation (%) of each service from metric points. signals: a small table
    (signal, metric_type, rank); of a signal's metric types the first that has data for the service counts."""
    df = points.select(service.alias("service_name"), "metric_type", "value").join(small(signals), "metric_type")
    per = df.groupBy("service_name", "signal", "rank").agg(F.avg("value").alias("value"))
    first = per.groupBy("service_name", "signal").agg(F.min_by("value", "rank").alias("value"))
    wide = first.groupBy("service_name").pivot("signal", ["latency", "traffic", "errors", "saturation"]).agg(F.first("value"))
    out = wide.select("service_name", F.round("latency", 2).alias("latency_ms"), F.round("traffic", 2).alias("traffic"), F.round("errors", 3).alias("error_pct"), F.round("saturation", 2).alias("saturation_pct"), _grade(F.col("latency"), 200, 500).alias("latency_status"), _grade(F.col("errors"), 0.1, 1).alias("error_status"), _grade(F.col("saturation"), 70, 85).alias("saturation_status"))
    return out.withColumn("overall_status", _overall("latency_status", "error_status", "saturation_status"))


def golden_signals_from_spans(spans: DataFrame, hours: float) -> DataFrame:
    """Latency, traffic and errors of each service from its spans over a period of ``hours``."""
    g = spans.groupBy(C.service().alias("service_name")).agg(F.avg(C.ms()).alias("l"), F.count("*").alias("n"), (F.count_if(C.is_error()) / F.count("*") * 100).alias("e"))
    out = g.select("service_name", F.round("l", 2).alias("latency_ms"), F.round(F.col("n") / (hours * 3600), 6).alias("traffic_rps"), F.round("e", 3).alias("error_pct"), _grade(F.col("l"), 200, 500).alias("latency_status"), _grade(F.col("e"), 0.1, 1).alias("error_status"))
    return out.withColumn("overall_status", _overall("latency_status", "error_status"))


def _bucket(ts: str, seconds: int) -> Column:
    return F.expr(f"cast(timestamp_micros(unix_micros(cast({ts} as timestamp)) div {seconds * 1_000_000} * {seconds * 1_000_000}) as timestamp_ntz)")


def with_previous(points: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts",), chunk_seconds: int = 86_400) -> DataFrame:
    """Points with the time (old_ts) and value (old_value) of the point before in their series.

    A series is cut into chunks of time, each ordered by itself, so a series with most of the points is spread over tasks; the
    last point of a chunk is handed on to the next one of its series.
    """
    cols = list(points.columns)
    cut_up = points.withColumn("_chunk", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (chunk_seconds * 1_000_000))).withColumn("_handed", F.lit(False))
    last = cut_up.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*[c for c in cols if c not in keys]), F.struct(*order)).alias("_p"))
    after = F.lead("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
    handed = last.withColumn("_chunk", after).filter("_chunk is not null").select(*[F.col(c) if c in keys else F.col(f"_p.{c}").alias(c) for c in cols], "_chunk", F.lit(True).alias("_handed"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_handed"), *order)
    out = cut_up.unionByName(handed).withColumn("old_ts", F.lag("ts").over(w)).withColumn("old_value", F.lag("value").over(w))
    return out.filter(~F.col("_handed")).drop("_chunk", "_handed")


def _grown() -> Column:
    """How much a counter grew since the point before; a fall is a restart and counts from zero."""
    return F.when(F.col("old_value").isNull(), 0.0).when(F.col("value") < F.col("old_value"), F.col("value")).otherwise(F.col("value") - F.col("old_value"))


def counter_rate(points: DataFrame, keys: list[str], step_seconds: int = 3600, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Increase and per-second rate of counters in each step; a fall is a restart and counts from zero."""
    g = with_previous(points, keys, order).withColumn("grown", _grown()).groupBy(*keys, _bucket("ts", step_seconds).alias("step")).agg(F.sum("grown").alias("increase"))
    return g.withColumn("rate", F.round(F.col("increase") / step_seconds, 8))


def _cell(ts: str, seconds: int) -> Column:
    """Number of the first grid point at or after a time."""
    return F.ceil(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def _grid(cell: Column, seconds: int) -> Column:
    return F.timestamp_seconds(cell * seconds).cast("timestamp_ntz")


def _cells_of(window_seconds: int, step_seconds: int) -> int:
    if step_seconds <= 0 or window_seconds <= 0 or window_seconds % step_seconds:
        raise ValueError("the window must be a multiple of the step")
    return window_seconds // step_seconds


def range_rates(points: DataFrame, keys: list[str], step_seconds: int, window_seconds: int, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(keys, at, increase, rate): at every step the growth of counters between the points of the last ``window_seconds`` (its
    later end included, its earlier one not), per second of the window. Restarts count from zero. A window with one point of a series has no row.

    The growth from one point to the next counts in each window that holds both. It is summed by the grid cells of the two
    points first, so at most a few rows of a cell go to the windows they lie in, however many points there are.
    """
    n = _cells_of(window_seconds, step_seconds)
    steps = with_previous(points, keys, order, max(86_400, window_seconds)).filter("old_ts is not null")
    sums = steps.groupBy(*keys, _cell("old_ts", step_seconds).alias("_a"), _cell("ts", step_seconds).alias("_b")).agg(F.sum(_grown()).alias("grown"))
    inside = sums.filter(F.col("_b") <= F.col("_a") + (n - 1)).withColumn("_at", F.explode(F.sequence("_b", F.col("_a") + (n - 1))))
    g = inside.groupBy(*keys, "_at").agg(F.sum("grown").alias("increase"))
    return g.select(*keys, _grid(F.col("_at"), step_seconds).alias("at"), "increase", F.round(F.col("increase") / window_seconds, 8).alias("rate"))


def range_gauges(points: DataFrame, keys: list[str], step_seconds: int, window_seconds: int) -> DataFrame:
    """(keys, at, avg, min, max, last, n): at every step what gauges did in the last ``window_seconds``."""
    n = _cells_of(window_seconds, step_seconds)
    cells = points.groupBy(*keys, _cell("ts", step_seconds).alias("_cell")).agg(F.sum("value").alias("s"), F.count("value").alias("c"), F.min("value").alias("a"), F.max("value").alias("b"), F.max(F.struct("ts", "value")).alias("l"))
    g = cells.withColumn("_at", F.explode(F.sequence("_cell", F.col("_cell") + (n - 1)))).groupBy(*keys, "_at").agg(
        F.sum("s").alias("s"), F.sum("c").alias("n"), F.min("a").alias("min"), F.max("b").alias("max"), F.max("l").alias("l")
    )
    return g.select(*keys, _grid(F.col("_at"), step_seconds).alias("at"), F.round(F.try_divide(F.col("s"), F.col("n")), 8).alias("avg"), "min", "max", F.col("l.value").alias("last"), "n")


def sum_by(rates: DataFrame, by: list[str], value: str = "rate") -> DataFrame:
    """(by, at, value, series): the values of all series with the same labels, summed at every step."""
    return rates.groupBy(*by, "at").agg(F.round(F.sum(value), 8).alias(value), F.count(value).alias("series"))


def range_quantiles(buckets: DataFrame, keys: list[str], by: list[str], q: float, step_seconds: int, window_seconds: int, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(by, at, quantile): at every step the quantile of a histogram whose buckets are counters. buckets: (keys, le, ts, value), the
    value counting what was at or under le; rates are taken per series and then summed by label."""
    rates = range_rates(buckets, [*keys, "le"], step_seconds, window_seconds, order)
    counts = rates.groupBy(*by, "at", "le").agg(F.sum("increase").alias("count"))
    return histogram_quantile(counts, [*by, "at"], q)


def histogram_buckets(points: DataFrame, keys: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative counts of values at or under each bound, the last without bound."""
    g = points.groupBy(*keys).agg(*[F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("*").alias("inf"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("count")))
    return g.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.le", "b.count")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The quantile by linear interpolation in the first cumulative bucket that reaches it; beyond the last bound, that bound."""
    w = Window.partitionBy(*keys).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*keys))
    df = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("count").over(w), F.lit(0))).withColumn("want", q * total)
    first = df.filter("count >= want and want > 0").groupBy(*keys).agg(F.min_by(F.struct("le", "low", "below", "count", "want"), "le").alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * F.try_divide(F.col("b.want") - F.col("b.below"), F.col("b.count") - F.col("b.below"))
    return first.select(*keys, F.round(F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(F.coalesce(inside, F.col("b.low"))), 6).alias("quantile"))


def gauge_latest(points: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts",)) -> DataFrame:
    return points.groupBy(*keys).agg(F.max_by("value", F.struct(*order)).alias("latest"), F.max("ts").alias("at"))


def gauge_over_window(points: DataFrame, keys: list[str], as_of: str, minutes: float) -> DataFrame:
    """Mean, range and number of the points of the last minutes before (and at) as_of."""
    g = C.time_window(points, minutes / 60, as_of, "ts").groupBy(*keys)
    return g.agg(F.round(F.avg("value"), 8).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def range_query_step(points: DataFrame, keys: list[str], step_seconds: int = 60) -> DataFrame:
    """Gauges on a grid of steps: mean, greatest, last."""
    return points.groupBy(*keys, _bucket("ts", step_seconds).alias("step")).agg(F.round(F.avg("value"), 8).alias("avg"), F.max("value").alias("max"), F.max_by("value", F.struct("ts", "value")).alias("last"), F.count("*").alias("n"))


def slo_status(slos: DataFrame) -> DataFrame:
    """Objectives with their goal and error budget in percent. slos: name, goal, rolling_days."""
    return slos.select("name", F.round(F.col("goal") * 100, 4).alias("goal_pct"), F.round((1 - F.col("goal")) * 100, 4).alias("error_budget_pct"), F.coalesce("rolling_days", F.lit(30)).alias("rolling_days"))


def slo_compliance(spans: DataFrame, slos: DataFrame, as_of: str) -> DataFrame:
    """Good share of a service's spans over its objective's rolling period. slos: service_name, goal, rolling_days; small."""
    df = spans.select(C.service().alias("service_name"), "start_time", C.is_error().alias("bad")).join(small(slos), "service_name")
    at = F.lit(as_of).cast("timestamp_ntz")
    inside = (F.col("start_time") <= at) & (F.col("start_time") >= at - F.make_dt_interval(F.coalesce("rolling_days", F.lit(30))))
    g = df.filter(inside).groupBy("service_name", "goal").agg(F.count("*").alias("total"), F.count_if(~F.col("bad")).alias("good"))
    ratio = F.col("good") / F.col("total")
    return g.select("service_name", "goal", "total", "good", F.round(ratio, 6).alias("good_ratio"), (ratio >= F.col("goal")).alias("is_met"), F.round(F.try_divide(1 - ratio, 1 - F.col("goal")) * 100, 2).alias("budget_used_pct"))


def error_budget_burn(points: DataFrame, keys: list[str], hours: float) -> DataFrame:
    """How fast a remaining budget falls over a period of ``hours`` and how long it lasts. points: ts, value (remaining)."""
    g = points.groupBy(*keys).agg(F.min_by("value", "ts").alias("oldest"), F.max_by("value", "ts").alias("newest"), F.count("*").alias("points"))
    rate = (F.col("oldest") - F.col("newest")) / hours
    left = F.when(rate > 0, F.when(F.col("newest") <= 0, 0.0).otherwise(F.col("newest") / rate))
    urgency = F.when(F.col("points") < 2, "UNKNOWN").when(~(rate > 0), "HEALTHY").when(left < 24, "CRITICAL").when(left < 72, "HIGH").when(left < 168, "MEDIUM").otherwise("LOW")
    return g.select(*keys, "points", "oldest", "newest", F.round(rate, 6).alias("burn_rate_per_hour"), F.round(left, 1).alias("hours_to_exhaustion"), urgency.alias("urgency"))


def predict_slo_violation(burn: DataFrame, keys: list[str], horizon_hours: float = 24) -> DataFrame:
    left = F.col("hours_to_exhaustion")
    will = F.coalesce(left <= horizon_hours, F.lit(False))
    return burn.select(*keys, left, will.alias("will_violate"), F.when(will & (left >= horizon_hours / 2), "MEDIUM").otherwise("HIGH").alias("confidence"), F.when(~will & left.isNotNull(), F.round(left - horizon_hours, 1)).alias("buffer_hours"))


def incident_slo_impact(incidents: DataFrame, slos: DataFrame) -> DataFrame:
    """How much of an objective's budget an incident took. incidents: service_name, duration_minutes; slos: small."""
    j = incidents.join(small(slos), "service_name")
    budget = F.coalesce("rolling_days", F.lit(30)) * 1440 * (1 - F.col("goal"))
    used = F.try_divide(F.col("duration_minutes"), budget) * 100
    return j.withColumn("budget_minutes", F.round(budget, 4)).withColumn("budget_used_pct", F.round(used, 2)).withColumn("impact", F.when(used >= 50, "CRITICAL").when(used >= 20, "HIGH").when(used >= 5, "MEDIUM").otherwise("LOW"))
