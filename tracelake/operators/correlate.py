"""Joins across spans, logs, metrics and changes. Time ranges are joined by buckets, so they are hash joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import cut
from ..functions.quantiles import summarise

#: Log severities that count as trouble.
TROUBLE = ["ERROR", "ERROR2", "ERROR3", "ERROR4", "FATAL", "WARN", "WARNING", "CRITICAL"]
#: Of a metric in one stretch of time: so many points a task holds at most, and so many ranges it answers at once. Where there are
#: more points, they meet their ranges as rows.
HELD, ASKED = 1_000_000, 250_000
#: A stretch of time is this many times as long as the shortest ranges asked for in it.
STRETCH = 16


def _seconds(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp")) / 1_000_000


def range_join(points: DataFrame, point_ts: str, ranges: DataFrame, start: str, end: str, keys: list[str], bucket_seconds: int) -> DataFrame:
    """points ⋈ ranges on keys with start <= point_ts <= end, as a hash join. Start, end and point_ts are timestamp columns.

    A range goes to buckets about as long as itself (bucket_seconds, doubled until they are), so to two of them at most, however
    long it is. A point goes to its bucket of each length that ranges have: one where they are alike, a few dozen if some
    last milliseconds and others years. A range whose end is before its start, or unknown, meets nothing.
    """
    long = _seconds(F.col(end)) - _seconds(F.col(start))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(long, F.lit(1e-6)) / bucket_seconds))).cast("int")
    known = ranges.filter(F.col(start) <= F.col(end)).withColumn("_level", level)
    levels = sorted(r[0] for r in known.select("_level").distinct().collect())
    bucket = lambda c: F.floor(_seconds(F.col(c)) / (bucket_seconds * F.pow(F.lit(2.0), F.col("_level"))))
    spread = known.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    dealt = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bucket", bucket(point_ts))
    return dealt.join(spread, [*keys, "_level", "_bucket"]).filter((F.col(point_ts) >= F.col(start)) & (F.col(point_ts) <= F.col(end))).drop("_level", "_bucket")


def _shift(col: Column, seconds: float) -> Column:
    return col + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def first_nearby(logs: DataFrame, ranges: DataFrame, carried: list[str], n: int) -> DataFrame:
    """Of each trace the first ``n`` logs, by timestamp and insert_id, within its ranges (trace_id, service_name, from, to and the
    carried columns) and of their service, without the trace's own: the logs' columns, trace_id and the carried columns.
    logs: timestamp, service_name, insert_id, log_trace and further columns.

    Logs are numbered in order of time in each service, and a range is told where its logs begin. So it meets the blocks of
    numbers that hold its first n logs (and its own among them), not all logs around it; rows grow with the input, whatever
    the number of logs in a range.
    """
    logs = logs.filter("service_name is not null and timestamp is not null")
    ranges = ranges.filter((F.col("from") <= F.col("to")) & F.col("service_name").isNotNull())
    ranges = ranges.withColumn("_several", F.count("*").over(Window.partitionBy("trace_id")) > 1)
    facts = [c for c in logs.columns if c not in ("service_name", "timestamp", "insert_id")]
    point = logs.select("service_name", F.col("timestamp").alias("_at"), F.lit(1).alias("_point"), "insert_id", F.struct(*facts).alias("_log"))
    mark = ranges.select("service_name", F.col("from").alias("_at"), F.lit(0).alias("_point"), F.struct("trace_id", "to", "_several", *carried).alias("_range"))
    # a range comes before the logs of its first moment; rows are dealt by range, so no service is put in order by one task
    order = ["_at", "_point", "insert_id"]
    dealt = cut(point.unionByName(mark, allowMissingColumns=True).repartitionByRange("service_name", *order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    sums = dealt.groupBy("service_name", "_part").agg(F.sum("_point").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("service_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("service_name", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_point").over(Window.partitionBy("service_name", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = cut(dealt.withColumn("_inside", inside).join(starts, ["service_name", "_part"]).withColumn("_place", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside"))
    at = placed.filter("_point = 1").select("service_name", F.col("_at").alias("timestamp"), "insert_id", "_place", "_log.*")
    asked = placed.filter("_point = 0").select("_id", "service_name", F.col("_place").alias("_from"), "_range.*")
    # of its own logs those that stand before the n-th other one are further numbers to look at
    own = asked.select("_id", "trace_id", "service_name", "_from").join(at.select(F.col("log_trace").alias("trace_id"), "service_name", "_place"), ["trace_id", "service_name"]).filter("_place > _from")
    others = F.col("_place") - F.col("_from") - F.row_number().over(Window.partitionBy("_id").orderBy("_place"))
    more = own.select("_id", others.alias("_others")).filter(F.col("_others") < n).groupBy("_id").agg(F.count("*").alias("_own"))
    last = F.col("_from") + n + F.coalesce("_own", F.lit(0))
    asked = asked.join(more, "_id", "left").withColumn("_last", last).drop("_own", "_id")
    block = lambda c: F.floor((c - 1) / F.lit(n))
    kept = [c for c in at.columns if c not in ("service_name", "_place")]
    blocks = at.groupBy("service_name", block(F.col("_place")).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_place", *kept))).alias("_logs"))
    asked = asked.withColumn("_block", F.explode(F.sequence(block(F.col("_from") + 1), block(F.col("_last")))))
    skip = F.greatest(F.lit(0), F.col("_from") - F.col("_block") * n).cast("int")
    part = F.slice("_logs", skip + 1, F.least(F.lit(n), F.col("_last") - F.col("_block") * n).cast("int") - skip)
    met = asked.join(blocks, ["service_name", "_block"]).select("service_name", "trace_id", "to", "_several", *carried, F.inline(part)).drop("_place")
    met = met.filter((F.col("timestamp") <= F.col("to")) & (F.col("log_trace").isNull() | (F.col("log_trace") != F.col("trace_id")))).drop("to")
    # a trace of one range has its first n; one of several has them among the first n of each
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy("timestamp", "insert_id"))
    merged = met.filter("_several").withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return met.filter("not _several").unionByName(merged).drop("_several")


def logs_for_trace(logs: DataFrame, ids: DataFrame) -> DataFrame:
    return logs.join(ids.select("trace_id"), "trace_id", "left_semi")


def logs_for_traces_direct_and_nearby(spans: DataFrame, logs: DataFrame, log_service: Column, window_seconds: float = 30, per_trace: int = 20) -> DataFrame:
    """Per trace its own logs (direct), and troubled logs of its root's service around the root span (nearby)."""
    roots = C.root_spans(spans).select("trace_id", C.service().alias("service_name"), F.col("start_time"), F.col("end_time"))
    slim = logs.select("insert_id", "timestamp", F.col("severity_text").alias("severity"), log_service.alias("service_name"), F.col("trace_id").alias("log_trace"))
    direct = slim.join(roots.select("trace_id"), F.col("log_trace") == F.col("trace_id")).select("trace_id", "insert_id", "timestamp", "severity", F.lit("direct").alias("correlation"))
    ranges = roots.select("trace_id", "service_name", _shift(F.col("start_time"), -window_seconds).alias("from"), _shift(F.col("end_time"), window_seconds).alias("to"))
    troubled, lost = slim.filter(F.col("severity").isin(TROUBLE)), ranges.filter("trace_id is null")
    near = first_nearby(troubled, ranges.filter("trace_id is not null"), [], per_trace)
    if not lost.isEmpty():  # a root without a trace id: logs that have one cannot be told from its own
        near = near.unionByName(first_nearby(troubled.filter("log_trace is null"), lost, [], per_trace))
    nearby = near.select("trace_id", "insert_id", "timestamp", "severity", F.lit("nearby").alias("correlation"))
    return direct.unionByName(nearby)


def trace_context(spans: DataFrame) -> DataFrame:
    """Per trace: its time, services, hosts, spans, errors and five slowest spans."""
    df = spans.select("trace_id", "span_id", "start_time", "end_time", C.service().alias("service_name"), F.col("resource.attributes")["host.name"].alias("host_name"), C.ms().alias("ms"), C.is_error().alias("bad"))
    # names of services and hosts in a trace are few; its spans are ranked instead of gathered
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    g = df.groupBy("trace_id").agg(F.min("start_time").alias("started"), F.max("end_time").alias("ended"), names("service_name").alias("services"), names("host_name").alias("hosts"), F.count("*").alias("span_count"), F.count_if("bad").alias("error_count"))
    k = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("ms"), "span_id"))
    slow = df.select("trace_id", "span_id", k.alias("k")).filter("k <= 5").groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "span_id"))), lambda s: s["span_id"]), ",").alias("slowest_span_ids"))
    return g.join(slow, "trace_id").select("trace_id", "started", "ended", F.round(C.epoch_ms(F.col("ended")) - C.epoch_ms(F.col("started")), 3).alias("total_ms"), "services", "hosts", "span_count", "error_count", "slowest_span_ids")


def _sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of x[lo:hi] for each range, put together from sums of 1, 2, 4 ... neighbours, so nothing outside a range goes into its sum.
    Long doubles keep the noise of a sum out of roundings."""
    x, out, lo, hi = x.astype(np.longdouble), np.zeros(len(lo), dtype=np.longdouble), lo.copy(), hi.copy()
    while (lo < hi).any():
        odd = np.flatnonzero((lo < hi) & (lo % 2 == 1))
        out[odd] += x[lo[odd]]
        lo[odd] += 1
        odd = np.flatnonzero((lo < hi) & (hi % 2 == 1))
        hi[odd] -= 1
        out[odd] += x[hi[odd]]
        lo, hi = lo // 2, hi // 2
        x = np.append(x, np.zeros(len(x) % 2, dtype=x.dtype)).reshape(-1, 2).sum(axis=1)
    return out.astype(np.float64)


def _smallest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of places (from 0) the value at that place in the order of x[lo:hi]: NaN where the range is empty. Ranks are told
    bit by bit, the highest first; after each bit those without it come first (a wavelet matrix)."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), dtype=np.int64)
    rank[order] = np.arange(len(x))
    asked = [(lo, hi, k, np.zeros(len(lo), dtype=np.int64)) for k in places]
    for bit in reversed(range(max(1, len(x)).bit_length())):
        has = (rank >> bit & 1).astype(bool)
        without = np.append(0, np.cumsum(~has))
        for i, (a, b, k, found) in enumerate(asked):
            low, high = without[a], without[b]
            up = k >= high - low
            asked[i] = (np.where(up, without[-1] + a - low, low), np.where(up, without[-1] + b - high, high), np.where(up, k - (high - low), k), found | up.astype(np.int64) << bit)
        rank = np.concatenate([rank[~has], rank[has]])
    values = np.append(x[order], np.nan)
    return [values[np.where(hi > lo, np.minimum(found, len(x)), len(x))] for *_, found in asked]


def _answered(ranges: pa.Table, points: pa.Table) -> pa.Table:
    """The ranges of one metric and stretch of time with what its points in them come to."""
    points = points.sort_by("ts")
    number = lambda table, c: table[c].cast(pa.int64()).to_numpy()
    ts = number(points, "ts")
    lo, hi = np.searchsorted(ts, number(ranges, "from"), "left"), np.searchsorted(ts, number(ranges, "to"), "right")
    some = np.flatnonzero(hi > lo)
    lo, hi = lo[some], hi[some]

    def known(c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = points[c].is_valid().to_numpy()
        upto = np.append(0, np.cumsum(there))
        return points[c].drop_null().to_numpy(), upto[lo], upto[hi]

    value, a, b = known("value")
    n = b - a
    least, most, p95 = _smallest(value, a, b, [np.zeros(len(n), dtype=np.int64), n - 1, np.maximum(np.ceil(n * 0.95).astype(np.int64) - 1, 0)])
    grown, c, d = known("grown")
    facts = {"mean": (_sums(value, a, b) / np.maximum(n, 1), n), "least": (least, n), "most": (most, n), "p95": (p95, n), "grown": (_sums(grown, c, d), d - c)}
    out = {k: ranges[k].take(pa.array(some)) for k in ("trace_id", "service_name", "metric_type", "kind", "seconds")}
    return pa.table(out | {"points": pa.array(hi - lo, pa.int64())} | {k: pa.array(x, mask=m == 0) for k, (x, m) in facts.items()})


def during(points: DataFrame, ranges: DataFrame, seconds: int, exact: bool = True) -> DataFrame:
    """For each range (trace_id, service_name, from, to; one for a trace and service) and each metric of its service with points in
    it: how many, their mean, least, most and 95th percentile, the sum of ``grown``, and the range's length in seconds.
    points: service_name, metric_type, kind, ts, value, grown. seconds: a usual length of a range; no row depends on it.

    Time is cut into stretches longer than a range. A range goes to the one it begins in, a point to that of its own and the one
    before, and a task answers all ranges of a metric and stretch from the points in order, so rows grow with points, ranges and
    answers, not with the points in a range. ``exact`` tells only how percentiles are taken where a stretch has over HELD points.
    """
    alike = "timestamp" if "timestamp" in (points.schema["ts"].dataType.simpleString(), ranges.schema["from"].dataType.simpleString()) else "timestamp_ntz"
    length, first = _seconds(F.col("to")) - _seconds(F.col("from")), STRETCH * seconds
    level = F.greatest(F.lit(0), F.ceil(F.log2((length + 1) / first))).cast("int")
    bucket = lambda c: F.floor(_seconds(F.col(c)) / (first * F.pow(F.lit(2.0), F.col("_level"))))
    known = ranges.filter((F.col("from") <= F.col("to")) & F.col("service_name").isNotNull()).withColumns({"seconds": length, "_level": level, "from": F.col("from").cast(alike), "to": F.col("to").cast(alike)})
    known = cut(known.withColumn("_bucket", bucket("from")))
    place = ["service_name", "_level", "_bucket"]
    wanted = known.groupBy(*place).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("_parts"))
    levels = sorted(r[0] for r in wanted.select("_level").distinct().collect())
    named = points.filter("service_name is not null and ts is not null").withColumns({"ts": F.col("ts").cast(alike), "value": F.col("value").cast("double"), "_metric": F.coalesce(F.concat(F.lit("+"), "metric_type"), F.lit("-"))})
    dealt = named.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bucket", F.explode(F.array(bucket("ts"), bucket("ts") - 1)))
    dealt = cut(dealt.join(wanted, place).select(*place, "_metric", "_parts", "metric_type", "kind", "ts", "value", "grown"))
    held = cut(dealt.groupBy(*place, "_metric", "_parts").agg(F.first("metric_type").alias("metric_type"), F.first("kind").alias("kind"), F.count("*").alias("_n")))
    part = F.pmod(F.xxhash64("trace_id"), F.col("_parts")).cast("int")
    asked = known.join(held, place).withColumn("_part", part)
    crowded = held.filter(F.col("_n") > HELD).select(*place, "_metric")
    some = not crowded.isEmpty()
    few = dealt.join(F.broadcast(crowded), [*place, "_metric"], "left_anti") if some else dealt
    few = few.select(*place, "_metric", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "ts", "value", "grown")
    left = asked.filter(F.col("_n") <= HELD).select(*place, "_metric", "_part", "trace_id", "metric_type", "kind", "seconds", "from", "to")
    keys = [*place, "_metric", "_part"]
    trace = known.schema["trace_id"].dataType.simpleString()
    shape = f"trace_id {trace}, service_name string, metric_type string, kind string, seconds double, points long, mean double, least double, most double, p95 double, grown double"
    out = left.groupBy(*keys).cogroup(few.groupBy(*keys)).applyInArrow(lambda r, p: _answered(r, p), shape)
    if some:
        wide = asked.filter(F.col("_n") > HELD).select("trace_id", "service_name", "_metric", "seconds", "from", "to")
        met = range_join(named, "ts", wide, "from", "to", ["service_name", "_metric"], seconds)
        facts = [F.count("*").alias("points"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("grown").alias("grown")]
        out = out.unionByName(summarise(met, ["trace_id", "service_name", "metric_type", "kind", "seconds"], facts, {"p95": ("value", 0.95)}, exact, digits=6))
    return out


def metrics_during_trace(spans: DataFrame, points: DataFrame, point_service: Column, buffer_seconds: float = 60) -> DataFrame:
    """Per trace, service and metric: mean and range of the points within the service's part of the trace and a buffer."""
    parts = spans.groupBy("trace_id", C.service().alias("service_name")).agg(F.min("start_time").alias("a"), F.max("end_time").alias("b"))
    ranges = parts.select("trace_id", "service_name", _shift(F.col("a"), -buffer_seconds).alias("from"), _shift(F.col("b"), buffer_seconds).alias("to"))
    slim = points.select(point_service.alias("service_name"), "metric_type", F.lit("gauge").alias("kind"), "ts", "value", F.lit(None).cast("double").alias("grown"))
    found = during(slim, ranges, max(1, int(2 * buffer_seconds)))
    return found.select("trace_id", "service_name", "metric_type", "points", F.round("mean", 4).alias("avg_value"), F.col("least").alias("min_value"), F.col("most").alias("max_value"))


def metric_kind(metric: Column) -> Column:
    """histogram (of durations or latencies), counter (a total) or gauge, by the metric's name."""
    return F.when(metric.contains("duration") | metric.contains("latency"), "histogram").when(metric.contains("total"), "counter").otherwise("gauge")


def metric_kinds_during_trace(spans: DataFrame, points: DataFrame, point_service: Column, buffer_seconds: float = 60, series: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """Per trace, service and metric over the service's part of the trace and a buffer: the 95th percentile of a histogram's
    points, the increase a second of a counter (a fall is a restart), the mean of a gauge. series: further columns of
    ``points`` that tell counters of one service and metric apart."""
    parts = spans.groupBy("trace_id", C.service().alias("service_name")).agg(F.min("start_time").alias("a"), F.max("end_time").alias("b"))
    ranges = parts.select("trace_id", "service_name", _shift(F.col("a"), -buffer_seconds).alias("from"), _shift(F.col("b"), buffer_seconds).alias("to"))
    slim = points.select(point_service.alias("service_name"), "metric_type", "ts", "value", metric_kind(F.col("metric_type")).alias("kind"), *series)
    old = F.lag("value").over(Window.partitionBy("service_name", "metric_type", *series).orderBy("ts"))
    slim = slim.withColumn("grown", F.when(old.isNull(), 0.0).when(F.col("value") < old, F.col("value")).otherwise(F.col("value") - old))
    g = during(slim, ranges, max(1, int(2 * buffer_seconds)), exact)
    value = F.when(F.col("kind") == "histogram", F.col("p95")).when(F.col("kind") == "counter", F.col("grown") / F.col("seconds")).otherwise(F.col("mean"))
    return g.select("trace_id", "service_name", "metric_type", "kind", "points", F.round(value, 6).alias("value"))


def cross_signal_timeline(spans: DataFrame, logs: DataFrame, log_service: Column, buffer_seconds: float = 5, per_trace: int = 50) -> DataFrame:
    """Per trace, in one order of time: its spans, its logs, and troubled logs of its services around it. Logs have
    "[severity] body" as their name and the severity as their status."""
    labels = {"http_method": "http.method", "http_url": "http.url", "http_status": "http.status_code", "db_system": "db.system", "db_statement": "db.statement"}
    own = spans.select(
        "trace_id", F.lit("SPAN").alias("event_type"), F.col("start_time").alias("event_time"), "end_time", F.col("span_id").alias("event_id"), "span_id", "parent_span_id", F.col("name").alias("event_name"), C.service().alias("service_name"),
        C.status_name().alias("status"), F.round(C.ms(), 2).alias("duration_ms"), C.kind_name().alias("span_kind"), *[C.attr(k).alias(n) for n, k in labels.items()],
    )
    name = F.concat(F.lit("["), F.coalesce("severity_text", F.lit("")), F.lit("] "), F.coalesce("body.string_value", F.lit("")))
    slim = logs.select("insert_id", "timestamp", F.col("severity_text").alias("severity"), log_service.alias("service_name"), F.col("trace_id").alias("log_trace"), "span_id", name.alias("event_name"))
    whole = spans.filter("trace_id is not null").groupBy("trace_id").agg(F.min("start_time").alias("a"), F.max("end_time").alias("b"))
    shape = lambda df, kind: df.select("trace_id", "a", F.lit(kind).alias("event_type"), F.col("timestamp").alias("event_time"), F.col("insert_id").alias("event_id"), "span_id", "event_name", "service_name", F.col("severity").alias("status"), F.lit("LOG").alias("span_kind"))
    direct = shape(slim.join(whole.select("trace_id", "a"), F.col("log_trace") == F.col("trace_id")), "LOG_DIRECT")
    parts = spans.select("trace_id", C.service().alias("service_name")).distinct().join(whole, "trace_id")
    ranges = parts.select("trace_id", "service_name", _shift(F.col("a"), -buffer_seconds).alias("from"), _shift(F.col("b"), buffer_seconds).alias("to"), "a")
    near = first_nearby(slim.filter(F.col("severity").isin(TROUBLE)), ranges, ["a"], per_trace)
    # the trace's start comes along with each row, so the rows of the timeline are not joined once more
    out = own.join(whole.select("trace_id", "a"), "trace_id").unionByName(direct, allowMissingColumns=True).unionByName(shape(near, "LOG_TEMPORAL"), allowMissingColumns=True)
    return out.withColumn("relative_time_ms", F.round(C.epoch_ms(F.col("event_time")) - C.epoch_ms(F.col("a")), 3)).drop("a")


def signal_correlation_strength(spans: DataFrame, logs: DataFrame, log_service: Column) -> DataFrame:
    """Per service, how well its spans and logs can be joined."""
    s = spans.groupBy(C.service().alias("service_name")).agg(F.count("*").alias("span_count"), F.countDistinct("trace_id").alias("trace_count"))
    l = logs.groupBy(log_service.alias("service_name")).agg(F.count("*").alias("log_count"), F.count("trace_id").alias("logs_with_trace"), F.count("span_id").alias("logs_with_span"), F.countDistinct("trace_id").alias("traced_logs"))
    j = s.join(l, "service_name", "full_outer").na.fill(0)
    share = lambda a, b: F.coalesce(F.least(F.lit(100.0), F.try_divide(F.col(a), F.col(b)) * 100), F.lit(0.0))
    a, b, c = share("logs_with_trace", "log_count"), share("traced_logs", "trace_count"), share("logs_with_span", "log_count")
    both = F.when((F.col("span_count") > 0) & (F.col("log_count") > 0), 100.0).otherwise(0.0)
    score = 0.4 * a + 0.4 * b + 0.1 * c + 0.1 * both
    return j.select("service_name", "span_count", "log_count", F.round(a, 1).alias("log_trace_pct"), F.round(b, 1).alias("trace_log_pct"), F.round(c, 1).alias("log_span_pct"), F.round(score, 1).alias("score"), F.when(score < 50, "LOW").when(score < 80, "MEDIUM").otherwise("GOOD").alias("status"))


def trace_to_pods(logs: DataFrame) -> DataFrame:
    """The pods and containers that a trace's logs came from."""
    at = F.col("resource.attributes")
    df = logs.filter(F.col("trace_id").isNotNull() & F.col("resource.type").isin("k8s_container", "k8s_pod"))
    return df.select("trace_id", at["namespace_name"].alias("namespace"), at["pod_name"].alias("pod"), at["container_name"].alias("container"), at["cluster_name"].alias("cluster")).distinct()


def trace_services(spans: DataFrame) -> DataFrame:
    """(trace_id, service): what stands before the first slash of its spans' names."""
    return spans.filter(F.contains("name", F.lit("/"))).select("trace_id", F.substring_index("name", "/", 1).alias("service")).filter("service <> ''").distinct()


def change_correlation(starts: DataFrame, changes: DataFrame, minutes: float = 30) -> DataFrame:
    """Per (service_name, anomaly_start) the latest change (ts, change_id, method) of that service in the minutes before."""
    ranges = starts.select("service_name", "anomaly_start", _shift(F.col("anomaly_start"), -60 * minutes).alias("from"))
    relevant = changes.filter(F.lower("method").rlike("update|deploy|patch"))
    j = range_join(relevant, "ts", ranges, "from", "anomaly_start", ["service_name"], max(1, int(60 * minutes)))
    last = j.groupBy("service_name", "anomaly_start").agg(F.count("*").alias("changes"), F.max(F.struct("ts", "change_id", "method")).alias("c"))
    return last.select("service_name", "anomaly_start", "changes", F.col("c.change_id").alias("change_id"), F.col("c.method").alias("method"), F.col("c.ts").alias("changed_at"))
