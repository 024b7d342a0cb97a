"""Range queries on a step grid: counters and histogram buckets that restart each day, gauges, over the event metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import adapters as A

_BOUNDS = [5.0, 10.0, 20.0, 50.0, 100.0, 200.0]


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("metric_type"), (F.col("user_id") % 10).alias("shard"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")


def _daily(*keys: str):
    return Window.partitionBy(*keys, F.date_trunc("day", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)


def shard_counters(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("value", F.count("*").over(_daily("metric_type", "shard")).cast("double"))


def bucket_counters(spark: SparkSession, d: str) -> DataFrame:
    bounds = F.array(*[F.lit(b) for b in _BOUNDS], F.lit(float("inf")))
    each = _events(spark, d).withColumn("le", F.explode(bounds))
    inside = F.when(F.col("value") <= F.col("le"), 1.0).otherwise(0.0)
    return each.withColumn("value", F.sum(inside).over(_daily("metric_type", "shard", "le")))


_ORDER = ("ts", "event_id")
_E = "e AS (SELECT event_type AS metric_type, user_id % 10 AS shard, CAST(ts AS TIMESTAMP) AS ts, event_id, value FROM events), grid AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-02', INTERVAL 2 HOUR)) AS t)"


def _rates(keys: str, values: str) -> str:
    """Every growth from one point to the next, put into every window that holds both, by a plain join with the grid."""
    return (
        f"WITH {_E}, c AS ({values}), d AS (SELECT *, lag(value) OVER w AS o, lag(ts) OVER w AS ot FROM c WINDOW w AS (PARTITION BY {keys} ORDER BY ts, event_id)), "
        f"r AS (SELECT {keys}, t AS \"at\", sum(CASE WHEN value < o THEN value ELSE value - o END) AS increase FROM d JOIN grid ON t >= ts AND t < ot + INTERVAL 6 HOUR WHERE o IS NOT NULL GROUP BY {keys}, t)"
    )


_SHARDS = "SELECT metric_type, shard, ts, event_id, count(*) OVER (PARTITION BY metric_type, shard, date_trunc('day', ts) ORDER BY ts, event_id)::DOUBLE AS value FROM e"
_BUCKETS = (
    "SELECT metric_type, shard, le, ts, event_id, sum(CASE WHEN value <= le THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY metric_type, shard, le, date_trunc('day', ts) ORDER BY ts, event_id)::DOUBLE AS value FROM e, (SELECT unnest(["
    + ", ".join(f"{b}::DOUBLE" for b in _BOUNDS) + ", 'Infinity'::DOUBLE]) AS le)"
)

QUERIES = {
    "range_rates": (
        lambda spark, d: M.range_rates(A.counters_from_events(spark, d), ["metric_type"], 7200, 21600, _ORDER),
        _rates("metric_type", "SELECT metric_type, ts, event_id, row_number() OVER (PARTITION BY metric_type, date_trunc('day', ts) ORDER BY ts, event_id)::DOUBLE AS value FROM e") + " SELECT *, round(increase / 21600, 8) AS rate FROM r",
    ),
    "range_rates_summed": (
        lambda spark, d: M.sum_by(M.range_rates(shard_counters(spark, d), ["metric_type", "shard"], 7200, 21600, _ORDER), ["metric_type"], "increase"),
        _rates("metric_type, shard", _SHARDS) + " SELECT metric_type, \"at\", round(sum(increase), 8) AS increase, count(*) AS series FROM r GROUP BY 1, 2",
    ),
    "range_quantiles_p95": (
        lambda spark, d: M.range_quantiles(bucket_counters(spark, d), ["metric_type", "shard"], ["metric_type"], 0.95, 7200, 21600, _ORDER),
        _rates("metric_type, shard, le", _BUCKETS)
        + ", b AS (SELECT metric_type, \"at\", le, sum(increase) AS c FROM r GROUP BY 1, 2, 3), x AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(c) OVER w, 0) AS below, 0.95::DOUBLE * max(c) OVER (PARTITION BY metric_type, \"at\") AS want FROM b WINDOW w AS (PARTITION BY metric_type, \"at\" ORDER BY le)), "
        "f AS (SELECT *, row_number() OVER (PARTITION BY metric_type, \"at\" ORDER BY le) AS k FROM x WHERE c >= want AND want > 0) "
        "SELECT metric_type, \"at\", round(CASE WHEN le = 'Infinity'::DOUBLE OR c = below THEN lo ELSE lo + (le - lo) * (want - below) / (c - below) END, 6) AS quantile FROM f WHERE k = 1",
    ),
    "range_gauges": (
        lambda spark, d: M.range_gauges(_events(spark, d), ["metric_type"], 7200, 21600),
        f"WITH {_E} SELECT metric_type, t AS \"at\", round(avg(value), 8) AS avg, min(value) AS min, max(value) AS max, arg_max(value, (ts, value)) AS last, count(*) AS n FROM e JOIN grid ON t >= ts AND t < ts + INTERVAL 6 HOUR GROUP BY 1, 2",
    ),
}
