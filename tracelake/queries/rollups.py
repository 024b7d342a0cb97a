"""Windows, trends and objectives answered from an hourly rollup of the event spans; and comparisons of log periods whose
patterns occur in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import cut
from ..operators import logs as L
from ..operators import rollup as R
from ..plans import pipelines as P
from ..sources import adapters as A
from . import sql as Q
from .fleet import EVENTS_END
from .fleet import QUERIES as FLEET
from .more import QUERIES as MORE
from .signals import _COMPARE, _slos, _template_sql
from .signals import QUERIES as SIGNALS


def parts(spark: SparkSession, d: str) -> DataFrame:
    return cut(R.rollup(A.spans_from_events(spark, d)))


def _in_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether each service's percentile from merged sketches is where it should be among the service's spans."""
    merged = R.merge(parts(spark, d), ["service_name"]).select("service_name", R.percentile(0.95).alias("p95"))
    spans = A.spans_from_events(spark, d).select(C.service().alias("service_name"), C.ms().alias("ms"))
    g = spans.join(merged, "service_name").groupBy("service_name").agg(F.count("*").alias("n"), F.count_if(F.col("ms") < F.col("p95")).alias("below"), F.count_if(F.col("ms") <= F.col("p95")).alias("upto"))
    slack = R.RANK_ERROR * F.col("n") + 1
    return g.select("service_name", "n", ((F.col("below") <= 0.95 * F.col("n") + slack) & (F.col("upto") >= 0.95 * F.col("n") - slack)).alias("in_bound"))


def event_messages(spark: SparkSession, d: str) -> DataFrame:
    """A message of each event, whose service is a letter, so that fifty templates occur again and again."""
    e = spark.read.parquet(f"{d}/events.parquet")
    letter = F.substring(F.lit("abcdefghij"), (F.col("user_id") % 10 + 1).cast("int"), F.lit(1))
    text = F.concat(F.lit("service "), letter, F.lit(" "), "event_type", F.lit(" took "), F.col("value").cast("decimal(18,2)"), F.lit("ms"))
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return e.select(text.alias("message"), severity.alias("severity"), F.col("ts").cast("timestamp_ntz").alias("timestamp"))


_EDGE = "2024-01-02 00:00:00"


def _event_periods(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, edge = event_messages(spark, d), F.lit(_EDGE).cast("timestamp_ntz")
    return rows.filter(F.col("timestamp") < edge), rows.filter(F.col("timestamp") >= edge)


_OPTIONS = {"lead": 3, "many": 1000}
_E0 = (
    "e0 AS (SELECT 'service ' || chr(CAST(97 + user_id % 10 AS INTEGER)) || ' ' || event_type || ' took <DURATION>' AS m, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(ts AS TIMESTAMP) AS timestamp, "
    f"CASE WHEN ts < TIMESTAMP '{_EDGE}' THEN 1 ELSE 2 END AS period FROM events)"
)
_EVENT_PERIODS = f"WITH {_E0}, {_template_sql('period = 1', 'a', 'e0', 3, 1000)}, {_template_sql('period = 2', 'b', 'e0', 3, 1000)}, {_COMPARE}"

QUERIES = {
    "rollup_metrics": (
        lambda spark, d: R.metrics(parts(spark, d), EVENTS_END, 24 * 7).drop("p50_ms", "p95_ms", "p99_ms", "traces_estimate"),
        Q.with_events(f"SELECT service AS service_name, {Q.COUNTS}, round(avg(ms), 2) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM s WHERE start_time >= TIMESTAMP '{EVENTS_END}' - INTERVAL 7 DAY AND start_time < TIMESTAMP '{EVENTS_END}' GROUP BY 1"),
    ),
    "rollup_percentiles_in_bound": (_in_bound, Q.with_events("SELECT service AS service_name, count(*) AS n, true AS in_bound FROM s GROUP BY 1")),
    "rollup_trend_changes": (lambda spark, d: R.trend_changes(parts(spark, d), EVENTS_END, 24 * 31, "error_rate", 1, 4), (FLEET | MORE)["trend_changes_error_rate_4h"][1]),
    "rollup_compare_time_periods": (
        lambda spark, d: R.compare_periods(parts(spark, d), EVENTS_END, (24 * 14, 24 * 7), (24 * 7, 0)).select("service_name", "period", "request_count", "error_count", "error_rate_pct", "error_rate_delta"),
        f"SELECT service_name, period, request_count, error_count, error_rate_pct, error_rate_delta FROM ({FLEET['compare_time_periods'][1]})",
    ),
    "rollup_slo_compliance": (lambda spark, d: R.slo_compliance(parts(spark, d), _slos(spark, d), EVENTS_END), SIGNALS["slo_compliance"][1]),
    "compare_log_patterns_of_events": (
        lambda spark, d: L.compare_log_patterns(*(L.template_patterns(p, **_OPTIONS) for p in _event_periods(spark, d))),
        f"{_EVENT_PERIODS} SELECT * FROM comp",
    ),
    "log_pattern_pipeline_of_events": (
        lambda spark, d: P.log_pattern_pipeline(*_event_periods(spark, d), **_OPTIONS),
        f"{_EVENT_PERIODS}, al AS (SELECT count(*) FILTER (change = 'new') AS n, count(*) FILTER (change = 'new' AND error_count > 0) AS ne, count(*) FILTER (change = 'increased' AND change_pct > 200) AS su FROM comp) SELECT comp.*, CASE WHEN ne > 0 THEN 'HIGH' WHEN n > 5 OR su > 0 THEN 'MEDIUM' ELSE 'LOW' END AS alert_level FROM comp, al WHERE change <> 'stable'",
    ),
}
