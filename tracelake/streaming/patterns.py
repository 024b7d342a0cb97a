"""Running counts of log patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.logs import SIGNATURE_MASKS, masked


def stream_log_patterns(logs: DataFrame, body: Column, severity: str = "severity_text", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of log signatures in tumbling windows, over a stream (append or update mode) or a batch. Rows later than
    ``late`` behind the newest are dropped from a stream. Severities are counted apart, so the state of a key is a few
    numbers."""
    at = F.col("timestamp").cast("timestamp")
    df = logs.select(at.alias("at"), masked(body, SIGNATURE_MASKS).alias("pattern_signature"), F.col(severity).alias("severity"))
    if df.isStreaming:
        df = df.withWatermark("at", late)
    out = df.groupBy(F.window("at", window).alias("w"), "pattern_signature").agg(
        F.count("*").alias("occurrence_count"), F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity").isin("WARN", "WARNING")).alias("warnings"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")
    )
    ntz = lambda c, n: F.col(c).cast("timestamp_ntz").alias(n)
    return out.select(ntz("w.start", "window_start"), "pattern_signature", "occurrence_count", "errors", "warnings", ntz("first_seen", "first_seen"), ntz("last_seen", "last_seen"))
