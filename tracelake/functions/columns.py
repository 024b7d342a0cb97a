"""Column expressions over span and log tables: names, labels, durations and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSET, OK, ERROR = 0, 1, 2
INTERNAL, SERVER, CLIENT, PRODUCER, CONSUMER = 1, 2, 3, 4, 5

SPAN_KINDS = {1: "INTERNAL", 2: "SERVER", 3: "CLIENT", 4: "PRODUCER", 5: "CONSUMER"}
STATUS_NAMES = {0: "UNSET", 1: "OK", 2: "ERROR"}
#: Severities in rising order; those of one line have the same rank. The suffixes 2 to 4 do not change the rank.
SEVERITIES = [("DEFAULT",), ("TRACE",), ("DEBUG",), ("INFO",), ("NOTICE",), ("WARN", "WARNING"), ("ERROR",), ("CRITICAL",), ("ALERT",), ("EMERGENCY", "FATAL")]
#: Label values that say there was no error.
NOT_ERRORS = ["false", "0", "none", "ok", ""]


def attr(key: str) -> Column:
    return F.col("attributes")[key]


def service() -> Column:
    return F.col("resource.attributes")["service.name"]


def status_code() -> Column:
    return F.col("status.code")


def is_error() -> Column:
    return F.coalesce(status_code() == ERROR, F.lit(False))


def ms() -> Column:
    return F.col("duration_nano") / 1_000_000


def epoch_ms(col: Column) -> Column:
    """Milliseconds since the epoch of a timestamp without zone, with fractions."""
    return F.unix_micros(col.cast("timestamp")) / 1000


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def error_rate(digits: int = 2) -> Column:
    return F.round(F.count_if(is_error()) / F.count("*") * 100, digits)


def time_window(df: DataFrame, hours: float, as_of: str, column: str = "start_time", until_hours: float = 0) -> DataFrame:
    """Rows from ``hours`` to ``until_hours`` before ``as_of`` (start included, end not, unless it is as_of itself); none
    after ``as_of``."""
    at = F.lit(as_of).cast("timestamp_ntz")
    start = at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)"))
    df = df.filter(F.col(column) >= start)
    if until_hours:
        return df.filter(F.col(column) < at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(until_hours * 3600).cast("decimal(18,6)")))
    return df.filter(F.col(column) <= at)


def root_spans(df: DataFrame) -> DataFrame:
    return df.filter(F.col("parent_span_id").isNull())


def service_filter(df: DataFrame, name: str | None) -> DataFrame:
    return df if name is None else df.filter(service() == name)


def operation_filter(df: DataFrame, name: str | None) -> DataFrame:
    return df if name is None else df.filter(F.col("name") == name)


def min_duration_filter(df: DataFrame, least_ms: float | None) -> DataFrame:
    return df if least_ms is None else df.filter(F.col("duration_nano") >= int(least_ms * 1_000_000))


def kind_filter(df: DataFrame, kind: int) -> DataFrame:
    return df.filter(F.col("kind") == kind)


def _named(names: dict, value: Column, other: str) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(other)


def status_name() -> Column:
    return _named(STATUS_NAMES, status_code(), "UNSET")


def kind_name() -> Column:
    return _named(SPAN_KINDS, F.col("kind"), "UNKNOWN")


def span_duration_ms(duration_col: str | None = None) -> Column:
    """A duration column where there is one, else end minus start; null where neither can be told."""
    between = epoch_ms(F.col("end_time")) - epoch_ms(F.col("start_time"))
    return F.coalesce(F.col(duration_col), between) if duration_col else between


def error_by_labels() -> Column:
    """An HTTP status of 400 or more, or a label whose key speaks of an error and whose value does not deny it."""
    http = F.coalesce(F.expr("try_cast(attributes['/http/status_code'] as int)"), F.expr("try_cast(attributes['http.status_code'] as int)"), F.expr("try_cast(attributes['status.code'] as int)"))
    said = F.exists(F.map_entries("attributes"), lambda e: F.lower(e["key"]).contains("error") & ~F.lower(e["value"]).isin(NOT_ERRORS))
    return F.coalesce(http >= 400, F.lit(False)) | F.coalesce(said, F.lit(False))


def error_by_text() -> Column:
    """'error' anywhere in the labels."""
    return F.coalesce(F.exists(F.map_entries("attributes"), lambda e: F.lower(F.concat_ws(" ", e["key"], e["value"])).contains("error")), F.lit(False))


def error_by_status() -> Column:
    """An HTTP status that starts with 4 or 5."""
    status = F.coalesce(attr("/http/status_code"), attr("http.status_code"), F.lit(""))
    return status.startswith("4") | status.startswith("5")


def span_service_name() -> Column:
    return F.coalesce(service(), attr("service.name"), attr("/service.name"), attr("g.co/service.name"), attr("service"), attr("app"), F.lit("unknown"))


def target_service(extended: bool = False) -> Column:
    """The callee of a client span; extended looks at message and function labels as well."""
    keys = ["peer.service", "net.peer.name", "db.system", "rpc.service", "http.host"]
    if extended:
        keys += ["messaging.destination", "faas.invoked_provider"]
    fallback = F.nullif(F.regexp_extract("name", r"^([A-Za-z0-9_-]+)" if extended else r"^([^/]+)", 1), F.lit(""))
    return F.coalesce(*[attr(k) for k in keys], fallback)


def call_type() -> Column:
    return (
        F.when(attr("db.system").isNotNull(), "DATABASE")
        .when(attr("rpc.system").isNotNull(), "RPC")
        .when(attr("http.method").isNotNull(), "HTTP")
        .when(attr("messaging.system").isNotNull(), "MESSAGING")
        .otherwise("INTERNAL")
    )


def dependency_type() -> Column:
    host = attr("http.host")
    return (
        F.when(attr("db.system").isNotNull(), "DATABASE")
        .when(attr("messaging.system").isNotNull(), "MESSAGE_QUEUE")
        .when(attr("rpc.system") == "grpc", "GRPC_SERVICE")
        .when(host.like("%.googleapis.com"), "GCP_API")
        .when(host.like("%.aws.%"), "AWS_API")
        .when(host.isNotNull(), "HTTP_EXTERNAL")
        .when(attr("faas.invoked_provider").isNotNull(), "CLOUD_FUNCTION")
        .otherwise("INTERNAL_SERVICE")
    )


def severity_rank(col: Column) -> Column:
    """1 for DEFAULT and so on; 0 for a severity that is not known."""
    ranks = F.create_map(*[F.lit(x) for k, names in enumerate(SEVERITIES) for n in names for x in (n, k + 1)])
    return F.coalesce(F.try_element_at(ranks, F.regexp_replace(F.upper(col), "[2-4]$", "")), F.lit(0))


def trace_predicates(df: DataFrame, terms: list[tuple[str, Column]]) -> DataFrame:
    """Spans of the traces in which every term holds: for a 'root' term on its root span, for an 'any' term on some span."""
    flags = []
    for k, (where, test) in enumerate(terms):
        test = test & F.col("parent_span_id").isNull() if where == "root" else test
        flags.append(F.max(F.when(test, 1).otherwise(0)).alias(f"t{k}"))
    if not flags:
        return df
    met = df.groupBy("trace_id").agg(*flags)
    for k in range(len(flags)):
        met = met.filter(F.col(f"t{k}") == 1)
    return df.join(met.select("trace_id"), "trace_id", "left_semi")

