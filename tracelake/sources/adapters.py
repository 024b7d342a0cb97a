"""Span, log and metric tables derived from the given order, line item, event and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _end(start: str, nano: str) -> F.Column:
    return F.expr(f"{start} + make_dt_interval(0, 0, 0, cast({nano} div 1000 as decimal(18,6)) / 1000000)")


def _map(**entries: F.Column) -> F.Column:
    """A map of the entries; underscores in names stand for dots, double ones for underscores. A label that a row lacks is
    a null value, so that reading one label of the map is reading its column, which Catalyst prunes."""
    pairs = [(F.lit(k.replace("__", "\0").replace("_", ".").replace("\0", "_")), v.cast("string")) for k, v in entries.items()]
    return F.create_map(*[x for pair in pairs for x in pair])


_NO_EVENTS = "array<struct<name:string,time:timestamp_ntz,attributes:map<string,string>>>"
_NO_LINKS = "array<struct<trace_id:string,span_id:string,attributes:map<string,string>>>"


def spans_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per order: the order is the root span, its line items are client spans below it."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    failed = F.col("o_orderstatus") == "F"
    root = orders.select(
        F.concat(F.lit("t"), "o_orderkey").alias("trace_id"), F.concat(F.lit("o"), "o_orderkey").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.concat(F.lit("order "), "o_orderpriority").alias("name"), F.lit(2).alias("kind"), F.col("o_orderdate").alias("start_time"),
        F.round(F.col("o_totalprice") * 1000).cast("long").alias("duration_nano"),
        F.struct(F.when(failed, 2).otherwise(1).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"),
        _map(http_method=F.when(F.col("o_orderkey") % 2 == 0, "GET").otherwise("POST"), http_target=F.concat(F.lit("/"), "o_orderpriority"), http_status__code=F.when(failed, "500").otherwise("200")).alias("attributes"),
        F.struct(_map(service_name=F.concat(F.lit("svc-"), F.col("o_custkey") % 13)).alias("attributes")).alias("resource"),
        F.array().cast(_NO_EVENTS).alias("events"), F.array().cast(_NO_LINKS).alias("links"),
        F.struct(F.lit("orders").alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("schema_url")).alias("instrumentation_scope"),
    )
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    placed = items.withColumn("rn", rn).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.expr("o_orderdate + make_dt_interval(0, 0, 0, cast(rn * 20 as decimal(18,6)) / 1000)")
    returned, part = F.col("l_returnflag") == "R", F.col("l_partkey") % 3
    error = F.struct(F.lit("exception").alias("name"), F.col("start_time").alias("time"), _map(exception_type=F.concat(F.lit("Err"), F.col("l_partkey") % 5), exception_message=F.concat(F.lit("part "), F.col("l_partkey") % 50)).alias("attributes"))
    link = F.struct(F.concat(F.lit("t"), F.col("l_orderkey") - 1).alias("trace_id"), F.lit(None).cast("string").alias("span_id"), _map(type=F.lit("previous")).alias("attributes"))
    child = placed.withColumn("start_time", start).select(
        F.concat(F.lit("t"), "l_orderkey").alias("trace_id"), F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "rn").alias("span_id"),
        F.when(F.col("rn") % 3 == 1, F.concat(F.lit("o"), "l_orderkey")).otherwise(F.concat(F.lit("l"), "l_orderkey", F.lit("-"), F.col("rn") - 1)).alias("parent_span_id"),
        F.concat(F.lit("item "), F.col("l_partkey") % 20).alias("name"), F.lit(3).alias("kind"), "start_time",
        (F.col("l_quantity") * 1_000_000).cast("long").alias("duration_nano"),
        F.struct(F.when(returned, 2).otherwise(1).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"),
        _map(
            peer_service=F.concat(F.lit("svc-"), 2 + F.col("l_partkey") % 10),
            db_system=F.when(part == 0, "postgresql"), db_name=F.when(part == 0, F.concat(F.lit("db"), F.col("l_suppkey") % 4)), db_operation=F.when(part == 0, F.col("l_linestatus")),
            rpc_system=F.when(part == 1, "grpc"), http_method=F.when(part == 2, "GET"),
        ).alias("attributes"),
        F.struct(_map(service_name=F.concat(F.lit("svc-"), F.col("l_suppkey") % 10)).alias("attributes")).alias("resource"),
        F.when(returned, F.array(error)).otherwise(F.array().cast(_NO_EVENTS)).alias("events"),
        F.when(F.col("l_discount") >= 0.09, F.array(link)).otherwise(F.array().cast(_NO_LINKS)).alias("links"),
        F.struct(F.concat(F.lit("items-"), F.col("l_suppkey") % 3).alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("schema_url")).alias("instrumentation_scope"),
    )
    return root.unionByName(child).withColumn("end_time", _end("start_time", "duration_nano"))


def spans_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root span per event."""
    span = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("trace_id"), F.concat(F.lit("e"), "event_id").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.col("event_type").alias("name"), F.lit(2).alias("kind"), F.col("ts").alias("start_time"), F.round(F.col("value") * 1_000_000).cast("long").alias("duration_nano"),
        F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"),
        F.create_map().cast("map<string,string>").alias("attributes"),
        F.struct(_map(service_name=F.concat(F.lit("svc-"), F.col("user_id") % 10), host_name=F.concat(F.lit("host-"), F.col("event_id") % 4)).alias("attributes")).alias("resource"),
        F.array().cast(_NO_EVENTS).alias("events"), F.array().cast(_NO_LINKS).alias("links"),
        F.struct(F.lit("events").alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("schema_url")).alias("instrumentation_scope"),
    )
    return span.withColumn("end_time", _end("start_time", "duration_nano"))


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    body = F.concat(F.lit("event "), kind, F.lit(" user "), "user_id", F.lit(" took "), F.col("value").cast("decimal(18,2)"), F.lit("ms props "), "props")
    return _table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_unix_nano"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("severity_text"),
        F.struct(body.alias("string_value")).alias("body"),
        F.struct(F.lit("k8s_container").alias("type"), _map(service_name=F.concat(F.lit("svc-"), F.col("user_id") % 10), namespace__name=F.lit("shop"), pod__name=F.concat(F.lit("web-"), F.col("user_id") % 10, F.lit("-a1-"), F.col("event_id") % 7), container__name=F.lit("web"), cluster__name=F.concat(F.lit("c"), F.col("user_id") % 2)).alias("attributes")).alias("resource"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("e"), "event_id")).alias("trace_id"), F.lit(None).cast("string").alias("span_id"), F.concat(F.lit("i"), "event_id").alias("insert_id"),
    )


def logs_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row per line of a turn; the role stands for the severity, the turn gives the minute."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "message"))
    return t.select(
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(turn as int), cast(line as decimal(18,6)))").alias("timestamp"),
        F.when(F.col("role") == "assistant", "INFO").when(F.col("role") == "user", "WARNING").otherwise("ERROR").alias("severity"),
        "message", F.concat(F.lit("conv-"), F.col("conv_id") % 10).alias("resource_id"),
    )


def metrics_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as gauge points, by type and the user's last digit."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric_type"), _map(shard=F.col("user_id") % 10).alias("metric_labels"), F.lit("service").alias("resource_type"),
        _map(service_name=F.concat(F.lit("svc-"), F.col("user_id") % 10)).alias("resource_labels"), F.col("ts"), F.col("value").cast("double").alias("value"), "event_id",
    )


def counters_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count of events of each type and day; it restarts every day, as a counter does on restart."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    t = _table(spark, sf_dir, "events").withColumn("day", day)
    return t.select(F.col("event_type").alias("metric_type"), F.create_map(F.lit("job"), F.lit("events")).alias("metric_labels"), "ts", F.row_number().over(w).cast("double").alias("value"), "event_id")


def spans_from_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events in a row as a trace with what goes wrong in practice: labels of errors, pools, statements and sizes, words
    of timeouts and retries, a long tail, orphans, spans without id or end, and ends before starts."""
    e = _table(spark, sf_dir, "events").withColumn("r", F.col("event_id") % 8).withColumn("g", F.expr("event_id div 8"))
    n, r, kind, user = F.col("event_id"), F.col("r"), F.col("event_type"), F.col("user_id")
    failed, pool = kind == "error", (n % 9 == 0) & (r > 0)
    name = (
        F.when(r == 0, F.concat(F.lit("visit "), kind)).when(n % 9 == 0, "acquire connection").when(n % 9 == 1, "retry payment")
        .when(n % 9 == 2, "call deadline exceeded").when(n % 9 == 3, "timed out step").otherwise(F.concat(F.lit("step "), kind))
    )
    nano = F.when(n % 127 == 4, None).when(n % 113 == 3, -1_000_000).otherwise(F.round(F.col("value") * F.when(n % 40 == 0, 30).otherwise(1) * 1_000_000).cast("long"))
    labels = _map(
        app=F.when(n % 5 == 0, F.concat(F.lit("app-"), user % 3)),
        http_method=F.when(r == 0, "GET"), http_target=F.when(r == 0, F.concat(F.lit("/"), kind)), http_status__code=F.when(r == 0, F.when(F.col("g") % 3 == 0, "200").when(F.col("g") % 3 == 1, "404").otherwise("503")),
        http_request__content__length=F.when(r == 0, n % 1000), http_response__content__length=F.when(r == 0, user * 10),
        db_system=F.when(r.isin(1, 4), "mysql"), db_name=F.when(r.isin(1, 4), F.concat(F.lit("db"), user % 3)), db_operation=F.when(r.isin(1, 4), "SELECT"), db_statement=F.when(r.isin(1, 4), F.concat(F.lit("SELECT "), kind, F.lit(" "), n % 6)),
        grpc_status=F.when(r == 2, F.when(n % 3 < 2, "OK").otherwise("UNAVAILABLE")), response_code=F.when(r == 3, F.when(user % 2 == 0, "500").otherwise("200")), error=F.when(r == 5, F.when(failed, "true").otherwise("false")),
        exception_kind=F.when((r == 6) & (n % 7 == 0), "NullPointer"), note=F.when((r == 7) & (n % 5 == 0), "context deadline passed"),
        pool_size=F.when(pool & (n % 2 == 0), "10"), db_pool__size=F.when(pool & (n % 2 == 1), "20"), pool_active=F.when(pool, n % 10), db_waiting__requests=F.when(pool, n % 4),
    )
    start = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(g as int), cast(r * 10 as decimal(18,6)) / 1000)")
    exception = F.struct(F.lit("exception").alias("name"), F.col("start_time").alias("time"), _map(exception_type=F.concat(F.lit("Err"), n % 4), exception_message=F.concat(F.lit("user "), user), exception_stacktrace=F.concat(F.lit("at line "), n % 13)).alias("attributes"))
    span = e.withColumn("start_time", start).select(
        F.concat(F.lit("s"), "g").alias("trace_id"), F.when(n % 131 != 7, F.concat(F.lit("e"), n)).alias("span_id"),
        F.when(r == 0, None).when(n % 97 == 5, "gone").when(r % 3 == 1, F.concat(F.lit("e"), F.col("g") * 8)).otherwise(F.concat(F.lit("e"), n - 1)).alias("parent_span_id"),
        name.alias("name"), F.when(r == 0, 2).otherwise(3).alias("kind"), "start_time", nano.alias("duration_nano"),
        F.struct(F.when(failed, 2).otherwise(1).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"), F.map_filter(labels, lambda _, v: v.isNotNull()).alias("attributes"),
        F.struct(_map(service_name=F.when(n % 5 != 0, F.concat(F.lit("svc-"), user % 10))).alias("attributes")).alias("resource"),
        F.when(failed, F.array(exception)).otherwise(F.array().cast(_NO_EVENTS)).alias("events"), F.array().cast(_NO_LINKS).alias("links"),
        F.struct(F.lit("sessions").alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("schema_url")).alias("instrumentation_scope"),
    )
    return span.withColumn("end_time", _end("start_time", "duration_nano"))
