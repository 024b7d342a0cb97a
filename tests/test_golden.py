"""Hand-written traces, logs and series with known answers, edge cases, and the rules where this library decides."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.functions.quantiles import floor_index
from tracelake.operators import cluster, correlate, graph, logs, metrics, traces, tree
from tracelake.schema import SPAN_SCHEMA
from tracelake.sources import readers
from tracelake.streaming.patterns import stream_log_patterns

T0 = dt.datetime(2024, 1, 1)


def span(trace, sid, parent, name, start, end, service="a", kind=2, code=1, **labels):
    at = lambda ms: None if ms is None else T0 + dt.timedelta(milliseconds=ms)
    nano = None if start is None or end is None else int((end - start) * 1_000_000)
    return (trace, sid, parent, name, kind, at(start), at(end), nano, (code, None), {k.replace("_", "."): v for k, v in labels.items()}, ({"service.name": service},), [], [], ("lib", "1", None))


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SPAN_SCHEMA)


def test_critical_path_of_root_and_child(make):
    df = make(span("t", "r", None, "root", 0, 100), span("t", "c", "r", "child", 10, 98))
    row = tree.critical_path_blocking(df).first()
    assert [p["name"] for p in row["critical_path"]] == ["root", "child"]
    assert row["total_critical_ms"] == 100.0


def test_blocking_halves_children_that_end_early(make):
    df = make(span("t", "r", None, "root", 0, 100), span("t", "c", "r", "child", 10, 60))
    assert tree.critical_path_blocking(df).first()["total_critical_ms"] == 50 + 25


def test_blocking_merges_overlapping_children(make):
    df = make(span("t", "r", None, "r", 0, 100), span("t", "a", "r", "a", 0, 60), span("t", "b", "r", "b", 40, 99))
    self_ms = {r["span_id"]: r["self_ms"] for r in tree.self_times(df).collect()}
    assert self_ms == {"r": 1.0, "a": 60.0, "b": 59.0}


def test_longest_child_path(make):
    df = make(span("t", "r", None, "r", 0, 100), span("t", "a", "r", "a", 0, 30), span("t", "b", "r", "b", 0, 50), span("t", "c", "b", "c", 0, 45))
    rows = tree.critical_path_longest_child(df).orderBy("depth").collect()
    assert [r["name"] for r in rows] == ["r", "b", "c"]
    assert [r["self_time_ms"] for r in rows] == [20.0, 5.0, 45.0] and [r["is_bottleneck"] for r in rows] == [False, False, True]


def test_parent_cycles_end(make):
    df = make(span("t", "a", "b", "x", 0, 1), span("t", "b", "a", "y", 0, 1), span("t", "r", None, "r", 0, 1))
    assert tree.call_graph(df).first()["total_spans"] == 3


def test_orphans_are_roots_of_the_call_graph(make):
    df = make(span("t", "a", "gone", "x", 0, 1), span("t", "b", "a", "y", 0, 1))
    row = tree.call_graph(df).first()
    assert (row["root_count"], row["max_depth"]) == (1, 1)


def test_quality_issues(make):
    df = make(span("t", "r", None, "r", 10, 20), span("t", "c", "r", "c", 5, 15), span("t", "o", "gone", "o", 0, 1), span("t", "n", "r", "n", 18, 12), span("t", None, "r", "x", 11, 12), span("t", "m", "r", "m", None, None))
    got = {(r["span_id"], r["issue"]) for r in traces.validate_trace_quality(df).collect()}
    assert got == {("c", "clock_skew"), ("o", "orphaned_span"), ("n", "negative_duration"), (None, "missing_span_id"), ("m", "timestamp_error")}


def test_retry_storm(make):
    df = make(*[span("t", f"s{k}", None, "call", 100 * k, 100 * k + 50) for k in range(4)], span("t", "x", None, "retry db", 0, 1))
    got = {r["span_name"]: (r["retry_count"], r["has_exponential_backoff"]) for r in traces.retry_storm(df).collect()}
    assert got == {"call": (4, True), "retry db": (1, False)}


def test_cascading_timeout_skips_others_on_the_way(make):
    df = make(span("t", "r", None, "gateway timeout", 0, 50), span("t", "m", "r", "middle", 0, 40), span("t", "l", "m", "db deadline", 0, 30))
    rows = tree.cascading_timeout(df).collect()
    assert [r["affected_spans"] for r in rows] == [["db deadline", "gateway timeout"]]


def test_pool_waits(make):
    df = make(span("t", "p", None, "pool acquire", 0, 550), span("t", "q", None, "other", 0, 900))
    row = traces.connection_pool_issues(df).collect()
    assert [(r["severity"], r["pool_exhaustion"]) for r in row] == [("high", True)]


def test_serial_chain_is_broken_by_a_parent(make):
    chain = [span("t", f"s{k}", None, f"op{k}", 60 * k, 60 * k + 55) for k in range(4)]
    assert traces.serial_chains(make(*chain)).count() == 1
    chain[2] = span("t", "s2", "s1", "op2", 120, 175)
    assert traces.serial_chains(make(*chain)).count() == 0


def test_grpc_status_is_an_error(make):
    df = make(span("t", "a", None, "x", 0, 1, grpc_status="UNAVAILABLE"), span("t", "b", None, "x", 0, 1, grpc_status="OK"))
    assert [(r["span_id"], r["error_type"]) for r in traces.extract_errors(df).collect()] == [("a", "grpc_error")]


def test_three_cycles_in_both_directions(make):
    call = lambda k, a, b: span("t", k, None, "x", 0, 1, service=a, kind=3, peer_service=b)
    df = make(call("1", "a", "b"), call("2", "b", "c"), call("3", "c", "a"), call("4", "a", "c"), call("5", "c", "b"), call("6", "b", "a"))
    paths = [r["cycle_path"] for r in graph.circular_dependencies(df).filter("cycle_length = 3").collect()]
    assert sorted(paths) == ["a -> b -> c -> a", "a -> c -> b -> a"]


def test_edge_weights_are_over_kept_edges(make):
    call = lambda k, b: span("t", k, None, "x", 0, 1, service="a", kind=3, peer_service=b)
    df = make(*[call(f"{k}", "b") for k in range(9)], call("z", "c"))
    assert [r["dependency_weight_pct"] for r in graph.dependency_edges(df, 2).collect()] == [100.0]


def test_predicates_join_terms_with_and(make):
    df = make(span("t", "r", None, "root", 0, 10), span("t", "c", "r", "x", 0, 5, db_name="d"), span("u", "r", None, "root", 0, 10))
    found = C.trace_predicates(df, [("root", F.col("name") == "root"), ("any", C.attr("db.name") == "d")])
    assert {r["trace_id"] for r in found.collect()} == {"t"}


def test_empty_spans(make, spark):
    none = spark.createDataFrame([], SPAN_SCHEMA)
    assert tree.call_graph(none).count() == 0 and tree.critical_path_blocking(none).count() == 0 and graph.dependency_edges(none).count() == 0
    assert traces.latency_statistics(none).count() == 0 and traces.n_plus_one(none).count() == 0


def test_floor_index_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 7.0)], "k string, v double")
    got = {r["k"]: (r["p90"], r["p50"]) for r in floor_index(df, ["k"], "v", {"p90": 0.9, "p50": 0.5}).collect()}
    assert got == {"a": (10.0, 6.0), "b": (7.0, 7.0)}


def test_metric_anomaly_and_shift(spark):
    at = lambda k: T0 + dt.timedelta(minutes=k)
    p = spark.createDataFrame([("m", at(k), 5.0) for k in range(10)] + [("m", at(10), 100.0)], "k string, ts timestamp_ntz, value double")
    assert [r["value"] for r in metrics.metric_anomalies(p, ["k"], 2.0).collect()] == [100.0]
    q = spark.createDataFrame([("m", at(k), 10.0 if k < 5 else 20.0) for k in range(10)], "k string, ts timestamp_ntz, value double")
    row = metrics.compare_metric_windows(q, ["k"], F.col("ts") >= F.lit(at(5)).cast("timestamp_ntz")).first()
    assert (row["mean_shift"], row["pct_change"], row["is_significant"]) == (10.0, 100.0, True)


def test_used_up_budget_is_critical(spark):
    p = spark.createDataFrame([("s", T0, 5.0), ("s", T0 + dt.timedelta(hours=1), -1.0)], "k string, ts timestamp_ntz, value double")
    row = metrics.error_budget_burn(p, ["k"], 1).first()
    assert (row["hours_to_exhaustion"], row["urgency"]) == (0.0, "CRITICAL")


def test_counter_restart_counts_from_zero(spark):
    p = spark.createDataFrame([("c", T0 + dt.timedelta(minutes=k), v) for k, v in enumerate([10.0, 15.0, 3.0])], "k string, ts timestamp_ntz, value double")
    assert metrics.counter_rate(p, ["k"]).first()["increase"] == 8.0


def test_messages_out_of_payloads(spark):
    rows = [("  hi ", None, None), (None, '{"Message":"yes","id":"x"}', None), (None, '{"n":1,"nested":{"msg":"a longer inner message"}}', None), (None, '{"n": 1}', None), (None, None, '{"methodName":"M","status":{"code":3,"message":"bad"}}'), (None, "not json", None), (None, None, None)]
    df = logs.extract_log_message(spark.createDataFrame(rows, "textPayload string, jsonPayload string, protoPayload string"))
    assert [r["message"] for r in df.collect()] == ["hi", "yes", "a longer inner message", '{"n":1}', "[M] status=3: bad", "not json", ""]


def test_masks(spark):
    df = spark.createDataFrame([("at 2024-01-01T10:00:00 10.0.0.1 took 1.5ms id 0123456789abcdef01234567",)], "message string")
    assert logs.mask_variables(df).first()["masked"] == "at <TIMESTAMP> <IP> took <DURATION> id <ID>"


def test_new_error_pattern_raises_the_alert(spark):
    row = lambda m, s, n: [(m, s, T0)] * n
    old = spark.createDataFrame(row("all is well now", "INFO", 20), "message string, severity string, timestamp timestamp_ntz")
    new = spark.createDataFrame(row("all is well now", "INFO", 10) + row("disk failed badly today", "ERROR", 5), "message string, severity string, timestamp timestamp_ntz")
    c = logs.compare_log_patterns(logs.template_patterns(old), logs.template_patterns(new))
    assert {(r["template"], r["change"]) for r in c.collect()} == {("all is well now", "stable"), ("disk failed badly today", "new")}
    assert logs.alert_level(c).first()["alert_level"] == "HIGH"


def test_varying_tokens_become_wildcards(spark):
    df = spark.createDataFrame([(f"user {n} logged in", "INFO", T0) for n in ("ann", "bob", "cy")], "message string, severity string, timestamp timestamp_ntz")
    got = {r["template"]: r["count"] for r in logs.template_patterns(df, lead=1).collect()}
    assert got == {"user <*> logged in": 3}


def test_similar_incidents(spark):
    p = spark.createDataFrame([("1", "pool exhausted in db"), ("2", "strange leak seen"), ("3", "zzz")], "pattern_id string, template string")
    i = spark.createDataFrame([("i1", "pool exhausted", "Pool ran dry", "traffic", "db", "2024-01-01"), ("i2", "oom", "Memory leak", "a cache", "web", "2024-01-01")], "incident_id string, pattern string, title string, root_cause string, service string, date string")
    got = {(r["pattern_id"], r["incident_id"], r["match"]) for r in logs.similar_incidents(p, i).collect()}
    assert got == {("1", "i1", "pattern"), ("2", "i2", "word")}


def test_trace_documents_with_bad_times(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"trace_id":"t","project_id":"p","spans":[{"span_id":"a","name":"n","start_time":"2024-01-01T00:00:00Z","end_time":"2024-01-01T00:00:01Z","labels":{"/http/status_code":"503"}},{"span_id":"b","name":"m","start_time":"soon","end_time":"2024-01-01T00:00:01Z","parent_span_id":"a"}]}\n')
    rows = {r["span_id"]: r for r in readers.read_trace_documents(spark, str(tmp_path / "t.json")).collect()}
    assert rows["a"]["duration_nano"] == 1_000_000_000 and rows["b"]["start_time"] is None and rows["b"]["parent_span_id"] == "a"


def test_slo_documents(spark):
    schema = "name string, displayName string, goal double, rollingPeriod struct<days:int>, serviceLevelIndicator struct<basicSli:struct<latency:struct<threshold:struct<seconds:long,nanos:long>>,availability:struct<x:int>>,requestBased:struct<x:int>,windowsBased:struct<x:int>>"
    row = readers.slo_definitions(spark.createDataFrame([("n", "d", 0.99, (28,), (((((1, 500_000_000),), None)), None, None))], schema)).first()
    assert (row["sli_type"], row["sli_metric"], row["latency_threshold_ms"], row["rolling_days"]) == ("basic", "latency", 1500.0, 28)


def test_alerts_with_policy(spark):
    a = spark.createDataFrame([("1", "p1", "OPEN", T0), ("2", "p9", "OPEN", T0), ("3", "p1", "CLOSED", T0)], "alert_id string, policy_name string, state string, open_time timestamp_ntz")
    p = spark.createDataFrame([("p1", "P", {"team": "x"}, ["c"], True)], "name string, display_name string, user_labels map<string,string>, conditions array<string>, enabled boolean")
    got = {r["alert_id"]: r["policy_display_name"] for r in readers.alerts_with_policy(a, p).collect()}
    assert got == {"1": "P", "2": None}


def test_time_series_points_and_result(spark, tmp_path):
    s = spark.createDataFrame([(("m", {"a": "b"}), ("r", {}), [("2024-01-01T00:00:00Z", 1.0), ("bad", 2.0)])], "metric struct<type:string,labels:map<string,string>>, resource struct<type:string,labels:map<string,string>>, points array<struct<timestamp:string,value:double>>")
    out = readers.time_series_points(s)
    readers.write_result(out, str(tmp_path / "out"))
    assert sorted((r["ts"] is None, r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(False, 1.0), (True, 2.0)]


def test_cluster_documents(spark):
    schema = "name string, location string, status string, nodePools array<struct<name:string,status:string,initialNodeCount:int,autoscaling:struct<enabled:boolean,minNodeCount:int,maxNodeCount:int>>>, conditions array<struct<type:string,status:string>>"
    df = spark.createDataFrame([("c", "x", "RUNNING", [("p", "RECONCILING", 3, (True, 1, 5))], [("Ready", "False")]), ("d", "x", "ERROR", None, None)], schema)
    rows = {r["name"]: r for r in cluster.cluster_health(df).collect()}
    assert (rows["c"]["health"], rows["c"]["is_upgrading"], rows["c"]["max_nodes"], rows["c"]["bad_conditions"]) == ("HEALTHY", True, 5, 1) and rows["d"]["health"] == "DEGRADED"


def test_range_join_has_every_pair_once(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    points = spark.createDataFrame([("a", at(s), s) for s in range(0, 100, 7)], "k string, ts timestamp_ntz, p int")
    ranges = spark.createDataFrame([("a", at(s), at(s + 25), s) for s in range(0, 80, 9)], "k string, x timestamp_ntz, y timestamp_ntz, r int")
    got = sorted((r["p"], r["r"]) for r in correlate.range_join(points, "ts", ranges, "x", "y", ["k"], 10).collect())
    assert got == sorted((p, r) for p in range(0, 100, 7) for r in range(0, 80, 9) if r <= p <= r + 25)


def test_latest_change_before_an_anomaly(spark):
    starts = spark.createDataFrame([("a", T0)], "service_name string, anomaly_start timestamp_ntz")
    change = lambda m, n, k: ("a", T0 - dt.timedelta(minutes=m), n, k)
    changes = spark.createDataFrame([change(5, 1, "x.Update"), change(20, 2, "x.deploy"), change(1, 3, "x.Get"), change(45, 4, "x.patch")], "service_name string, ts timestamp_ntz, change_id int, method string")
    row = correlate.change_correlation(starts, changes).first()
    assert (row["change_id"], row["changes"]) == (1, 2)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=k), f"took {k} ms", "ERROR" if k % 3 else "INFO") for k in range(200)], "timestamp timestamp_ntz, body string, severity_text string")
    df.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_log_patterns(rows, F.col("body")).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window_start"], r["occurrence_count"], r["errors"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["window_start"], r["occurrence_count"], r["errors"]) for r in stream_log_patterns(df, F.col("body")).collect()}
    assert got == {x for x in batch if x[0] < T0 + dt.timedelta(hours=3)} and len(batch) == 4


def test_walks_go_as_deep_as_the_trace(make):
    df = make(*[span("t", f"s{k}", f"s{k - 1}" if k else None, f"n{k}", k, 400 - k) for k in range(104)], span("u", "r", None, "r", 0, 1))
    assert {r["trace_id"]: r["max_depth"] for r in tree.call_graph(df).collect()} == {"t": 103, "u": 0}


def test_repeated_ids_do_not_run_in_circles(make):
    df = make(span("t", "a", None, "root", 0, 9), span("t", "b", "a", "x", 0, 1), span("t", "a", "b", "again", 0, 1), span("t", "c", "a", "y", 0, 1))
    got = sorted((r["span_id"], r["depth"]) for r in tree.depths(df).collect())
    assert got == [("a", 0), ("b", 1), ("c", 1)]


def test_synonymous_severities_have_one_rank(spark):
    names = ["DEFAULT", "debug", "INFO2", "WARN", "WARNING", "ERROR", "ERROR3", "CRITICAL", "FATAL", "other", None]
    got = [r["r"] for r in spark.createDataFrame([(n,) for n in names], "s string").select(C.severity_rank(F.col("s")).alias("r")).collect()]
    assert got[3] == got[4] and got[5] == got[6] and got[0] < got[1] < got[2] < got[4] < got[5] < got[7] < got[8] and got[9] == got[10] == 0


def test_windows_end_at_as_of(make):
    df = make(*[span("t", f"s{k}", None, "n", k * 3_600_000, k * 3_600_000 + 1) for k in range(10)])
    assert [r["span_id"] for r in C.time_window(df, 2, "2024-01-01 05:00:00").orderBy("span_id").collect()] == ["s3", "s4", "s5"]
    assert [r["span_id"] for r in C.time_window(df, 2, "2024-01-01 05:00:00", until_hours=1).collect()] == ["s3"]


def test_message_signs_count_in_any_case(spark):
    rows = [('{"a": "error: the call did not end", "b": "just some words and more words"}',)]
    entries = spark.createDataFrame(rows, "jsonPayload string").selectExpr("cast(null as string) textPayload", "jsonPayload", "cast(null as string) protoPayload")
    assert logs.extract_log_message(entries).first()["message"] == "error: the call did not end"


def test_messages_of_blank_texts_and_other_columns(spark):
    rows = [("  ", '{"message": "no"}', None), (None, None, " plain "), (None, None, '{"msg": "inner words"}'), (None, None, None)]
    entries = spark.createDataFrame(rows, "textPayload string, jsonPayload string, payload string").withColumn("protoPayload", F.lit(None).cast("string"))
    assert [r["message"] for r in logs.extract_log_message(entries).collect()] == ["", "plain", "inner words", ""]


def test_healthy_traces_are_listed(make):
    df = make(span("a", "r", None, "r", 0, 1), span("b", "r", None, "acquire connection", 0, 600))
    assert {r["trace_id"]: r["health"] for r in traces.all_patterns(df).collect()} == {"a": "healthy", "b": "critical"}


def test_samples_are_the_least_values_of_each_group(spark):
    from tracelake.functions.groups import beside, distinct_count, samples

    df = spark.createDataFrame([(None, "b", "x"), (None, "a", "y"), ("k", None, "x"), ("k", "c", None), ("k", "c", "z"), ("m", None, None)], "g string, v string, w string")
    out = beside(df.groupBy("g").count(), ["g"], samples(df, ["g"], "v", "s", 1), distinct_count(df, ["g"], "w", "n"), otherwise={"s": "", "n": 0})
    assert {(r["g"], r["count"], r["s"], r["n"]) for r in out.collect()} == {(None, 2, "a", 2), ("k", 3, "c", 2), ("m", 1, "", 0)}


def test_sketched_percentiles_are_close(spark):
    """The default percentiles are off by a ten-thousandth of the ranks at most."""
    from tracelake.functions.quantiles import quantile

    n = 200_000
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000).alias("x"))
    values = sorted(r["x"] for r in df.collect())
    row = df.agg(*[quantile(F.col("x"), p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]).first()
    for p in (0.5, 0.95, 0.99):
        rank = sum(v <= row[f"p{int(p * 100)}"] for v in values)
        assert abs(rank - p * n) <= 2 * n / 10_000 + 1


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    schema = "timestamp timestamp_ntz, body string, severity_text string"
    batches = [[(0, "a"), (90, "b")], [(95, "c")], [(5, "late"), (300, "d")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame([(T0 + dt.timedelta(minutes=m), b, "INFO") for m, b in batch], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_log_patterns(rows, F.col("body")).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["pattern_signature"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a", "b", "c"}


def test_remedies_are_ordered_by_risk_and_effort(spark):
    found = spark.createDataFrame([(1, "memory,storage")], "k int, categories string")
    actions = spark.createDataFrame([("memory", "x", "high", "low"), ("memory", "y", "low", "high"), ("storage", "z", "low", "low"), ("cpu", "w", "low", "low")], "category string, action string, risk string, effort string")
    assert [(r["action"], r["quick_win"]) for r in logs.suggest_remediation(found, actions, "k").orderBy("rank").collect()] == [("z", True), ("y", False), ("x", False)]
