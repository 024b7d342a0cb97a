"""What operators move must grow with their input, not with the pairs or sizes of groups in it."""

import datetime

from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.operators import correlate as X


def shuffled(spark, df):
    """(rows, shuffled records) of a DataFrame that is run here; ``df`` is a function, since operators also run jobs of their own."""
    gateway = spark.sparkContext._gateway

    def records():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = records()
    rows = df().collect()
    return rows, sum(n for k, n in records().items() if k not in before)


def _crowd(spark, traces=400, logs=1500):
    """Traces and troubled logs of one service in one hour: every log is around every trace. Every third log belongs to a trace, one
    trace has forty of the first ones, one two roots."""
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    spans = [(f"t{i}", f"s{i}", None, at(i % 60), at(i % 60 + 1), "a") for i in range(traces)] + [("t7", "again", None, at(0), at(30), "a"), ("t8", "other", None, at(0), at(30), "b")]
    rows = [(f"i{i:05d}", at(i % 700 - 100), "ERROR" if i % 5 else "INFO", "b" if i % 11 == 0 else "a", "t3" if i % 700 < 60 else f"t{i % traces}" if i % 3 == 0 else None) for i in range(logs)]
    s = spark.createDataFrame(spans, "trace_id string, span_id string, parent_span_id string, start_time timestamp_ntz, end_time timestamp_ntz, service string").select(
        "*", F.lit("n").alias("name"), F.lit(2).alias("kind"), F.lit(1000).cast("long").alias("duration_nano"), F.struct(F.lit(1).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"),
        F.create_map().cast("map<string,string>").alias("attributes"), F.struct(F.create_map(F.lit("service.name"), "service").alias("attributes")).alias("resource"),
    )
    l = spark.createDataFrame(rows, "insert_id string, timestamp timestamp_ntz, severity_text string, service string, trace_id string").withColumn("span_id", F.lit(None).cast("string")).withColumn("body", F.struct(F.lit("x").alias("string_value")))
    return spans, rows, s, l


def _first(spans, rows, n, seconds):
    """Nearby logs by brute force."""
    out = []
    by_trace = {}
    for trace, _, _, a, b, service in spans:
        by_trace.setdefault(trace, []).append((a, b, service))
    pad = datetime.timedelta(seconds=seconds)
    for trace, ranges in by_trace.items():
        met = [(ts, i) for a, b, service in ranges for i, ts, severity, of, own in rows if of == service and severity == "ERROR" and own != trace and a - pad <= ts <= b + pad]
        out += [(trace, i) for _, i in sorted(met)[:n]]
    return sorted(out)


def test_nearby_logs_of_a_crowd_are_not_all_paired(spark):
    spans, rows, s, l = _crowd(spark)
    got, moved = shuffled(spark, lambda: X.logs_for_traces_direct_and_nearby(s, l, F.col("service"), 3600))
    assert sorted((r["trace_id"], r["insert_id"]) for r in got if r["correlation"] == "nearby") == _first(spans, rows, 20, 3600)
    assert moved < 20 * (len(spans) + len(rows)), moved


def test_nearby_logs_of_short_ranges(spark):
    spans, rows, s, l = _crowd(spark, 60, 900)
    for seconds in (0, 2, 40):
        got = X.logs_for_traces_direct_and_nearby(s, l, F.col("service"), seconds).filter("correlation = 'nearby'").collect()
        assert sorted((r["trace_id"], r["insert_id"]) for r in got) == _first(spans, rows, 20, seconds)


def test_nearby_logs_of_roots_without_a_trace(spark):
    _, rows, s, l = _crowd(spark, 3, 900)
    got = X.logs_for_traces_direct_and_nearby(s.withColumn("trace_id", F.lit(None).cast("string")), l, F.col("service"), 2).collect()
    pad = datetime.timedelta(seconds=2)
    met = [(r[1], r[0]) for a, b, of in [(r["start_time"], r["end_time"], r["service"]) for r in s.collect()] for r in rows if r[3] == of and r[2] == "ERROR" and r[4] is None and a - pad <= r[1] <= b + pad]
    assert sorted(r["insert_id"] for r in got) == sorted(i for _, i in sorted(met)[:20])


def test_timeline_of_a_crowd_moves_no_pairs(spark):
    spans, rows, s, l = _crowd(spark)
    got, moved = shuffled(spark, lambda: X.cross_signal_timeline(s, l, F.col("service"), 3600))
    whole = {}
    for trace, _, _, a, b, service in spans:
        lo, hi, services = whole.get(trace, (a, b, set()))
        whole[trace] = (min(lo, a), max(hi, b), services | {service})
    ranges = [(trace, None, None, a, b, service) for trace, (a, b, services) in whole.items() for service in services]
    assert sorted((r["trace_id"], r["event_id"]) for r in got if r["event_type"] == "LOG_TEMPORAL") == _first(ranges, rows, 50, 3600)
    assert all(r["relative_time_ms"] == round((r["event_time"] - whole[r["trace_id"]][0]).total_seconds() * 1000, 3) for r in got)
    assert moved < 20 * (len(spans) + len(rows)), moved


def test_templates_do_not_move_a_message_with_each_of_its_tokens(spark):
    import random

    from tracelake.operators import logs as L

    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(10))
    common = [word() for _ in range(400)]
    messages = [" ".join(["run", "of", *[w if r.random() < 0.8 else word() for w in common]]) for _ in range(120)]
    df = spark.createDataFrame([(m, "INFO", datetime.datetime(2024, 1, 1)) for m in messages], "message string, severity string, timestamp timestamp_ntz")
    gateway = spark.sparkContext._gateway

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = moved()
    got = L.template_patterns(df).collect()
    size = sum(n for k, n in moved().items() if k not in before)
    assert sum(x["count"] for x in got) == len(messages)
    assert size < 20 * sum(map(len, messages)), size / sum(map(len, messages))


def _points(spark, traces=300, points=1200):
    """Error traces and points of two services in two hours, most points around every trace; some traces are long, some points lack a
    value or are not a number, and one is very large."""
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    spans = [(f"t{i}", f"s{i}", at(i * 7 % 3600), at(i * 7 % 3600 + (9000 if i % 50 == 0 else 1)), "ab"[i % 2]) for i in range(traces)]
    rows = [(("x_latency", "x_total", "x", None)[i % 4], "ab"[i // 4 % 2], at(i * 5 % 7200 + i / 1e6), None if i % 37 == 0 else float("nan") if i == 700 else 1e18 if i == 750 else (i * 7919 % 1000) / 8) for i in range(points)]
    s = spark.createDataFrame(spans, "trace_id string, span_id string, start_time timestamp_ntz, end_time timestamp_ntz, service string").withColumn("resource", F.struct(F.create_map(F.lit("service.name"), "service").alias("attributes")))
    p = spark.createDataFrame(rows, "metric_type string, service string, ts timestamp_ntz, value double")
    return spans, rows, s, p


def _kinds_of(spans, rows, seconds):
    """metric_kinds_during_trace and metrics_during_trace by brute force."""
    import math

    pad, grown, last = datetime.timedelta(seconds=seconds), {}, {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k][2]):
        m, of, _, v = rows[k]
        old = last.get((m, of))
        grown[k] = 0.0 if old is None else None if v is None else v if v < old and not math.isnan(v) else v - old
        last[m, of] = v
    kinds, plain = {}, {}
    for trace, _, a, b, service in spans:
        for m in ("x_latency", "x_total", "x", None):
            met = [k for k, (x, of, ts, _) in enumerate(rows) if x == m and of == service and a - pad <= ts <= b + pad]
            if not met:
                continue
            values = sorted((rows[k][3] for k in met if rows[k][3] is not None), key=lambda v: (math.isnan(v), v))
            grew, n, mean = [grown[k] for k in met if grown[k] is not None], len(values), sum(values) / len(values) if values else None
            kind = "histogram" if m == "x_latency" else "counter" if m == "x_total" else "gauge"
            value = mean if kind == "gauge" else (values[max(math.ceil(n * 0.95) - 1, 0)] if values else None) if kind == "histogram" else sum(grew) / ((b - a).total_seconds() + 2 * seconds) if grew else None
            kinds[trace, m] = (kind, len(met), value)
            plain[trace, m] = (len(met), mean, values[0] if values else None, values[-1] if values else None)
    return kinds, plain


def _close(a, b):
    return a == b or a is not None and b is not None and (a != a and b != b or abs(a - b) <= 1e-4 + 1e-12 * abs(b))


def test_metrics_around_a_crowd_are_not_all_paired(spark, monkeypatch):
    spans, rows, s, p = _points(spark)
    for seconds in (0, 30, 3600):
        kinds, plain = _kinds_of(spans, rows, seconds)
        for held, asked in ((X.HELD, X.ASKED), (40, 30)) if seconds == 3600 else ((X.HELD, X.ASKED),):
            monkeypatch.setattr(X, "HELD", held)
            monkeypatch.setattr(X, "ASKED", asked)
            got, moved = shuffled(spark, lambda: X.metric_kinds_during_trace(s, p, F.col("service"), seconds, exact=True))
            assert {(r["trace_id"], r["metric_type"]) for r in got} == set(kinds) and len(got) == len(kinds)
            for r in got:
                kind, n, value = kinds[r["trace_id"], r["metric_type"]]
                assert (r["kind"], r["points"]) == (kind, n) and _close(r["value"], value), (r, value)
            if held == X.HELD > 40:
                assert moved < 20 * (len(spans) + len(rows) + len(got)), moved
        got = X.metrics_during_trace(s, p, F.col("service"), seconds).collect()
        assert len(got) == len(plain)
        for r in got:
            n, *facts = plain[r["trace_id"], r["metric_type"]]
            assert r["points"] == n and all(map(_close, (r["avg_value"], r["min_value"], r["max_value"]), facts)), (r, facts)


def test_low_trees_are_moved_once(spark):
    from tracelake.operators import tree as T

    n = 3000
    rows = spark.range(n * 5).select(F.concat(F.lit("t"), F.expr("id div 5")).alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") % 5 > 0, (F.col("id") - 1).cast("string")).alias("parent_span_id"))
    s = rows.select("*", F.lit("n").alias("name"), F.expr("timestamp_ntz'2024-01-01'").alias("start_time"), F.expr("timestamp_ntz'2024-01-01 00:00:01'").alias("end_time"), F.lit(5_000_000).cast("long").alias("duration_nano"), F.struct(F.lit(1).alias("code")).alias("status"), F.struct(F.create_map(F.lit("service.name"), F.lit("a")).alias("attributes")).alias("resource"))
    got, moved = shuffled(spark, lambda: T.critical_path_longest_child(s))
    assert len(got) == 5 * n and {(r["depth"], r["self_time_ms"]) for r in got} == {(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 5.0)}
    assert moved < 3 * 5 * n, moved


def _pairs_of_traces(spark, traces=60):
    """Random traces, also deep ones, with ids of several spans, without ids and with circles, each compared with the one before."""
    import random

    r, rows = random.Random(9), []
    t0 = datetime.datetime(2024, 1, 1)
    for t in range(traces):
        n = r.randint(1, 20)
        for k in range(n):
            parent = None if not k else f"s{k - 1}" if t % 10 == 3 else f"s{r.randrange(min(k, 4))}" if r.random() < 0.95 else "gone"
            start, long = r.randint(0, 200), r.randint(-3, 300)
            sid = None if t % 10 == 4 and k % 5 == 4 else "s1" if t % 10 == 5 and k == 7 else f"s{k}"
            parent = f"s{n - 1}" if t % 10 == 6 and k == 2 else parent
            end = None if t % 10 == 7 and k == 3 else t0 + datetime.timedelta(milliseconds=start + long)
            rows.append((f"t{t}", sid, parent, f"n{r.randrange(5)}", t0 + datetime.timedelta(milliseconds=start), end, None if end is None else long * 1_000_000, f"v{k % 3}"))
    s = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, start_time timestamp_ntz, end_time timestamp_ntz, duration_nano long, service string").select(
        "*", F.struct(F.lit(1).alias("code")).alias("status"), F.create_map().cast("map<string,string>").alias("attributes"), F.struct(F.create_map(F.lit("service.name"), "service").alias("attributes")).alias("resource"), F.array().alias("events"), F.array().alias("links"),
    )
    pairs = spark.createDataFrame([(f"t{t - 1}", f"t{t}") for t in range(1, traces)] + [(f"t{t}", "t1") for t in range(2, 9)], "baseline_trace_id string, target_trace_id string")
    return s, pairs


def test_causes_by_windows_equal_those_by_joins(spark):
    from tracelake.operators import tree as T

    s, pairs = _pairs_of_traces(spark)
    near, others = T._slowed_spans(s, pairs)
    left = {r[0] for r in others.collect()}
    joined = T._slowed_by_joins(s, pairs)
    shape = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select("baseline_trace_id", "target_trace_id", "baseline_ms", "span_id", "name", "service_name", "start_time", "ms", "depth", "self_ms").collect()), key=str)
    assert shape(near) == [r for r in shape(joined) if r[1] not in left] and len(shape(near)) > 100
    assert {"t3", "t13"} <= left and len(left) < 40
    whole = T.causal_analysis(s, pairs, limit=10**6)
    assert whole.count() == len(shape(joined))


def test_causes_move_spans_once(spark):
    from tracelake.operators import tree as T

    n = 3000
    rows = spark.range(n * 5).select(F.concat(F.lit("t"), F.expr("id div 5")).alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") % 5 > 0, (F.col("id") - 1 - (F.col("id") % 5 == 4).cast("int")).cast("string")).alias("parent_span_id"), F.concat(F.lit("n"), F.col("id") % 5).alias("name"), (F.col("id") * 10_000_000).alias("duration_nano"))
    s = rows.select("*", F.expr("timestamp_ntz'2024-01-01'").alias("start_time"), F.expr("timestamp_ntz'2024-01-01 00:00:01'").alias("end_time"), F.struct(F.lit(1).alias("code")).alias("status"), F.struct(F.create_map(F.lit("service.name"), F.lit("a")).alias("attributes")).alias("resource"), F.create_map().cast("map<string,string>").alias("attributes"), F.array().alias("events"), F.array().alias("links"))
    pairs = spark.range(1, n).select(F.concat(F.lit("t"), F.col("id") - 1).alias("baseline_trace_id"), F.concat(F.lit("t"), "id").alias("target_trace_id"))
    got, moved = shuffled(spark, lambda: T.causal_analysis(s, pairs.repartition(4), 2))
    assert len(got) == 2 * (n - 1)
    assert moved < 6 * 5 * n, moved / (5 * n)


def test_paths_of_blocking_time_by_windows_equal_those_by_joins(spark):
    from tracelake.operators import tree as T

    s, _ = _pairs_of_traces(spark)
    near, high = T._blocking_paths(s)
    left = {r[0] for r in high.collect()}
    shape = lambda df: sorted((r["trace_id"], r["root_id"], round(r["root_ms"] or 0, 6), round(r["blocking"], 6), [(p["span_id"], p["name"], round(p["self_ms"], 6), p["weight"]) for p in r["path"]]) for r in df.collect())
    joined = shape(T._blocking_paths_by_joins(s))
    assert shape(near) == [r for r in joined if r[0] not in left] and len(shape(near)) > 50
    assert {"t3", "t13"} <= left and len(left) < 40
    whole = T.critical_path_blocking(s).collect()
    assert len(whole) == len(joined) and sum(len(r["critical_path"]) for r in whole) == sum(len(r[-1]) for r in joined)


def test_paths_of_blocking_time_move_spans_once(spark):
    from tracelake.operators import tree as T

    n, k = 3000, F.col("id") % 5
    at = lambda ms: F.timestamp_micros(ms * 1000).cast("timestamp_ntz")
    s = spark.range(n * 5).select(
        F.concat(F.lit("t"), F.expr("id div 5")).alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(k > 0, (F.col("id") - 1 - (k == 4).cast("int")).cast("string")).alias("parent_span_id"), F.concat(F.lit("n"), k).alias("name"),
        at(k * 2).alias("start_time"), at(F.lit(20)).alias("end_time"), ((10 - k) * 2_000_000).alias("duration_nano"), F.struct(F.lit(1).alias("code")).alias("status"), F.struct(F.create_map(F.lit("service.name"), F.lit("a")).alias("attributes")).alias("resource"),
    )
    got, moved = shuffled(spark, lambda: T.critical_path_blocking(s))
    assert len(got) == n and {(">".join(p["name"] for p in r["critical_path"]), r["total_critical_ms"]) for r in got} == {("n0>n1>n2>n3", 20.0)}
    assert moved < 2 * 5 * n, moved / (5 * n)


def test_shares_of_paths_move_spans_once(spark, tmp_path):
    import __spark_entry__ as entry

    n = 2000
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(50.0).alias("o_totalprice"), F.expr("timestamp_ntz'2024-01-01'").alias("o_orderdate"), F.lit("1").alias("o_orderpriority"))
    items = spark.range(n * 6).select(F.expr("id div 6").alias("l_orderkey"), (F.col("id") % 6 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 20).alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey"), F.lit(10.0).alias("l_quantity"), F.lit(0.0).alias("l_discount"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    got, moved = shuffled(spark, lambda: entry.queries()["critical_path_contributions"](spark, str(tmp_path)))
    assert len(got) == 4 * n and {(r["trace_id"].replace("t", "o"), r["span_id"][0]) for r in got if r["span_id"][0] == "o"} == {(f"o{k}", "o") for k in range(n)}
    assert moved < 4 * 7 * n, moved / (7 * n)


def test_chains_of_timeouts_move_spans_once(spark):
    from tracelake.operators import tree as T

    n = 2000
    s = spark.range(n * 4).select(F.concat(F.lit("t"), F.expr("id div 4")).alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") % 4 > 0, (F.col("id") - 1).cast("string")).alias("parent_span_id"), F.concat(F.lit("n"), F.col("id") % 4).alias("name"), F.lit(2_000_000_000).cast("long").alias("duration_nano"), F.create_map().cast("map<string,string>").alias("attributes"))
    got, moved = shuffled(spark, lambda: T.cascading_timeout(s))
    assert len(got) == n and all(r["chain_length"] == 4 and r["affected_spans"] == ["n3", "n2", "n1", "n0"] for r in got)
    assert moved < 3 * 4 * n, moved / (4 * n)


def _bytes_moved(spark, df):
    gateway = spark.sparkContext._gateway

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = moved()
    rows = df().collect()
    return rows, sum(n for k, n in moved().items() if k not in before)


def test_triage_of_many_pairs_moves_no_labels(spark, monkeypatch):
    from tracelake.operators import traces as O
    from tracelake.plans import pipelines as P

    s, pairs = _pairs_of_traces(spark, 40)
    long = F.concat_ws("", *[F.md5(F.concat_ws("-", "trace_id", "span_id", "name", "start_time", F.lit(k))) for k in range(40)])
    s = s.withColumn("attributes", F.create_map(F.lit("http.status_code"), F.lit("500"), F.lit("note"), long))
    size = s.count() * 40 * 32
    want = sorted(map(tuple, P.triage_pipeline(s, pairs).collect()), key=str)
    monkeypatch.setattr(O, "FEW", 10, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, moved = _bytes_moved(spark, lambda: P.triage_pipeline(s, pairs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got), key=str) == want and {r[2] for r in want} >= {"error", "structure", "timing_slower"}
    assert moved < size / 2, (moved, size)


def test_shapes_are_those_of_each_trace(spark):
    from tracelake.operators import tree as T

    s, _ = _pairs_of_traces(spark, 40)
    deep = {r[0]: r[1] for r in T.depths(s).groupBy("trace_id").agg(F.max("depth")).collect()}
    names, n = {}, {}
    for r in s.select("trace_id", "name").collect():
        names.setdefault(r[0], set()).add(r[1])
        n[r[0]] = n.get(r[0], 0) + 1
    got = T.shapes(s).collect()
    assert {r["trace_id"]: (set(r["names"]), r["n"], r["depth"]) for r in got} == {t: (names[t], n[t], deep.get(t)) for t in names} and len(got) == len(names)


def test_documents_are_written_compressed(spark):
    from pathlib import Path

    from tracelake.queries import documents as D

    rows = spark.range(2000).select(F.concat(F.lit("t"), "id").alias("trace_id"), F.array_repeat(F.struct(F.lit("GET /orders").alias("name"), F.lit("2024-01-01T00:00:00.000000Z").alias("start_time")), 20).alias("spans"))
    path = D._as_files(rows)
    size = sum(len(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect())
    assert sum(f.stat().st_size for f in Path(path).glob("part-*")) < size / 3
    back = spark.read.schema(rows.schema).json(path)
    assert back.exceptAll(rows).isEmpty() and back.count() == 2000


def _tasks(spark, df):
    """(rows, most tasks of a stage) of a DataFrame that is run here."""
    gateway = spark.sparkContext._gateway

    def tasks():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.numCompleteTasks() for s in (stages.apply(i) for i in range(stages.size()))}

    before = tasks()
    rows = df().collect()
    return rows, max(n for k, n in tasks().items() if k not in before)


def _low_traces(spark, n):
    """n traces of a root, two spans in a chain below it, and two below those."""
    rows = spark.range(n * 5).select(F.concat(F.lit("t"), F.expr("id div 5")).alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") % 5 > 0, (F.col("id") - 1 - (F.col("id") % 5 == 4).cast("int")).cast("string")).alias("parent_span_id"), F.concat(F.lit("n"), F.col("id") % 5).alias("name"), (F.col("id") % 5).alias("k"))
    return rows.select("*", F.expr("timestamp_ntz'2024-01-01'").alias("start_time"), F.expr("timestamp_ntz'2024-01-01 00:00:01'").alias("end_time"), (F.lit(5_000_000) + F.col("k")).alias("duration_nano"), F.struct(F.lit(1).alias("code")).alias("status"), F.struct(F.create_map(F.lit("service.name"), F.lit("a")).alias("attributes")).alias("resource")).drop("k")


def test_timings_are_dealt_by_their_number(spark, monkeypatch):
    from tracelake.functions import groups
    from tracelake.operators import traces as O

    n = 4000
    s = _low_traces(spark, n)
    pairs = spark.range(1, n).select(F.concat(F.lit("t"), F.col("id") - 1).alias("baseline_trace_id"), F.concat(F.lit("t"), "id").alias("target_trace_id"))
    monkeypatch.setattr(groups, "ROWS_A_TASK", 500, raising=False)
    got, most = _tasks(spark, lambda: O.compare_span_timings(s, pairs).groupBy("change").count())
    assert {r["change"]: r["count"] for r in got} == {"same": 5 * (n - 1)}
    assert most >= 5 * n / 500, most


def test_recommendations_move_spans_once(spark):
    from tracelake.operators import tree as T

    n = 3000
    got, moved = shuffled(spark, lambda: T.optimization_recommendations(_low_traces(spark, n)))
    assert len(got) == n and {(r["type"], r["target"]) for r in got} == {("bottleneck", "n4")}
    assert moved < 2.1 * 5 * n, moved / (5 * n)


def test_recommendations_by_windows_equal_those_by_joins(spark):
    from tracelake.operators import tree as T

    s, _ = _pairs_of_traces(spark)
    near, high = T._path_facts(s)
    left = {r[0] for r in high.collect()}
    shape = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select("trace_id", "length", "errors", "bottleneck", "share").collect()), key=str)
    joined = shape(T._path_facts_by_joins(s))
    assert shape(near) == [r for r in joined if r[0] not in left] and len(shape(near)) > 30
    assert {"t3", "t13"} <= left and len(left) < 40
    assert {(r["trace_id"], r["target"]) for r in T.optimization_recommendations(s).collect() if r["type"] == "bottleneck"} == {(r[0], r[3]) for r in joined if (r[4] or 0) > 0}
