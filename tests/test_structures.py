"""Pointer doubling, covered chains, templates, substring indexes, range vectors and closures against plain Python."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.functions import quantiles
from tracelake.operators import cluster, correlate, graph, logs, metrics, rollup, traces, tree
from tracelake.schema import SPAN_SCHEMA
from tracelake.sources import readers

T0 = dt.datetime(2024, 1, 1)


def span(trace, sid, parent, name="n", start=0, end=10, service="a", kind=2):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    return (trace, sid, parent, name, kind, at(start), at(end), int((end - start) * 1_000_000), (1, None), {}, ({"service.name": service},), [], [], ("lib", "1", None))


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SPAN_SCHEMA)


# trees


def test_a_trace_is_walked_alike_whatever_else_the_table_holds(make):
    twice = [span("A", "r", None), span("A", "x", "r"), span("A", "y", "x"), span("A", "x", "y"), span("A", "z", "x"), span("A", "w", "z")]
    deep = [span("B", f"b{k}", f"b{k - 1}" if k else None) for k in range(12)]
    of_a = lambda df: sorted(tuple(r) for r in tree.depths(df).filter("trace_id = 'A'").collect())
    alone = of_a(make(*twice))
    assert alone == of_a(make(*twice, *deep)) == [("A", "r", 0), ("A", "w", 3), ("A", "x", 1), ("A", "y", 2), ("A", "z", 2)]


def test_a_chain_of_a_thousand_takes_ten_rounds(make):
    df = make(*[span("t", f"s{k:04}", f"s{k - 1:04}" if k else None) for k in range(1000)], span("u", "r", None))
    found = tree.lineage(df)
    assert len(found.jumps) <= 11
    assert {(r["trace_id"], r["span_id"]): r["depth"] for r in found.spans.collect()} == {("u", "r"): 0, **{("t", f"s{k:04}"): k for k in range(1000)}}
    up = found.ancestors(df.filter("span_id = 's0700'").select("trace_id", F.col("span_id").alias("node")))
    assert sorted(r["span_id"] for r in up.collect()) == [f"s{k:04}" for k in range(701)]


def test_circles_and_spans_without_an_id(make):
    df = make(span("t", "r", None), span("t", None, "r"), span("t", None, "gone"), span("t", "a", "b"), span("t", "b", "a"), span("t", "c", "b"), span("t", "o", "gone"))
    assert sorted(((r["span_id"] or "", r["depth"]) for r in tree.depths(df).collect())) == [("", 0), ("", 1), ("o", 0), ("r", 0)]
    assert tree.depths(df.limit(0)).count() == 0


def test_blocking_equals_a_walk_down_every_branch(make):
    r = random.Random(4)
    rows = []
    for t in range(30):
        for k in range(r.randint(1, 25)):
            start = r.randint(0, 200)
            rows.append(span(f"t{t}", f"s{k}", None if not k else f"s{r.randrange(k)}" if r.random() < 0.95 else "gone", f"n{k}", start, start + r.randint(1, 100)))
    df = make(*rows)
    own = {(x["trace_id"], x["span_id"]): x for x in tree.self_times(df).collect()}
    children = defaultdict(list)
    for x in own.values():
        if (x["trace_id"], x["parent_span_id"]) in own:
            children[x["trace_id"], x["parent_span_id"]].append(x)

    def paths(x, weight, sofar, path):
        sofar, path = sofar + weight * x["self_ms"], [*path, x["span_id"]]
        yield (-round(sofar, 9), len(path), x["start_ms"], x["span_id"]), path, sofar
        for c in children[x["trace_id"], x["span_id"]]:
            yield from paths(c, weight * (0.5 if x["end_ms"] - c["end_ms"] > tree.EARLY_END_MS else 1), sofar, path)

    got = {(x["trace_id"], x["root_span_id"]): ([p["span_id"] for p in x["critical_path"]], x["total_critical_ms"]) for x in tree.critical_path_blocking(df).collect()}
    roots = [x for x in own.values() if (x["trace_id"], x["parent_span_id"]) not in own]
    assert len(got) == len(roots)
    for x in roots:
        _, path, sofar = min(paths(x, 1.0, 0.0, []))
        assert got[x["trace_id"], x["span_id"]] == (path, pytest.approx(sofar))


def plain_cascades(rows, threshold):
    by_id = {(x[0], x[1]): x for x in rows}
    chains = []
    for x in rows:
        ms, names, total, at = x[7] / 1e6, [], 0.0, x
        while at is not None:
            if at[7] / 1e6 >= threshold:
                names, total = [*names, at[3]], total + at[7] / 1e6
            at = by_id.get((at[0], at[2]))
        if ms >= threshold and len(names) >= 2:
            chains.append((x[0], x[1], names, total))
    covered = lambda a: any(b[0] == a[0] and (len(b[2]) > len(a[2]) or len(b[2]) == len(a[2]) and b[1] < a[1]) and set(a[2]) <= set(b[2]) for b in chains)
    return sorted((t, len(n), n[0], tuple(n), round(total, 6)) for t, i, n, total in chains if not covered((t, i, n, total)))


def test_cascades_equal_holding_all_chains_against_all(make):
    r = random.Random(8)
    rows = []
    for t in range(40):
        for k in range(r.randint(1, 30)):
            rows.append(span(f"t{t}", f"s{k:02}", f"s{r.randrange(k):02}" if k else None, f"n{r.randrange(6)}", 0, r.choice([5, 20, 30])))
    got = sorted((x["trace_id"], x["chain_length"], x["origin_span"], tuple(x["affected_spans"]), round(x["total_timeout_ms"], 6)) for x in tree.cascading_timeout(make(*rows), 20).collect())
    assert got == plain_cascades(rows, 20) and len(got) > 40


def test_a_trace_of_ten_thousand_timeouts(spark):
    ids = spark.range(10_000).select(F.lit("t").alias("trace_id"), F.format_string("s%05d", "id").alias("span_id"), F.when(F.col("id") == 0, None).when(F.col("id") <= 50, F.lit("s00000")).otherwise(F.format_string("s%05d", F.col("id") % 50 + 1)).alias("parent_span_id"), F.concat(F.lit("call "), F.col("id") % 97).alias("name"))
    df = ids.withColumn("duration_nano", F.lit(2_000_000_000)).withColumn("attributes", F.create_map(F.lit("a"), F.lit("b")))
    rows = tree.cascading_timeout(df).collect()
    sets = [frozenset(r["affected_spans"]) for r in rows]
    assert len(rows) == len(set(sets)) and all(r["chain_length"] == 3 for r in rows)


# templates


def mined(spark, messages, **options):
    return {r["template"]: r["count"] for r in logs.template_patterns(spark.createDataFrame([(m, "INFO", T0) for m in messages], "message string, severity string, timestamp timestamp_ntz"), **options).collect()}


def test_like_messages_are_one_template_whatever_stands_beside_them(spark):
    r = random.Random(2)
    like = [f"user {n} logged in from host {n}" for n in ("".join(r.choices("abcdef", k=6)) for _ in range(30))]
    other = ["user ann " + " ".join("".join(r.choices("ghijkl", k=7)) for _ in range(5)) for _ in range(30)]
    like = [m.replace("user ", "user ann ", 1).replace(" from", "", 1) for m in like]
    got = mined(spark, like + other)
    assert got["user ann <*> logged in host <*>"] == 30 and len(got) == 31
    shuffled = like + other
    r.shuffle(shuffled)
    assert mined(spark, shuffled) == got


def test_messages_that_begin_differently_are_one_template_if_there_are_many(spark):
    said = [f"{n} connected to database shard {k}" for k, n in enumerate(["ann", "bob", "cy", "dee", "eva", "fay", "gus", "hal", "ivo", "jan", "kim", "leo"])]
    assert mined(spark, said) == {"<*> connected to database shard <*>": 12}
    assert len(mined(spark, said[:9])) == 9
    assert mined(spark, said[:3], many=2) == {"<*> connected to database shard <*>": 3}


def test_every_template_keeps_its_share_of_each_message(spark):
    r = random.Random(6)
    words = [f"w{chr(97 + k)}" for k in range(12)]
    said = [" ".join(r.choices(words, [9, 7, 5, 3, 2, 1, 1, 1, 1, 1, 1, 1], k=r.randint(1, 7))) for _ in range(400)] + [None, "", " "]
    df = spark.createDataFrame([(m,) for m in set(said) if m is not None], "m string")
    for x in logs.message_templates(df).collect():
        tokens, kept = x["m"].split(), x["template"].split()
        assert len(tokens) == len(kept) and all(b in (a, "<*>") for a, b in zip(tokens, kept))
        assert sum(a == b for a, b in zip(tokens, kept)) >= 0.4 * len(tokens)
    assert sum(mined(spark, said).values()) == len(said)


# substrings


def test_containments_equal_looking_into_every_text(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choices("aab%_.é", k=n))
    needles = [(k, text(r.randint(0, 5))) for k in range(80)] + [(200, None), (201, "zzz")]
    texts = [(k, text(r.randint(0, 9))) for k in range(120)] + [(500, None)]
    got = logs.containments(spark.createDataFrame(needles, "needle_id int, needle string"), spark.createDataFrame(texts, "text_id int, text string")).collect()
    assert {(x["needle_id"], x["text_id"]) for x in got} == {(a, b) for a, n in needles for b, t in texts if n and t is not None and n in t} and len(got) == len(set(got))


def test_similar_incidents_without_a_limit(spark):
    patterns = spark.createDataFrame([("1", "disk full on node"), ("2", "Pool"), ("3", "slow query seen"), ("4", ""), ("5", None)], "pattern_id string, template string")
    known = spark.createDataFrame([("a", "DISK FULL", "t", "r", "svc-x", "2024"), ("b", "the pool is exhausted", "t", "r", "svc-y", "2023"), ("c", "zz", "Very slow things", None, "svc-y", "2024"), ("d", "", None, "a slow query", "q", "2024")], "incident_id string, pattern string, title string, root_cause string, service string, date string")
    pairs = lambda **o: {(r["pattern_id"], r["incident_id"], r["match"]) for r in logs.similar_incidents(patterns, known, **o).collect()}
    assert pairs() == {("1", "a", "pattern"), ("2", "b", "pattern"), ("3", "c", "word"), ("3", "d", "word")}
    assert pairs(service="X") == {("1", "a", "pattern"), ("3", "c", "word"), ("3", "d", "word")}
    assert pairs(since="2024") == {("1", "a", "pattern"), ("3", "c", "word"), ("3", "d", "word")}


# range vectors


def series(spark, r, n=300):
    rows, value = [], {}
    for k in range(n):
        key = r.choice("ab")
        value[key] = 0.0 if r.random() < 0.05 else value.get(key, 5.0) + r.randint(0, 9)
        rows.append((key, T0 + dt.timedelta(seconds=r.choice([0, 17, 60, 300]) + 97 * k), value[key], k))
    return rows, spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double, n int")


def test_range_rates_equal_a_look_at_every_window(spark):
    rows, df = series(spark, random.Random(3))
    step, window = 60, 600
    want = {}
    for key in "ab":
        own = sorted((x[1], x[3], x[2]) for x in rows if x[0] == key)
        last = int((own[-1][0] - T0).total_seconds()) // step + window // step + 2
        for c in range(last):
            at = T0 + dt.timedelta(seconds=c * step)
            inside = [v for t, _, v in own if at - dt.timedelta(seconds=window) < t <= at]
            if len(inside) > 1:
                want[key, at] = sum(b if b < a else b - a for a, b in zip(inside, inside[1:]))
    got = {(x["k"], x["at"]): x["increase"] for x in metrics.range_rates(df, ["k"], step, window, ("ts", "n")).collect()}
    assert {k: v for k, v in got.items() if k in want} == want and set(want) == set(got)
    with pytest.raises(ValueError):
        metrics.range_rates(df, ["k"], 60, 90)


def test_points_before_are_found_across_chunks(spark):
    rows, df = series(spark, random.Random(5), 200)
    got = {x["n"]: (x["old_ts"], x["old_value"]) for x in metrics.with_previous(df, ["k"], ("ts", "n"), chunk_seconds=1000).collect()}
    for key in "ab":
        own = sorted((x[1], x[3], x[2]) for x in rows if x[0] == key)
        assert got[own[0][1]] == (None, None)
        assert all(got[b[1]] == (a[0], a[2]) for a, b in zip(own, own[1:]))


def test_range_gauges_and_sums(spark):
    rows, df = series(spark, random.Random(7), 100)
    for x in metrics.range_gauges(df, ["k"], 60, 180).collect():
        inside = [(p[1], p[2]) for p in rows if p[0] == x["k"] and x["at"] - dt.timedelta(seconds=180) < p[1] <= x["at"]]
        values = [v for _, v in inside]
        assert (x["n"], x["min"], x["max"], x["last"]) == (len(values), min(values), max(values), max(inside)[1]) and x["avg"] == pytest.approx(sum(values) / len(values))
    rates = spark.createDataFrame([("a", "1", T0, 1.0), ("a", "2", T0, 2.5), ("b", "1", T0, 4.0)], "l string, s string, at timestamp_ntz, rate double")
    assert {(x["l"], x["rate"], x["series"]) for x in metrics.sum_by(rates, ["l"]).collect()} == {("a", 3.5, 2), ("b", 4.0, 1)}


def test_error_events_end_at_as_of_and_begin_at_errors(spark):
    row = lambda h, s: (T0 + dt.timedelta(hours=h), s, ("m",), ({"service.name": "a"},))
    df = spark.createDataFrame([row(0, "ERROR"), row(5, "CRITICAL"), row(6, "WARN"), row(7, "ERROR2"), row(30, "ERROR"), row(31, "FATAL")], "timestamp timestamp_ntz, severity_text string, body struct<string_value:string>, resource struct<attributes:map<string,string>>")
    got = sorted(x["event_time"] for x in readers.error_events(df, "2024-01-01 08:00:00", 4 * 60).collect())
    assert got == [T0 + dt.timedelta(hours=5), T0 + dt.timedelta(hours=7)]


# closures


def test_closure_of_a_dense_graph(spark):
    r = random.Random(9)
    edges = {(f"v{r.randrange(300):03}", f"v{r.randrange(300):03}") for _ in range(6000)}
    pairs = spark.createDataFrame([(a, b, 1) for a, b in edges if a != b], "source string, target string, calls long")
    start = spark.createDataFrame([("v000",), ("v001",)], "origin string")
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    want = Counter()
    for origin in ("v000", "v001"):
        seen, level = {origin}, {origin}
        for k in (1, 2, 3):
            level = {y for x in level for y in out[x]} - seen
            seen |= level
            want.update({(origin, y, k): 1 for y in level})
    assert Counter(map(tuple, graph.closure(pairs, start, 3).collect())) == want


# percentiles


def test_percentiles_of_large_groups_are_exact(spark):
    r = random.Random(11)
    rows = [("big", r.choice([r.gauss(0, 1), round(r.gauss(0, 1), 1)])) for _ in range(120_000)] + [("ties", float(k % 3)) for k in range(120_001)] + [("middle", r.random()) for _ in range(9_999)]
    rows += [("small", float(k)) for k in range(17)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = (0.0, 0.01, 0.5, 0.9, 0.95, 0.99, 0.999, 1.0)
    median = {x["k"]: (x["f"], x["c"]) for x in quantiles.percentiles(df.filter("k <> 'big' and k <> 'ties'"), ["k"], "v", {"f": 0.95}, {"c": 0.5}).collect()}
    got = quantiles.percentiles(df, ["k"], "v", {f"f{p}": p for p in shares}, {f"c{p}": p for p in shares}, {f"d{p}": p for p in shares}).collect()
    assert {x["k"] for x in got} == {"big", "ties", "middle", "small", "one", None}
    for x in got:
        v = sorted(b for a, b in rows if a == x["k"] and b is not None)
        n = len(v)
        for p in shares:
            at = p * (n - 1)
            assert x[f"f{p}"] == v[min(int(n * p), n - 1)] and x[f"d{p}"] == v[max(math.ceil(n * p), 1) - 1]
            assert x[f"c{p}"] == pytest.approx(v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at)))
    assert all(median[x["k"]] == (x["f0.95"], pytest.approx(x["c0.5"])) for x in got if x["k"] in ("middle", "small", "one"))
    whole = quantiles.percentiles(df, [], "v", discrete={"p": 0.5}).first()["p"]
    assert whole == sorted(b for _, b in rows if b is not None)[math.ceil((len(rows) - 1) / 2) - 1]


def test_sketches_and_exact_percentiles_agree_within_the_bound(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    picks = {"p50": ("v", 0.5), "p95": ("v", 0.95)}
    a, b = ({x["k"]: x for x in quantiles.summarise(df, ["k"], [F.count("*").alias("n")], picks, exact=e).collect()} for e in (False, True))
    for k in a:
        assert a[k]["n"] == b[k]["n"] and all(abs(a[k][p] - b[k][p]) <= 50_000 * 2 / quantiles.ACCURACY for p in picks)


# ranges, rollups, layout, baselines


def test_ranges_of_any_length_go_to_two_buckets(spark):
    r = random.Random(12)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    points = [(r.choice("ab"), at(r.uniform(0, 1e6)), k) for k in range(400)]
    ranges = [("a", at(x), at(x + r.choice([0, 1, 50, 3_000, 400_000, 2_000_000])), k) for k, x in enumerate(r.uniform(-1e5, 1e6) for _ in range(200))] + [("a", at(5), at(1), 900), ("a", None, at(1), 901)]
    p, q = spark.createDataFrame(points, "k string, ts timestamp_ntz, p int"), spark.createDataFrame(ranges, "k string, x timestamp_ntz, y timestamp_ntz, r int")
    joined = correlate.range_join(p, "ts", q, "x", "y", ["k"], 10)
    got = Counter((x["p"], x["r"]) for x in joined.collect())
    assert got == Counter((i, j) for k, t, i in points for m, x, y, j in ranges if k == m and x is not None and x <= t <= y)
    assert correlate.range_join(p, "ts", q.limit(0), "x", "y", ["k"], 10).count() == 0


def test_percentiles_from_merged_buckets_are_within_the_bound(spark):
    n = 60_000
    ms = (F.pmod(F.col("id") * 7919, F.lit(n))).cast("double")
    df = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id") % 1000).alias("trace_id"), F.lit(None).cast("string").alias("parent_span_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 48).cast("int"))).alias("start_time"),
        (ms * 1_000_000).cast("long").alias("duration_nano"), F.struct(F.when(F.col("id") % 4 == 0, 2).otherwise(1).alias("code")).alias("status"), F.struct(F.create_map(F.lit("service.name"), F.lit("a")).alias("attributes")).alias("resource"),
    )
    parts = rollup.rollup(df)
    assert parts.count() == 48
    row = rollup.metrics(parts, "2024-01-03 00:00:00", 48).first()
    assert (row["request_count"], row["error_count"], row["error_rate_pct"], row["max_ms"]) == (n, n // 4, 25.0, n - 1.0)
    for name, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        assert abs(row[name] - p * n) <= rollup.RANK_ERROR * n
    assert abs(row["traces_estimate"] - 1000) < 100
    day = rollup.metrics(parts, "2024-01-02 00:00:00", 12).first()
    assert day["request_count"] == n // 4
    trend = rollup.trend_changes(parts, "2024-01-03 00:00:00", 48, "p95", bucket_hours=6).collect()
    assert len(trend) == 8 and all(abs(x["value"] - 0.95 * n) <= 2 * rollup.RANK_ERROR * n + 100 for x in trend)
    both = {x["period"]: x for x in rollup.compare_periods(parts, "2024-01-03 00:00:00", (48, 24), (24, 0)).collect()}
    assert both["baseline"]["p95_delta_ms"] is None and both["anomaly"]["error_rate_delta"] == 0
    with pytest.raises(ValueError):
        rollup.metrics(parts, "2024-01-03 00:30:00", 48)
    with pytest.raises(ValueError):
        rollup.trend_changes(parts, "2024-01-03 00:00:00", 48, rollup_hours=4, bucket_hours=6)


def test_written_spans_are_pruned_by_day_and_joined_without_an_exchange(spark, make):
    spark.sql("DROP TABLE IF EXISTS laid_out_spans")
    rows = [span(f"t{k % 40}", f"s{k}", None, "n", 86_400_000 * (k % 3), 86_400_000 * (k % 3) + 5) for k in range(400)]
    readers.write_spans(make(*rows), "laid_out_spans", 4)
    table = spark.table("laid_out_spans")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(table.groupBy("trace_id").count())
    a, b = table.select("trace_id", "span_id"), table.select("trace_id", F.col("span_id").alias("other"))
    assert "Exchange" not in plan(a.hint("merge").join(b, "trace_id"))
    day = readers.spans_between(spark, "laid_out_spans", "2024-01-02 00:00:00", "2024-01-02 12:00:00")
    assert "PartitionFilters: [isnotnull(start_date" in plan(day) and "2024-01-02" in plan(day)
    assert sorted(x["span_id"] for x in day.collect()) == sorted(f"s{k}" for k in range(400) if k % 3 == 1)
    assert sorted(tuple(x) for x in table.drop("start_date").select("trace_id", "span_id").collect()) == sorted((x[0], x[1]) for x in rows)
    spark.sql("DROP TABLE laid_out_spans")


def test_a_target_is_no_part_of_its_baseline(spark, make):
    rows = [span(f"b{k}", f"b{k}r", None, "call", 0, 100 + k % 2) for k in range(4)] + [span("t", "tr", None, "call", 0, 400), span("t", "tc", "tr", "new", 0, 90)]
    rows += [span("u", "ur", None, "call", 0, 100), span("v", "vr", None, "same", 0, 60), span("w", "wr", None, "same", 0, 70)]
    sets = spark.createDataFrame([("t", f"b{k}") for k in range(4)] + [("t", "t"), ("t", "b0"), ("u", "b0"), ("w", "v"), ("x", "b0")], "target_trace_id string, baseline_trace_id string")
    got = {(x["target_trace_id"], x["level"], x["name"]): x for x in traces.anomalies_against_baselines(make(*rows), sets).collect()}
    assert set(got) == {("t", "trace", None), ("t", "span", "call"), ("u", "trace", None), ("w", "trace", None), ("w", "span", "same")}
    assert got["t", "trace", None]["is_anomaly"] and got["t", "trace", None]["z_score"] == pytest.approx((400 - 100.5) / (1 / 3) ** 0.5, abs=0.01)
    assert not got["u", "trace", None]["is_anomaly"] and got["w", "trace", None]["z_score"] == 100.0 and got["w", "span", "same"]["anomaly_type"] == "slow"


def test_disks_by_used_and_total_and_one_verdict_on_memory(spark):
    points = spark.createDataFrame([("n", "disk_used", T0, 50.0), ("n", "disk_used", T0 + dt.timedelta(hours=1), 96.0), ("n", "disk_total", T0, 100.0), ("m", "disk_used", T0, 9.0), ("m", "cpu", T0, 0.9), ("k", "disk_total", T0, 0.0), ("k", "disk_used", T0, 1.0)], "node string, metric string, ts timestamp_ntz, value double")
    assert {(x["node"], x["condition"], x["severity"]) for x in cluster.node_conditions(points).collect()} == {("n", "DISK_PRESSURE", "CRITICAL"), ("m", "CPU_PRESSURE", "WARNING")}
    logs_of = spark.createDataFrame([(T0, "pod was OOMKilled", ({"pod_name": "p"},))], "timestamp timestamp_ntz, body string, resource struct<attributes:map<string,string>>")
    pods = spark.createDataFrame([("a", "p", "c", 0.9)], "namespace string, pod string, container string, value double")
    report = lambda logs, points: cluster.oom_report(logs, F.col("body"), points).first()["severity"]
    assert (report(logs_of, pods), report(logs_of.limit(0), pods), report(logs_of.limit(0), pods.limit(0))) == ("CRITICAL", "WARNING", "NORMAL")


def test_edges_inside_strongly_connected_components(spark):
    r = random.Random(14)
    for n, m in ((12, 20), (30, 40), (8, 30), (40, 30)):
        edges = {(f"v{r.randrange(n):02}", f"v{r.randrange(n):02}") for _ in range(m)}
        edges = {(a, b) for a, b in edges if a != b}
        out = defaultdict(set)
        for a, b in edges:
            out[a].add(b)

        def reach(a):
            seen, todo = set(), [a]
            while todo:
                for y in out[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            return seen

        got = [tuple(x) for x in graph._inside_components(spark.createDataFrame(sorted(edges), "source string, target string")).collect()]
        assert sorted(got) == sorted((a, b) for a, b in edges if a in reach(b))


def test_places_of_equal_values_are_told_by_the_tie(spark):
    r = random.Random(15)
    rows = [(r.choice(["a", None]), r.randrange(6), f"{k:03}") for k in range(200)] + [("a", None, "x")]
    got = {(x["k"], x["t"]): (x["_place"], x["_all"]) for x in quantiles.ranked(spark.createDataFrame(rows, "k string, v int, t string"), ["k"], "v", "t").collect()}
    for key in ("a", None):
        own = sorted((v, t) for k, v, t in rows if k == key and v is not None)
        assert [got[key, t] for _, t in own] == [(i + 1, len(own)) for i in range(len(own))]
    assert len(got) == 200
