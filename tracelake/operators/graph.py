"""The service graph: who calls whom, how well, and what a failure reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.groups import beside, distinct_count, samples
from ..functions.lineage import cut
from ..functions.quantiles import summarise


#: Pairs of services up to which cycles are looked for in all of them: finding components first takes a dozen jobs.
FEW_EDGES = 20_000


def _call_facts() -> list[Column]:
    return [F.count("*").alias("call_count"), F.round(F.avg("ms"), 2).alias("avg_latency_ms"), F.round(F.count_if("is_error") / F.count("*") * 100, 2).alias("error_rate_pct")]


def dependency_edges(spans: DataFrame, min_calls: int = 1, include_external: bool = True, exact: bool = False) -> DataFrame:
    """(source, target, call type) of client spans. A source's weights add up over the edges that min_calls keeps."""
    calls = C.kind_filter(spans, C.CLIENT).select("trace_id", C.service().alias("source_service"), C.target_service().alias("target_service"), C.call_type().alias("call_type"), "name", C.ms().alias("ms"), C.is_error().alias("is_error"))
    calls = calls.filter("source_service is not null and target_service is not null and target_service <> source_service")
    if not include_external:
        calls = calls.filter(~F.col("call_type").isin("DATABASE", "HTTP"))
    keys = ["source_service", "target_service", "call_type"]
    calls = cut(calls)  # latencies, distinct traces and names are three views of the same few columns
    edges = summarise(calls, keys, _call_facts(), {"p95_latency_ms": ("ms", 0.95)}, exact).filter(F.col("call_count") >= min_calls)
    edges = beside(edges, keys, distinct_count(calls, keys, "trace_id", "trace_count"), samples(calls, keys, "name", "sample_operations"), otherwise={"trace_count": 0, "sample_operations": ""})
    weight = F.round(F.col("call_count") / F.sum("call_count").over(Window.partitionBy("source_service")) * 100, 2)
    rate, share = F.col("error_rate_pct"), F.col("dependency_weight_pct")
    return edges.withColumn("dependency_weight_pct", weight).select(
        "*", F.when(rate > 5, "UNHEALTHY").when(rate > 1, "DEGRADED").otherwise("HEALTHY").alias("dependency_health"),
        F.when(share > 50, "CRITICAL").when(share > 20, "HIGH").when(share > 5, "MEDIUM").otherwise("LOW").alias("criticality"),
    )


def service_pairs(spans: DataFrame) -> DataFrame:
    """(source, target, calls): the edges without their types."""
    calls = C.kind_filter(spans, C.CLIENT).select(C.service().alias("source"), C.target_service().alias("target"))
    return calls.filter("source is not null and target is not null and source <> target").groupBy("source", "target").agg(F.count("*").alias("calls"))


def topology_roles(spans: DataFrame) -> DataFrame:
    """Every service as ENTRY_POINT, INTERMEDIATE, LEAF or ISOLATED."""
    pairs = service_pairs(spans)
    services = spans.select(C.service().alias("service_name")).filter("service_name is not null").distinct().union(pairs.select("target")).distinct()
    callers = pairs.select(F.col("source").alias("service_name"), F.lit(True).alias("calls")).distinct()
    callees = pairs.select(F.col("target").alias("service_name"), F.lit(True).alias("called")).distinct()
    role = F.when(F.col("calls") & F.col("called"), "INTERMEDIATE").when(F.col("calls"), "ENTRY_POINT").when(F.col("called"), "LEAF").otherwise("ISOLATED")
    return services.join(callers, "service_name", "left").join(callees, "service_name", "left").select("service_name", role.alias("role"))


def _reach(pairs: DataFrame, start: DataFrame, depth: int, forward: bool) -> DataFrame:
    """Paths from the start services along (or against) the edges, without coming back to a service. The edge table has a
    row for each pair of services, however many calls there are."""
    here, there = ("source", "target") if forward else ("target", "source")
    step = pairs.select(F.col(here).alias("here"), F.col(there).alias("next"), F.col("calls").alias("next_calls"))
    level = start.select("origin", F.col("origin").alias("service_name"), F.array("origin").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("calls"))
    out = []
    for _ in range(depth):
        level = (
            level.join(step, level["service_name"] == step["here"])
            .filter(~F.array_contains("path", F.col("next")))
            .select("origin", F.col("next").alias("service_name"), F.concat("path", F.array("next")).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("next_calls").alias("calls"))
        )
        out.append(level)
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def upstream_downstream(spans: DataFrame, service: str, depth: int = 3) -> DataFrame:
    """Paths of up to ``depth`` calls into and out of a service."""
    pairs = cut(service_pairs(spans))
    start = spans.sparkSession.createDataFrame([(service,)], "origin string")
    parts = []
    for forward, direction, kind in ((False, "UPSTREAM", "CALLER"), (True, "DOWNSTREAM", "DEPENDENCY")):
        near = F.when(F.col("depth") == 1, f"DIRECT_{kind}").otherwise(f"INDIRECT_{kind}")
        parts.append(_reach(pairs, start, depth, forward).select(F.lit(direction).alias("direction"), "service_name", "depth", F.array_join("path", " -> ").alias("path"), "calls", near.alias("relationship")))
    return parts[0].unionByName(parts[1]).orderBy("direction", "depth", F.desc("calls"), "path")


def _inside_components(pairs: DataFrame) -> DataFrame:
    """The edges that lie on a cycle: those whose ends are in one strongly connected component.

    Edges of services that nothing calls or that call nothing are trimmed until none is left. Of the rest each service gets
    the greatest name that reaches it as its colour; from the service of that name, what reaches it back within its colour is
    its component. Components are taken out, and the rest is gone through again.
    """
    left, kept = pairs, []
    while True:
        n = left.count()
        while n:  # trim
            left = cut(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            n, before = left.count(), n
            if n == before:
                break
        if not n:
            break
        colours, changed = cut(left.select(F.col("source").alias("v")).union(left.select("target")).distinct().withColumn("c", F.col("v"))), True
        while changed:
            passed = left.join(colours, left["source"] == colours["v"]).groupBy(F.col("target").alias("t")).agg(F.max("c").alias("up"))
            new = cut(colours.join(passed, colours["v"] == passed["t"], "left").select("v", F.greatest("c", "up").alias("c"), (F.coalesce("up", "c") > F.col("c")).alias("moved")))
            changed, colours = not new.filter("moved").isEmpty(), new.select("v", "c")
        name = lambda x: colours.select(F.col("v").alias(x), F.col("c").alias(f"c_{x}"))
        same = cut(left.join(name("source"), "source").join(name("target"), "target").filter("c_source = c_target").select("source", "target", F.col("c_source").alias("c")))
        member = colours.filter("v = c")
        level = member
        while not level.isEmpty():  # against the edges, from the service that gave the colour its name
            back = same.join(level.select(F.col("v").alias("target"), F.lit(True).alias("hit")), "target").select(F.col("source").alias("v"), "c").distinct()
            level = cut(back.join(member, "v", "left_anti"))
            member = cut(member.unionByName(level))
        own = lambda x: member.select(F.col("v").alias(x), F.col("c").alias(f"c_{x}"))
        kept.append(same.join(own("source"), "source").join(own("target"), "target").select("source", "target"))
        gone = member.select("v")
        left = cut(left.join(gone, left["source"] == gone["v"], "left_anti").join(gone, left["target"] == gone["v"], "left_anti"))
    found = pairs.filter("false").select("source", "target")
    for x in kept:
        found = found.unionByName(x)
    return cut(found)


def circular_dependencies(spans: DataFrame, max_length: int = 4) -> DataFrame:
    """Each directed cycle of two to max_length services once, written from its smallest service on. Of a graph with more than
    FEW_EDGES pairs of services only edges inside a strongly connected component are joined."""
    pairs = cut(service_pairs(spans).select("source", "target"))
    pairs = pairs if pairs.count() <= FEW_EDGES else _inside_components(pairs)
    level = pairs.filter("target > source").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    out = None
    for n in range(2, max_length + 1):
        closing = level.join(pairs, (level["last"] == pairs["source"]) & (level["first"] == pairs["target"])).select(F.lit(n).alias("cycle_length"), F.concat(F.array_join("path", " -> "), F.lit(" -> "), F.col("first")).alias("cycle_path"))
        out = closing if out is None else out.unionByName(closing)
        level = level.join(pairs, (level["last"] == pairs["source"]) & (pairs["target"] > level["first"])).filter(~F.array_contains("path", F.col("target"))).select("first", F.col("target").alias("last"), F.concat("path", F.array("target")).alias("path"))
    return out.orderBy("cycle_length", "cycle_path")


def hidden_dependencies(spans: DataFrame, min_calls: int = 1, exact: bool = False) -> DataFrame:
    """Client calls by what they reach, with how urgently that wants documenting."""
    df = C.kind_filter(spans, C.CLIENT).filter(C.service().isNotNull()).select(
        C.service().alias("source_service"), C.target_service(extended=True).alias("target_identifier"), C.dependency_type().alias("dependency_type"),
        *[C.attr(k).alias(n) for k, n in (("db.system", "db_system"), ("db.name", "db_name"), ("http.host", "http_host"), ("messaging.destination", "queue_name"))],
        "name", C.ms().alias("ms"), C.is_error().alias("is_error"),
    )
    kind = F.col("dependency_type")
    keys = ["source_service", "target_identifier", "dependency_type", "db_system", "db_name", "http_host", "queue_name"]
    df = cut(df)
    out = summarise(df, keys, _call_facts(), {"p95_latency_ms": ("ms", 0.95)}, exact).filter(F.col("call_count") >= min_calls)
    names = df.groupBy(*keys, "name").agg(F.count("*").alias("n"))
    out = beside(out, keys, distinct_count(names, keys, "name", "unique_operations"), samples(names, keys, "name", "sample_operations"), otherwise={"unique_operations": 0, "sample_operations": ""})
    details = F.when(kind == "DATABASE", F.concat("db_system", F.lit("/"), F.coalesce("db_name", F.lit("unknown")))).when(kind.like("%EXTERNAL"), F.col("http_host")).when(kind == "MESSAGE_QUEUE", F.col("queue_name")).otherwise(F.col("target_identifier"))
    urgent = kind.like("%EXTERNAL%") | ((kind == "DATABASE") & F.col("db_name").isNull()) | (F.col("error_rate_pct") > 5)
    return out.withColumn("target_details", details).withColumn("documentation_priority", F.when(urgent, "HIGH").when(F.col("call_count") > 1000, "MEDIUM").otherwise("LOW"))


def closure(pairs: DataFrame, start: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """(origin, service_name, depth): every service that an origin reaches along (or against) the edges within ``depth`` calls,
    with the least number of calls. Each round goes on from the services met for the first time in the round before, so
    a service is expanded once an origin, however many paths lead to it."""
    here, there = ("source", "target") if forward else ("target", "source")
    step = pairs.select(F.col(here).alias("here"), F.col(there).alias("next")).distinct()
    level = start.select("origin", F.col("origin").alias("service_name"), F.lit(0).alias("depth"))
    levels = [level]
    for k in range(1, depth + 1):
        met = level.join(step, level["service_name"] == step["here"]).select("origin", F.col("next").alias("service_name")).distinct()
        known = levels[0]
        for x in levels[1:]:
            known = known.unionByName(x)
        level = cut(met.join(known, ["origin", "service_name"], "left_anti").withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        levels.append(level)
    found = levels[1] if len(levels) > 1 else levels[0].filter("false")
    for x in levels[2:]:
        found = found.unionByName(x)
    return found


def blast_radius(spans: DataFrame, depth: int = 3) -> DataFrame:
    """For each service, how many services reach it within ``depth`` calls, how many calls away the farthest of them is, and
    over how many direct calls."""
    pairs = cut(service_pairs(spans))
    start = pairs.select(F.col("target").alias("origin")).distinct()
    reached = closure(pairs, start, depth, forward=False).groupBy(F.col("origin").alias("service_name")).agg(F.count("*").alias("affected_services"), F.max("depth").alias("max_depth"))
    direct = pairs.groupBy(F.col("target").alias("service_name")).agg(F.sum("calls").alias("direct_calls"))
    return reached.join(direct, "service_name").select("service_name", "affected_services", "max_depth", "direct_calls").orderBy(F.desc("affected_services"), "service_name")
