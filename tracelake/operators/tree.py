"""Analyses of span trees: all traces at once, by pointer doubling.

A span looks up its parent, then its parent's parent, then four spans up, and so on: a chain of a thousand spans takes ten
rounds, and a span that has met its root takes part in no further one. What is asked along the way (a depth, a weight, a sum)
is put together from the two halves of each jump.

Within a trace an id stands for one span: of spans that share an id for one without a parent, else the one with the least
parent id. Spans without an id have no children; those alike in every column are one. Spans whose ancestors run in a circle
are part of no tree. Each trace is decided by its own spans alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.groups import parts_of, small
from ..functions.lineage import cut

#: What the names of spans without an id begin with while trees are walked.
_NAMELESS = "\u0000"
#: A child that ends this many milliseconds before its parent blocks it by half.
EARLY_END_MS = 5
#: Rounds of pointer doubling that are windows over spans dealt by trace: enough for trees of four levels below the root.
LEAPS = 3


def slim(spans: DataFrame) -> DataFrame:
    return spans.select(
        "trace_id", "span_id", "parent_span_id", "name", C.service().alias("service_name"), "start_time", C.epoch_ms(F.col("start_time")).alias("start_ms"), C.epoch_ms(F.col("end_time")).alias("end_ms"), C.ms().alias("ms"), C.is_error().alias("is_error")
    )


def _id(column: str) -> Column:
    """An id as the spans have it."""
    return F.when(~F.startswith(F.col(column), F.lit(_NAMELESS)), F.col(column))


def _looked_up(df: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Rows with ``up``: the facts of the row of their trace whose span_id is their ``key``, null where there is none. An id is of
    one row in its trace. Rows that are dealt by trace stay where they are."""
    sides = F.array(F.struct(F.lit(True).alias("is_up"), F.col("span_id").alias("id")), F.struct(F.lit(False).alias("is_up"), F.col(key).alias("id")))
    both = df.withColumn("_side", F.explode(sides)).withColumns({"_is_up": F.col("_side.is_up"), "_at": F.col("_side.id")}).drop("_side")
    found = F.first(F.when(F.col("_is_up"), F.struct(*facts)), ignorenulls=True).over(Window.partitionBy("trace_id", "_at"))
    return both.withColumn("up", found).filter("not _is_up").drop("_is_up", "_at")


@dataclass(frozen=True)
class Lineage:
    """spans: (trace_id, span_id, root_id, depth, own and carried columns) of every span that has a root; spans without an id
    have a name here (``_id`` takes it away).
    jumps: of every round the spans that have not met their root yet, with the ancestor 2 ** round levels up."""

    spans: DataFrame
    jumps: list[DataFrame]

    def ancestors(self, of: DataFrame) -> DataFrame:
        """(trace_id, node, span_id): every node (trace_id, node) with each of its ancestors, and with itself."""
        met = of.select("trace_id", "node", F.col("node").alias("span_id"))
        for jump in reversed(self.jumps):
            up = jump.select("trace_id", "span_id", "above")
            met = cut(met.unionByName(met.join(up, ["trace_id", "span_id"]).select("trace_id", "node", F.col("above").alias("span_id"))))
        return met


def _nodes(spans: DataFrame, own: list[str]) -> DataFrame:
    """(trace_id, span_id, parent_span_id, own columns): of spans dealt by trace one for each id, with how many spans have it (_copies)."""
    facts = F.min(F.struct(F.col("parent_span_id").isNotNull().alias("has_parent"), "parent_span_id", *own)).alias("f")
    named = F.coalesce("span_id", F.concat(F.lit(_NAMELESS), F.hex(F.xxhash64("parent_span_id", *own)))).alias("span_id")
    one = spans.filter("trace_id is not null").select("trace_id", named, "parent_span_id", *own).groupBy("trace_id", "span_id").agg(facts, F.count("*").alias("_copies"))
    return one.select("trace_id", "span_id", "f.parent_span_id", *[f"f.{c}" for c in own], "_copies")


def _leapt(nodes: DataFrame, own: list[str], first: dict[str, Column], link: Callable[[str, str], dict[str, Column]], join: Callable[[str, str], dict[str, Column]]) -> DataFrame:
    """Nodes dealt by trace after LEAPS rounds (see ``lineage``): above is null where the root was met, _above0, _above1 ... are the
    ancestors 1, 2, 4 ... levels up."""
    top, linked = F.col("up.span_id").isNull(), link("up.", "down.")
    table = _looked_up(nodes, "parent_span_id", ["span_id", *own]).alias("down").select(
        "trace_id", "down.span_id", F.col("up.span_id").alias("above"), F.when(top, F.col("down.span_id")).alias("root_id"), F.when(top, 0).otherwise(1).alias("depth"),
        *[F.col(f"down.{c}").alias(c) for c in own], *[F.when(top, x).otherwise(linked[c]).alias(c) for c, x in first.items()], F.col("up.span_id").alias("_above0"),
    )
    joined = join("up.", "down.")
    for k in range(1, LEAPS):
        live, past = F.col("down.above").isNotNull(), [f"_above{i}" for i in range(k)]
        table = _looked_up(table, "above", ["above", "root_id", "depth", *first]).alias("down").select(
            "trace_id", "down.span_id", F.col("up.above").alias("above"), F.when(live, F.col("up.root_id")).otherwise(F.col("down.root_id")).alias("root_id"), (F.col("down.depth") + F.coalesce("up.depth", F.lit(0))).alias("depth"),
            *[F.col(f"down.{c}").alias(c) for c in own], *[F.when(live, joined[c]).otherwise(F.col(f"down.{c}")).alias(c) for c in first], *[F.col(f"down.{c}").alias(c) for c in past], F.col("up.above").alias(f"_above{k}"),
        )
    return table


def lineage(
    spans: DataFrame, own: list[str] | None = None, first: dict[str, Column] | None = None, link: Callable[[str, str], dict[str, Column]] | None = None, join: Callable[[str, str], dict[str, Column]] | None = None, dealt: bool = False
) -> Lineage:
    """Every span with its root (a span without a parent in its trace), its depth, and what its line of ancestors gives.

    own: columns that a span keeps. first: the carried columns of a root; link(up, down): those of a jump from a span (alias
    down) to its parent (alias up); join(up, down): those of two jumps in a row, down being the lower one. join must not
    care which of several jumps are put together first. dealt: the spans are dealt over tasks by trace already.

    The first rounds are windows over spans dealt by trace, which are moved once for all of them; only what has not met its root
    after LEAPS of them is written and joined by rounds.
    """
    own, first, link, join = own or [], first or {}, link or (lambda up, down: {}), join or (lambda up, down: {})
    nodes = _nodes(spans if dealt else spans.repartition("trace_id"), own)
    table, joined = _leapt(nodes, own, first, link, join), join("up.", "down.")
    table = cut(table)
    jumps = [table.filter(F.col(f"_above{k}").isNotNull()).select("trace_id", "span_id", F.col(f"_above{k}").alias("above")) for k in range(LEAPS - 1)]
    table, done = table.drop(*[f"_above{k}" for k in range(LEAPS)]), []
    while True:
        met, left = table.agg(F.count_if(F.col("above").isNull()), F.count("above")).first()
        done.append(table.filter("above is null"))
        if not left or jumps and not met:  # what is left after a round without a root runs in circles
            break
        live = table.filter("above is not null")
        jumps.append(live)
        every = live
        for x in done:
            every = every.unionByName(x)
        on = (F.col("up.trace_id") == F.col("down.trace_id")) & (F.col("up.span_id") == F.col("down.above"))
        table = cut(live.alias("down").join(every.alias("up"), on).select(
            "down.trace_id", "down.span_id", "up.above", "up.root_id", (F.col("up.depth") + F.col("down.depth")).alias("depth"), *[F.col(f"down.{c}").alias(c) for c in own], *[joined[c].alias(c) for c in first],
        ))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return Lineage(found.drop("above"), jumps)


def depths(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth), roots and orphans at depth 0."""
    own = [c for c in ("name", "start_time") if c in spans.columns]
    return lineage(spans, own).spans.select("trace_id", _id("span_id").alias("span_id"), "depth")


def shapes(spans: DataFrame) -> DataFrame:
    """Per trace: names (a set), n (spans), depth of the deepest span. Spans are moved once, but those of traces with ids of several
    spans or with spans that do not meet their root in LEAPS rounds."""
    spans = spans.select("trace_id", "span_id", "parent_span_id", "name").filter("trace_id is not null")
    own, none = ["name", "_copies"], lambda up, down: {}
    table = _leapt(_nodes(spans.repartition("trace_id"), own[:1]), own, {}, none, none)
    facts = [F.collect_set("name").alias("names"), F.count("*").alias("n")]
    t = cut(table.groupBy("trace_id").agg(*facts, F.max("depth").alias("depth"), F.min(F.col("above").isNull() & (F.col("_copies") == 1)).alias("plain")))
    found, others = t.filter("plain").drop("plain"), t.filter("not plain").select("trace_id")
    if others.isEmpty():
        return found
    rest = spans.join(others, "trace_id", "left_semi")
    deep = depths(rest).groupBy("trace_id").agg(F.max("depth").alias("depth"))
    return found.unionByName(rest.groupBy("trace_id").agg(*facts).join(deep, "trace_id", "left"))


def call_graph(spans: DataFrame) -> DataFrame:
    """Per trace: spans, roots, depth of the deepest span, distinct names, widest fan-out."""
    fan = spans.filter("parent_span_id is not null").groupBy("trace_id", "parent_span_id").agg(F.count("*").alias("n")).groupBy("trace_id").agg(F.max("n").alias("max_fan_out"))
    deep = depths(spans).groupBy("trace_id").agg(F.max("depth").alias("max_depth"), F.count_if(F.col("depth") == 0).alias("root_count"))
    size = spans.groupBy("trace_id").agg(F.count("*").alias("total_spans"), F.countDistinct("name").alias("distinct_names"))
    return size.join(deep, "trace_id", "left").join(fan, "trace_id", "left").select("trace_id", "total_spans", F.coalesce("root_count", F.lit(0)).alias("root_count"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"), "distinct_names", F.coalesce("max_fan_out", F.lit(0)).alias("max_fan_out"))


def _self_by_sum(df: DataFrame, busy: Column) -> DataFrame:
    """Spans (dealt by trace) with self_ms: their duration less what their children are ``busy``, not below 0."""
    sides = F.array(F.struct(F.col("span_id").alias("at"), F.lit(None).cast("double").alias("busy")), F.when(F.col("parent_span_id").isNotNull(), F.struct(F.col("parent_span_id").alias("at"), busy.alias("busy"))))
    both = df.withColumn("_side", F.explode(F.array_compact(sides))).withColumns({"_at": F.col("_side.at"), "_busy": F.col("_side.busy")}).drop("_side")
    total = F.coalesce(F.sum("_busy").over(Window.partitionBy("trace_id", "_at")), F.lit(0.0))
    return both.withColumn("self_ms", F.greatest(F.lit(0.0), F.col("ms") - total)).filter("_busy is null").drop("_at", "_busy")


def _self_by_union(df: DataFrame) -> DataFrame:
    """Spans (dealt by trace) with self_ms as ``self_times`` tells it: a child adds what of its interval no child before it had."""
    timed = F.col("parent_span_id").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    order = Window.partitionBy("trace_id", "parent_span_id").orderBy("start_ms", "end_ms")
    reach = F.max(F.when(timed, F.col("end_ms"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach"))
    added = F.when(timed, F.when(fresh, F.col("end_ms") - F.col("start_ms")).otherwise(F.greatest(F.lit(0.0), F.col("end_ms") - F.col("_reach")))).otherwise(0.0)
    return _self_by_sum(df.withColumn("_reach", reach).withColumn("_added", added), F.col("_added")).drop("_reach", "_added")


#: What a step of the path of longest children keeps of its span.
_STEP = ["name", "service_name", "ms", "self_ms", "is_error"]


def _longest_children(spans: DataFrame) -> DataFrame:
    """Of each parent in a trace the longest child, of a trace the longest root, with self_ms: its duration less that of its children.
    They are dealt by trace, a bounded part to each task."""
    df = slim(spans)
    df = _self_by_sum(df.repartition(parts_of(df), "trace_id"), F.coalesce("ms", F.lit(0.0)))
    longest = F.min(F.struct(F.col("ms").isNull().alias("unknown"), (-F.col("ms")).alias("less"), "start_ms", "span_id", *_STEP)).alias("c")
    return df.groupBy("trace_id", "parent_span_id").agg(longest).select("trace_id", "parent_span_id", "c.span_id", *[f"c.{c}" for c in _STEP])


# chosen children hang from chosen spans up to the root, or from one that was not chosen
def _rooted_first() -> dict[str, Column]:
    return {"from_root": F.col("down.parent_span_id").isNull()}


def _rooted_link(up: str, down: str) -> dict[str, Column]:
    return {"from_root": F.lit(None).cast("boolean")}


def _rooted_join(up: str, down: str) -> dict[str, Column]:
    return {"from_root": F.col(f"{up}from_root")}


def critical_path_longest_child(spans: DataFrame) -> DataFrame:
    """From each trace's longest root on, always the longest child: one row for each step, with its self time (duration
    less its children's) and its share of the path."""
    found = lineage(_longest_children(spans), _STEP, _rooted_first(), _rooted_link, _rooted_join, dealt=True)
    whole = Window.partitionBy("trace_id")
    out = found.spans.filter("from_root").withColumn("path_self_ms", F.sum("self_ms").over(whole)).withColumn("top", F.max("self_ms").over(whole))
    return out.select("trace_id", _id("span_id").alias("span_id"), "depth", "name", "service_name", F.col("ms").alias("duration_ms"), F.col("self_ms").alias("self_time_ms"), F.round(F.try_divide(F.col("self_ms"), F.col("path_self_ms")) * 100, 1).alias("self_time_pct"), (F.col("self_ms") == F.col("top")).alias("is_bottleneck"), "is_error")


def self_times(spans: DataFrame) -> DataFrame:
    """Spans with self_ms: their duration less the union of their children's intervals, not below 0."""
    df = slim(spans)
    children = df.filter("parent_span_id is not null and start_ms is not null and end_ms is not null").select("trace_id", "parent_span_id", "start_ms", "end_ms")
    order = Window.partitionBy("trace_id", "parent_span_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = children.withColumn("fresh", F.when(reach.isNull() | (F.col("start_ms") > reach), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy("trace_id", "parent_span_id", "island").agg((F.max("end_ms") - F.min("start_ms")).alias("covered"))
    busy = islands.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum("covered").alias("covered"))
    return df.join(busy, ["trace_id", "span_id"], "left").withColumn("self_ms", F.greatest(F.lit(0.0), F.col("ms") - F.coalesce("covered", F.lit(0.0)))).drop("covered")


def _blocking_first() -> dict[str, Column]:
    return {"weight": F.lit(1.0), "blocking": F.col("down.self_ms"), "root_ms": F.col("down.ms")}


def _blocking_link(up: str, down: str) -> dict[str, Column]:
    weight = F.when(F.col(f"{up}end_ms") - F.col(f"{down}end_ms") > EARLY_END_MS, 0.5).otherwise(1.0)
    return {"weight": weight, "blocking": weight * F.col(f"{down}self_ms"), "root_ms": F.lit(None).cast("double")}


def _blocking_join(up: str, down: str) -> dict[str, Column]:
    blocking = F.col(f"{up}blocking") + F.col(f"{up}weight") * F.col(f"{down}blocking")
    return {"weight": F.col(f"{up}weight") * F.col(f"{down}weight"), "blocking": blocking, "root_ms": F.col(f"{up}root_ms")}


#: What a span keeps while the path of most blocking time is looked for.
_TIMED = ["name", "start_ms", "end_ms", "ms", "self_ms"]


def _path_step(weight: Column) -> dict[str, Column]:
    return {"path": F.array(F.struct(F.col("down.span_id").alias("span_id"), F.col("down.name").alias("name"), F.col("down.self_ms").alias("self_ms"), weight.alias("weight")))}


def _path_first() -> dict[str, Column]:
    return _blocking_first() | _path_step(F.lit(1.0))


def _path_link(up: str, down: str) -> dict[str, Column]:
    linked = _blocking_link(up, down)
    return linked | _path_step(linked["weight"])


def _path_join(up: str, down: str) -> dict[str, Column]:
    lower = F.transform(f"{down}path", lambda p: F.struct(p["span_id"].alias("span_id"), p["name"].alias("name"), p["self_ms"].alias("self_ms"), (F.col(f"{up}weight") * p["weight"]).alias("weight")))
    return _blocking_join(up, down) | {"path": F.concat(f"{up}path", lower)}


def _least_cost(*more: str) -> Column:
    return F.min(F.struct((-F.round("blocking", 9)).alias("cost"), "depth", "start_ms", "span_id", "root_ms", "blocking", *more)).alias("b")


def _blocking_paths(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trace_id, root_id, root_ms, blocking, path: its spans from the root down) of ``critical_path_blocking``, and the traces for
    which they are not told here: those with spans that do not meet their root in LEAPS rounds. The others are walked by windows
    over spans dealt by trace, which are moved once; a span carries the few above it."""
    df = slim(spans).select("trace_id", "span_id", "parent_span_id", "name", "start_ms", "end_ms", "ms")
    df = _self_by_union(df.repartition(parts_of(df), "trace_id"))
    table = _leapt(_nodes(df, _TIMED), _TIMED, _path_first(), _path_link, _path_join)
    best = table.groupBy("trace_id", "root_id").agg(_least_cost("path"), F.min(F.col("above").isNull()).alias("plain"))
    best = best.withColumn("plain", F.min("plain").over(Window.partitionBy("trace_id")))
    found = cut(best.select("trace_id", "plain", *[F.when(F.col("plain"), F.col(c)).alias(c.removeprefix("b.")) for c in ("root_id", "b.root_ms", "b.blocking", "b.path")]))
    return found.filter("plain").drop("plain"), found.filter("not plain").select("trace_id").distinct()


def _blocking_paths_by_joins(spans: DataFrame) -> DataFrame:
    """The paths that ``_blocking_paths`` tells, for trees of any height."""
    tree = lineage(self_times(spans), _TIMED, _blocking_first(), _blocking_link, _blocking_join)
    best = cut(tree.spans.groupBy("trace_id", "root_id").agg(_least_cost()))
    on_path = tree.ancestors(best.select("trace_id", F.col("b.span_id").alias("node"))).select("trace_id", "span_id").distinct()
    nodes = tree.spans.join(on_path, ["trace_id", "span_id"]).groupBy("trace_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("depth", "span_id", "name", "self_ms", "weight"))).alias("path"))
    path = F.transform("path", lambda p: F.struct(p["span_id"].alias("span_id"), p["name"].alias("name"), p["self_ms"].alias("self_ms"), p["weight"].alias("weight")))
    return best.join(nodes, ["trace_id", "root_id"]).select("trace_id", "root_id", "b.root_ms", "b.blocking", path.alias("path"))


def critical_path_blocking(spans: DataFrame) -> DataFrame:
    """Per root or orphan, the chain of descendants with the most blocking time: self times, halved for each step down to a
    child that ends over 5 ms before its parent; each step with its share of that. Blocking times that agree to a billionth are
    ties: they go to the shorter path, then the earlier start, then the id. Shares and ratios are rounded half up once they
    are taken to eight places, so the order of a sum decides no rounding."""
    paths, high = _blocking_paths(spans)
    if not high.isEmpty():
        paths = paths.unionByName(_blocking_paths_by_joins(spans.join(high, "trace_id", "left_semi")))
    half_up = lambda x: F.round(F.round(x, 8), 2)
    ratio = F.coalesce(F.try_divide("root_ms", "blocking"), F.lit(1.0))
    share = lambda p: half_up(F.try_divide(p["self_ms"] * p["weight"], F.col("blocking")) * 100)
    steps = F.transform("path", lambda p: F.struct(F.when(~F.startswith(p["span_id"], F.lit(_NAMELESS)), p["span_id"]).alias("span_id"), p["name"].alias("name"), p["self_ms"].alias("self_ms"), share(p).alias("contribution_pct")))
    return paths.select(
        "trace_id", _id("root_id").alias("root_span_id"), steps.alias("critical_path"), F.round("blocking", 8).alias("total_critical_ms"), F.round("root_ms", 8).alias("trace_duration_ms"),
        half_up(ratio).alias("parallelism_ratio"), F.when(ratio > 1, half_up((1 - 1 / ratio) * 100)).otherwise(0.0).alias("parallelism_pct"),
    )


def parallel_opportunities(spans: DataFrame, min_savings_ms: float = 10) -> DataFrame:
    """Siblings of one service that could run side by side: what that would save."""
    df = slim(spans).filter("parent_span_id is not null")
    out = df.groupBy("trace_id", "parent_span_id", "service_name").agg(F.count("*").alias("sibling_count"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))
    return out.withColumn("savings_ms", F.col("total_ms") - F.col("max_ms")).filter((F.col("sibling_count") >= 2) & (F.col("savings_ms") > min_savings_ms))


def _path_facts(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per trace: length, errors, bottleneck and share of its path of longest children. Then the traces for which that is not told
    here: those with chosen spans that do not meet their root in LEAPS rounds. The others are walked by windows over spans dealt by
    trace, which are moved once; only the facts are written."""
    own = ["name", "ms", "self_ms", "is_error"]
    table = _leapt(_nodes(_longest_children(spans), own), own, _rooted_first(), _rooted_link, _rooted_join)
    on = lambda x: F.when(F.col("above").isNull() & F.col("from_root"), x)
    facts = cut(table.groupBy("trace_id").agg(
        F.count(on(F.lit(1))).alias("length"), F.count(on(F.when(F.col("is_error"), 1))).alias("errors"), F.min_by("name", on(F.struct((-F.col("self_ms")).alias("x"), "depth"))).alias("bottleneck"),
        F.round(F.try_divide(F.max(on(F.col("self_ms"))), F.sum(on(F.col("self_ms")))) * 100, 1).alias("share"), F.min(F.col("above").isNull()).alias("plain"),
    ))
    return facts.filter("plain and length > 0").drop("plain"), facts.filter("not plain").select("trace_id")


def _path_facts_by_joins(spans: DataFrame) -> DataFrame:
    """The facts that ``_path_facts`` tells, for trees of any height."""
    return critical_path_longest_child(spans).groupBy("trace_id").agg(
        F.count("*").alias("length"), F.count_if("is_error").alias("errors"), F.min_by("name", F.struct((-F.col("self_time_ms")).alias("x"), "depth")).alias("bottleneck"), F.max("self_time_pct").alias("share")
    )


def optimization_recommendations(spans: DataFrame) -> DataFrame:
    """Per trace one row for each rule that its critical path meets."""
    facts, high = _path_facts(spans)
    if not high.isEmpty():
        facts = facts.unionByName(_path_facts_by_joins(spans.join(high, "trace_id", "left_semi")))
    savings = parallel_opportunities(spans).groupBy("trace_id").agg(F.round(F.sum("savings_ms"), 2).alias("savings"))
    df = facts.join(savings, "trace_id", "left")
    rule = lambda when, kind, priority, target: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), target.cast("string").alias("target")))
    rules = F.array_compact(F.array(
        rule(F.col("share") > 0, "bottleneck", "HIGH", F.col("bottleneck")), rule(F.col("savings").isNotNull(), "parallelization", "MEDIUM", F.col("savings")),
        rule(F.col("errors") > 0, "errors", "HIGH", F.col("errors")), rule(F.col("length") > 5, "path_length", "LOW", F.col("length")),
    ))
    return df.select("trace_id", F.explode(rules).alias("r")).select("trace_id", "r.type", "r.priority", "r.target")


def _without_covered(chains: DataFrame) -> DataFrame:
    """Chains (trace_id, span_id, chain_length, names: a sorted set) but for those whose names are all in a longer chain of the
    trace (of equal length: one with a smaller id).

    Of chains with the same names one is left first. Then a chain is held only against those that have its rarest name.
    """
    by_names = chains.groupBy("trace_id", "names").agg(F.min(F.struct((-F.col("chain_length")).alias("less"), "span_id", "chain")).alias("m"))
    best = cut(by_names.select("trace_id", "names", "m.span_id", (-F.col("m.less")).alias("chain_length"), "m.chain"))
    several = best.groupBy("trace_id").agg(F.count("*").alias("n")).filter("n > 1").select("trace_id")
    each = cut(best.join(several, "trace_id", "left_semi").select("trace_id", "span_id", "chain_length", "names", F.explode("names").alias("name")))
    known = each.groupBy("trace_id", "name").agg(F.count("*").alias("n"))
    rarest = each.join(known, ["trace_id", "name"]).groupBy("trace_id", "span_id", "chain_length", "names").agg(F.min(F.struct("n", "name")).alias("r")).filter("r.n > 1")
    a, b = rarest.select("*", F.col("r.name").alias("name")).alias("a"), each.alias("b")
    longer = (F.col("b.chain_length") > F.col("a.chain_length")) | ((F.col("b.chain_length") == F.col("a.chain_length")) & (F.col("b.span_id") < F.col("a.span_id")))
    inside = (F.size("b.names") > F.size("a.names")) & (F.size(F.array_except("a.names", "b.names")) == 0)
    covered = a.join(b, (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.name") == F.col("b.name")) & longer & inside, "left_semi").select("trace_id", "span_id")
    return best.join(covered, ["trace_id", "span_id"], "left_anti")


def _chains(spans: DataFrame, threshold_ms: float) -> tuple[DataFrame, DataFrame]:
    """Chains (trace_id, span_id, chain: names and durations from the lowest timeout up) of ``cascading_timeout``, and the traces for
    which they are not told here: those with spans that do not meet their root in LEAPS rounds. The others are walked by windows
    over spans dealt by trace, which are moved once; a span carries the few timeouts above it."""
    from .traces import is_timeout

    df = spans.select("trace_id", "span_id", "parent_span_id", "name", C.ms().alias("ms"), (is_timeout() | (C.ms() >= threshold_ms)).alias("hit"))
    whole = Window.partitionBy("trace_id")
    # a chain takes two timeouts
    dealt = df.repartition("trace_id").withColumn("_hits", F.count_if("hit").over(whole)).filter("_hits > 1").drop("_hits")
    own = ["name", "ms", "hit"]
    mine = F.struct(F.col("down.name").alias("name"), F.col("down.ms").alias("ms"))
    step = F.when(F.col("down.hit"), F.array(mine)).otherwise(F.filter(F.array(mine), lambda _: F.lit(False)))
    link = lambda up, down: {"near": F.when(F.col(f"{up}hit"), F.col(f"{up}span_id")), "chain": step}
    join = lambda up, down: {"near": F.coalesce(F.col(f"{down}near"), F.col(f"{up}near")), "chain": F.concat(F.col(f"{down}chain"), F.col(f"{up}chain"))}
    table = _leapt(_nodes(dealt, own), own, {"near": F.lit(None).cast("string"), "chain": step}, link, join)
    hits = table.withColumn("_open", F.max(F.col("above").isNotNull()).over(whole)).filter("hit or above is not null")
    sides = F.array(F.struct(F.lit(False).alias("up"), F.col("span_id").alias("at")), F.when(F.col("near").isNotNull(), F.struct(F.lit(True).alias("up"), F.col("near").alias("at"))))
    both = hits.withColumn("_side", F.explode(F.array_compact(sides))).withColumns({"_up": F.col("_side.up"), "_at": F.col("_side.at")}).drop("_side")
    last = both.withColumn("_below", F.max("_up").over(Window.partitionBy("trace_id", "_at"))).filter("not _up and (_open or near is not null and not _below)")
    found = cut(last.groupBy("trace_id", "_open", F.when(~F.col("_open"), F.col("near")).alias("near"), F.when(~F.col("_open"), F.col("name")).alias("name")).agg(F.min(F.struct("span_id", F.when(~F.col("_open"), F.col("chain")).alias("chain"))).alias("m")))
    return found.filter("not _open").select("trace_id", "m.span_id", "m.chain"), found.filter("_open").select("trace_id").distinct()


def _chains_by_joins(spans: DataFrame, threshold_ms: float) -> DataFrame:
    """The chains that ``_chains`` tells, for trees of any height."""
    from .traces import is_timeout

    df = spans.select("trace_id", "span_id", "parent_span_id", "name", C.ms().alias("ms"), (is_timeout() | (C.ms() >= threshold_ms)).alias("hit"))
    nearest = {"near": F.lit(None).cast("string")}
    above = lineage(df, ["name", "ms", "hit"], nearest, lambda up, down: {"near": F.when(F.col(f"{up}hit"), F.col(f"{up}span_id"))}, lambda up, down: {"near": F.coalesce(F.col(f"{down}near"), F.col(f"{up}near"))})
    hits = cut(above.spans.filter("hit").select("trace_id", "span_id", F.col("near").alias("parent_span_id"), "name", "ms"))
    inner = hits.filter("parent_span_id is not null").select("trace_id", F.col("parent_span_id").alias("span_id")).distinct()
    last = hits.filter("parent_span_id is not null").join(inner, ["trace_id", "span_id"], "left_anti").groupBy("trace_id", "parent_span_id", "name").agg(F.min("span_id").alias("node"))
    tree = lineage(hits, ["name", "ms"])
    lines = tree.ancestors(last).join(tree.spans, ["trace_id", "span_id"])
    chain = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), "name", "ms"))), lambda c: F.struct(c["name"].alias("name"), c["ms"].alias("ms")))
    return lines.groupBy("trace_id", F.col("node").alias("span_id")).agg(chain.alias("chain"))


def cascading_timeout(spans: DataFrame, threshold_ms: float = 1000) -> DataFrame:
    """Chains of two or more timeout spans up an ancestor line (others on the way are skipped), per trace, without chains
    whose names a longer chain has too.

    Only timeouts without one below them can end such a chain, since the chain of one above is part of theirs. Of those that
    hang from the same timeout under the same name one is followed.
    """
    chains, high = _chains(spans, threshold_ms)
    if not high.isEmpty():
        chains = chains.unionByName(_chains_by_joins(spans.join(high, "trace_id", "left_semi"), threshold_ms))
    chains = chains.select("trace_id", "span_id", F.size("chain").cast("int").alias("chain_length"), "chain", F.array_sort(F.array_distinct(F.transform("chain", lambda c: c["name"]))).alias("names"))
    return _without_covered(chains).select(
        "trace_id", "chain_length", F.col("chain")[0]["name"].alias("origin_span"), F.transform("chain", lambda c: c["name"]).alias("affected_spans"), F.aggregate("chain", F.lit(0.0), lambda a, c: a + c["ms"]).alias("total_timeout_ms")
    )


def _baseline_means(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    df = spans.select("trace_id", "name", C.ms().alias("ms")).filter("name is not null")
    return pairs.join(df, F.col("baseline_trace_id") == F.col("trace_id")).groupBy("baseline_trace_id", "target_trace_id", "name").agg(F.avg("ms").alias("baseline_ms"))


def _slowed(ms: Column, baseline_ms: Column) -> Column:
    diff = ms - baseline_ms
    return (diff >= 10) | (F.coalesce(F.try_divide(diff, baseline_ms) * 100, F.lit(0.0)) >= 10)


def _slowed_spans(spans: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(baseline_trace_id, target_trace_id, baseline_ms, facts of a span): the target's spans that are slower than the baseline's mean
    of their name, with depth and, on the critical path, self_ms. First those of targets with each id once in which all spans meet
    their root in LEAPS rounds: their trees are walked by windows where the baseline's means have been dealt too, so spans move
    once. Then those of the other targets, by joins."""
    df = slim(spans).select("trace_id", "span_id", "parent_span_id", "name", "service_name", "start_time", "start_ms", "end_ms", "ms").filter("trace_id is not null")
    targets = small(pairs.select(F.col("target_trace_id").alias("trace_id")).distinct(), 100_000)
    few = targets.limit(100_001).count() <= 100_000
    mine = df.join(targets, "trace_id", "left_semi") if few else df
    base = _baseline_means(spans, pairs).select(F.col("target_trace_id").alias("trace_id"), "name", F.struct("baseline_trace_id", "baseline_ms").alias("_base"))
    held = F.collect_list("_base").over(Window.partitionBy("trace_id", "name"))
    asked = F.max(F.col("_base").isNotNull()).over(Window.partitionBy("trace_id"))
    dealt = mine.unionByName(base, allowMissingColumns=True).repartition("trace_id").withColumns({"_held": held, "_asked": asked}).filter("_base is null and _asked").drop("_base", "_asked")
    dealt = dealt.withColumn("_held", F.filter("_held", lambda b: _slowed(F.col("ms"), b["baseline_ms"])))
    own = ["name", "service_name", "start_time", "start_ms", "end_ms", "ms", "self_ms", "_held", "_copies"]
    table = _leapt(_nodes(_self_by_union(dealt), own[:-1]), own, _blocking_first(), _blocking_link, _blocking_join)
    plain = F.min(F.col("above").isNull() & (F.col("_copies") == 1)).over(Window.partitionBy("trace_id"))
    cost = F.struct((-F.round("blocking", 9)).alias("cost"), "depth", "start_ms", "span_id")
    best = F.min(cost).over(Window.partitionBy("trace_id", "root_id"))
    table = table.withColumns({"_plain": plain, "_best": best}).withColumn("_on", F.coalesce(F.col("_best.span_id") == F.col("span_id"), F.lit(False))).drop("_best")
    for k in reversed(range(LEAPS - 1)):  # ancestors of what is on the path, as Lineage.ancestors takes them
        sides = F.array(F.struct(F.lit(False).alias("up"), F.col("span_id").alias("at")), F.when(F.col("_on") & F.col(f"_above{k}").isNotNull(), F.struct(F.lit(True).alias("up"), F.col(f"_above{k}").alias("at"))))
        both = table.withColumn("_side", F.explode(F.array_compact(sides))).withColumns({"_up": F.col("_side.up"), "_at": F.col("_side.at")}).drop("_side")
        table = both.withColumn("_on", F.max(F.col("_up") | F.col("_on")).over(Window.partitionBy("trace_id", "_at"))).filter("not _up").drop("_up", "_at")
    known = ~F.startswith(F.col("span_id"), F.lit(_NAMELESS))
    met = table.filter("not _plain or size(_held) > 0").select(
        "_plain", F.col("trace_id").alias("target_trace_id"), F.explode_outer(F.when(F.col("_plain"), F.col("_held"))).alias("b"), _id("span_id").alias("span_id"), "name", "service_name", "start_time", "ms",
        F.when(known, F.col("depth")).alias("depth"), F.when(known & F.col("_on"), F.col("self_ms")).alias("self_ms"),
    )
    met = cut(met.select("_plain", "b.baseline_trace_id", "target_trace_id", "b.baseline_ms", "span_id", "name", "service_name", "start_time", "ms", "depth", "self_ms"))
    others = met.filter("not _plain").select("target_trace_id").distinct()
    return met.filter("_plain").drop("_plain"), others


def _slowed_by_joins(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """What ``_slowed_spans`` tells, for trees of any height and ids of several spans."""
    base = _baseline_means(spans, pairs)
    mine = cut(spans.join(pairs.select(F.col("target_trace_id").alias("trace_id")).distinct(), "trace_id", "left_semi").drop("events", "links"))
    path = critical_path_blocking(mine).select("trace_id", F.explode("critical_path").alias("p")).select("trace_id", F.col("p.span_id").alias("span_id"), F.col("p.self_ms").alias("self_ms"))
    target = slim(mine).join(depths(mine), ["trace_id", "span_id"], "left").join(path, ["trace_id", "span_id"], "left")
    j = target.join(base, (F.col("trace_id") == F.col("target_trace_id")) & (target["name"] == base["name"])).drop(base["name"])
    return j.filter(_slowed(F.col("ms"), F.col("baseline_ms"))).select("baseline_trace_id", "target_trace_id", "baseline_ms", "span_id", "name", "service_name", "start_time", "ms", "depth", "self_ms")


def causes(spans: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """causal_analysis with the service and start of each span, and with whether its id is known to be of one span (is_single)."""
    j, others = _slowed_spans(spans, pairs)
    j = j.withColumn("is_single", F.col("span_id").isNotNull())
    if not others.isEmpty():
        j = j.unionByName(_slowed_by_joins(spans, pairs.join(others, "target_trace_id", "left_semi")).withColumn("is_single", F.lit(False)))
    diff = F.col("ms") - F.col("baseline_ms")
    j = j.withColumn("diff_ms", diff).withColumn("diff_pct", F.coalesce(F.try_divide(diff, F.col("baseline_ms")) * 100, F.lit(0.0)))
    on_path = F.col("self_ms").isNotNull()
    score = F.col("diff_ms") * F.least(1 + 0.1 * F.coalesce("depth", F.lit(0)), F.lit(1.5)) * F.when(on_path, 2.0).otherwise(1.0) * F.when(on_path & (F.col("self_ms") > 0.3 * F.col("diff_ms")), 1.3).otherwise(1.0)
    j = j.withColumn("on_critical_path", on_path).withColumn("score", score)
    w = Window.partitionBy("baseline_trace_id", "target_trace_id").orderBy(F.desc("score"), "span_id")
    ranked = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    root_cause = F.col("on_critical_path") & ((F.col("self_ms") > 50) | (F.col("rank") == 1))
    return ranked.select("baseline_trace_id", "target_trace_id", "rank", "span_id", "name", F.round("diff_ms", 2).alias("diff_ms"), F.round("diff_pct", 2).alias("diff_pct"), F.coalesce("depth", F.lit(0)).alias("depth"), "on_critical_path", F.round("score", 2).alias("score"), root_cause.alias("is_root_cause"), "service_name", "start_time", "is_single")


def causal_analysis(spans: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """Per (baseline, target) pair of traces, the target's spans that slowed most against the baseline's mean of their
    name, weighted by depth, critical path and self time."""
    return causes(spans, pairs, limit).drop("service_name", "start_time", "is_single")
