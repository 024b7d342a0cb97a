"""Percentiles: sketched, or exact by running counts that are spread over tasks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import small
from .lineage import cut


#: Of a sketched percentile: one row in so many is the most its rank is off.
ACCURACY = 10_000
#: The same of the sketches that exact percentiles start from. Up to SMALL rows that is less than a row, so these are exact.
FINE, SMALL = 200_000, 100_000
#: Share of a group's rows by which a bracket goes beyond a pick on either side: more than a sketch and rounding are off.
MARGIN = 5 / FINE
#: So little beyond a share of three digits a small group's next place begins, where the share meets a place exactly.
NEXT = 1 / (2_000 * SMALL)


def quantile(col: Column, p: float, accuracy: int = ACCURACY) -> Column:
    """Discrete percentile from a sketch of bounded size: off by one row in ``accuracy`` at most."""
    return F.percentile_approx(col, p, accuracy)


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _n, _upto, _all): each distinct value of a group with its rows, those up to it, and all of the group.

    A group's values are dealt over tasks by range, so one with most of the rows is not sorted in a single task: every
    range counts its own, and only the ranges' sums are put in order.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    dealt = cut(counted.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    each = Window.partitionBy(*keys)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(each.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(each).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    own = dealt.withColumn("_inside", inside)
    on = own["_range"] == starts["_range"]
    for k in keys:
        on = on & own[k].eqNullSafe(starts[k])
    return own.join(starts, on).select(*[own[k] for k in keys], own[value], "_n", (F.col("_before") + F.col("_inside")).alias("_upto"), "_all")


def ranked(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Rows that have the value with their place (_place, from 1) in their group by it, equal ones by ``tie``, and the group's
    rows (_all). Only rows with the same value are ordered in one task."""
    counts = running_counts(df, keys, value).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_value"), (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    on = df[value] == F.col("_value")
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, value).orderBy(tie))
    return df.join(counts, on).withColumn("_place", F.col("_before") + inside).drop(*[f"_k{i}" for i in range(len(keys))], "_value", "_before")


@dataclass(frozen=True)
class _Pick:
    """A percentile by name: of a column, of a kind (floor, continuous or discrete), at a share."""

    name: str
    column: str
    kind: str
    share: float

    def asked(self) -> list[float]:
        """Shares to ask a sketch for: the edges of the bracket, and in between what tells the pick of a small group."""
        p = self.share
        low, high = {"discrete": (p, p), "floor": (p + NEXT, p + NEXT), "continuous": (p, p + NEXT)}[self.kind]
        return [min(1.0, max(0.0, x)) for x in (p - MARGIN, low, high, p + MARGIN)]

    def told(self) -> bool:
        """Whether an exact sketch tells the pick: places of other shares depend on the size of the group."""
        return self.share == 0.5 if self.kind == "continuous" else self.kind == "discrete" or round(self.share, 3) == self.share

    def indexes(self, n: Column) -> list[Column]:
        """Places (from 0) of the values that the pick is made of, in a group of n."""
        at = (n - 1) * F.lit(self.share)
        if self.kind == "continuous":
            return [F.floor(at), F.ceil(at)]
        return [F.least(F.floor(n * F.lit(self.share)), n - 1) if self.kind == "floor" else F.greatest(F.ceil(n * F.lit(self.share)) - 1, F.lit(0))]


def _exact(df: DataFrame, keys: list[str], facts: list[Column], picks: list[_Pick]) -> DataFrame:
    """Groups with facts and exact percentiles.

    The pass that takes the facts also sketches each column. A sketch tells most picks of a small group exactly; else it
    brackets the pick, and in a second pass values below the bracket are only counted, those above it dropped, and those
    inside counted by value: about a ten-thousandth of a large group's rows for each pick is put in order. Of small groups
    whose picks lie between places that depend on their size all values are counted. Where all is told by the sketches there is no second pass.
    """
    columns = list(dict.fromkeys(p.column for p in picks))
    wanted = {c: [e for p in picks if p.column == c for e in p.asked()] for c in columns}
    at = {p: 4 * [q for q in picks if q.column == p.column].index(p) for p in picks}
    seen = [F.struct(F.count(c).alias("n"), F.percentile_approx(c, wanted[c], FINE).alias("e")).alias(f"_of{columns.index(c)}") for c in columns]
    whole = cut(df.groupBy(*keys).agg(*facts, *seen))
    of = lambda p, part: F.col(f"_of{columns.index(p.column)}.{part}")
    is_open = lambda p: (of(p, "n") > SMALL) | F.lit(not p.told())
    marks = whole.filter(reduce(or_, [is_open(p) & (of(p, "n") > 0) for p in picks])).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[f"_of{i}" for i in range(len(columns))])
    kind_of = {p: df.schema[p.column].dataType for p in picks}
    names = [c for c in whole.columns if not c.startswith("_of")]
    told = {p: (of(p, "e")[at[p] + 1] + of(p, "e")[at[p] + 2]) / 2 if p.kind == "continuous" else of(p, "e")[at[p] + 1].cast(kind_of[p]) for p in picks}
    if marks.isEmpty():
        return whole.select(*names, *[told[p].alias(p.name) for p in picks])
    on = [df[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    joined = df.select(*keys, *[c for c in columns if c not in keys]).join(small(marks), reduce(and_, on)) if keys else df.select(*columns).crossJoin(F.broadcast(marks))

    def place(k: int, p: _Pick) -> Column:
        v, low, high = F.col(p.column).cast("double"), of(p, "e")[at[p]], of(p, "e")[at[p] + 3]
        value = F.when((of(p, "n") <= SMALL) | (v >= low), v)  # null: below the bracket
        return F.when(is_open(p) & v.isNotNull() & ((of(p, "n") <= SMALL) | (v <= high)), F.struct(F.lit(k).alias("k"), value.alias("v")))

    counted = joined.select(*[f"_k{i}" for i in range(len(keys))], *[f"_of{i}" for i in range(len(columns))], F.explode(F.array_compact(F.array(*[place(k, p) for k, p in enumerate(picks)]))).alias("p"))
    ids = [f"_k{i}" for i in range(len(keys))]
    rows = reduce(lambda x, kp: F.when(F.col("p.k") == kp[0], of(kp[1], "n")).otherwise(x), enumerate(picks), F.lit(0))
    counted = counted.select(*ids, "p.k", "p.v", rows.alias("_rows")).groupBy(*ids, "k", "v", "_rows").agg(F.count("*").alias("_n"))
    upto = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*ids, "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)))
    found = []
    for k, p in enumerate(picks):
        found += [F.min(F.when((F.col("k") == k) & (F.col("_upto") > index), F.col("v"))).alias(f"_p{k}_{i}") for i, index in enumerate(p.indexes(F.col("_rows")))]
    found = upto.groupBy(*ids).agg(*found) if ids else upto.agg(*found)
    on = [whole[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    both = whole.join(found, reduce(and_, on), "left") if keys else whole.crossJoin(F.broadcast(found))
    out = []
    for k, p in enumerate(picks):
        low, high, part = F.col(f"_p{k}_0"), F.col(f"_p{k}_1") if p.kind == "continuous" else None, (of(p, "n") - 1) * F.lit(p.share)
        counted_pick = low + (high - low) * (part - F.floor(part)) if p.kind == "continuous" else low.cast(kind_of[p])
        out.append(F.coalesce(counted_pick, F.when(~is_open(p), told[p])).alias(p.name))
    return both.select(*names, *out)


def percentiles(
    df: DataFrame, keys: list[str], value: str, floors: dict[str, float] | None = None, continuous: dict[str, float] | None = None, discrete: dict[str, float] | None = None, facts: list[Column] | None = None
) -> DataFrame:
    """Exact percentiles of each group that has a value, after ``facts`` of those values. floors: the (floor(n * p) + 1)-th
    smallest value, the way sorted[int(n * p)] picks it; continuous: interpolated between the two values next to p * (n - 1);
    discrete: the least value that a share p is not above. ``df`` may be read twice."""
    picks = [_Pick(n, value, kind, p) for kind, points in (("floor", floors), ("continuous", continuous), ("discrete", discrete)) for n, p in (points or {}).items()]
    df = df.filter(F.col(value).isNotNull())
    return _exact(df if facts else df.select(*dict.fromkeys([*keys, value])), keys, facts or [], picks)


def summarise(df: DataFrame, keys: list[str], facts: list[Column], picks: dict[str, tuple[str, float]], exact: bool = False, digits: int = 2) -> DataFrame:
    """Groups with facts and discrete percentiles. picks: name -> (column, share). One aggregation with sketches, or exact
    percentiles beside the facts, for which ``df`` may be read twice; either way no group's values are gathered."""
    if not exact or not picks:
        return df.groupBy(*keys).agg(*facts, *[F.round(quantile(F.col(c), p), digits).alias(n) for n, (c, p) in picks.items()])
    out = _exact(df, keys, facts, [_Pick(n, c, "discrete", p) for n, (c, p) in picks.items()])
    return out.withColumns({n: F.round(n, digits) for n in picks})


def floor_index(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    return percentiles(df, keys, value, floors=points)
