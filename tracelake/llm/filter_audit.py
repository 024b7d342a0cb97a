"""How filters act on one another: what each of them removes, in every order in which they can be applied.

Each document has a mask of the filters that it fails. A part's masks are counted in one aggregation; from the counts a
decision diagram is built for each part: a level for each filter, a node for each function of the filters below it (equal
ones are shared), and on each node the documents that reach it. The root's path along passed filters is what an order of
filters does: at every level the failing branch is what the filter removes, the passing branch what it keeps. Swapping two
adjacent levels changes only the nodes of these two levels, so all orders are met one swap after another.

Null texts are empty, null parts the empty string. A condition that is null counts as passed. Repeated rows each count; of rows
with one text none is a copy whose id is the least among them, nor one without an id. Several labels of one id count if one of
them does, labels without an id never. Texts are read whole. An empty table gives no rows. Columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of the filter that copies of a text with a smaller id fail.
COPIES = "E"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Failure conditions by name: functions of (text, words). COPIES stands for itself.
FILTERS: dict[str, Callable[[Column, Column], Column] | None] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.char_length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
    COPIES: None,
}


def failure_counts(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail (bit k: the k-th one).

    A text that very many documents share is counted before it is shuffled by its digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), _words(text).alias("words"))
    bits = [F.when(test(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, test in enumerate(filters.values()) if test]
    rows = rows.select("id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), reduce(lambda a, b: a + b, bits, F.lit(0)).alias("mask"))
    marked = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    said = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = rows.join(marked, "id", "left").select("id", "part", "key", "mask", said("good"), said("toxic"))
    kind = ["part", "mask", "good", "toxic"]
    if COPIES in filters:
        same = rows.groupBy("id", "key", *kind).agg(F.count("*").alias("n"))
        with_id = F.col("id").isNotNull()
        groups = same.groupBy("key", *kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~with_id, F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(with_id, F.struct("id", "n"))).alias("low"))
        least = F.min("low.id").over(Window.partitionBy("key"))
        groups = groups.withColumn("passing", F.col("nameless") + F.when(F.col("low.id") == least, F.col("low.n")).otherwise(0))
        copies = F.col("mask") + (1 << list(filters).index(COPIES))
        two = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct(copies.alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
        rows = groups.select("part", "good", "toxic", F.inline(two)).filter("n > 0")
    else:
        rows = rows.withColumn("n", F.lit(1))
    count = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count(F.col("good"), "good"), count(F.col("toxic"), "toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places k at which swapping the k-th and the next of n things, one swap after another, meets every order once."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k
        down = not down


class Diagram:
    """A decision diagram over masks. Level k decides the variable ``order[k]``; a node has a child for a variable that is
    not in the mask and one for a variable that is, and the weights (a tuple of counts) of all masks below it. Nodes of a
    level with equal children are one, so are leaves with equal weights."""

    def __init__(self, weights: dict[int, tuple[int, ...]], variables: int):
        self.order = list(range(variables))
        zero = (0,) * len(next(iter(weights.values()), (0,)))
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(variables)]
        self._unique: list[dict] = [{} for _ in range(variables + 1)]
        self.weight: list[tuple[int, ...]] = []

        def build(level: int, mask: int) -> int:
            if level == variables:
                w = weights.get(mask, zero)
                return self._unique[level].setdefault(w, self._new(w))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, weight: tuple[int, ...]) -> int:
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: int, out: int, inside: int) -> int:
        have = self._unique[level].get((out, inside))
        if have is None:
            have = self._new(tuple(a + b for a, b in zip(self.weight[out], self.weight[inside])))
            self._unique[level][out, inside] = have
            self.levels[level][have] = (out, inside)
        return have

    def swap(self, k: int) -> None:
        """Exchanges levels k and k + 1. The nodes of level k keep their names, for they stand for what they stood for."""
        upper, lower = self.levels[k], self.levels[k + 1]
        self._unique[k], self._unique[k + 1], self.levels[k], self.levels[k + 1] = {}, {}, {}, {}
        for node, (out, inside) in upper.items():
            children = tuple(self._node(k + 1, lower[out][b], lower[inside][b]) for b in (0, 1))
            self.levels[k][node] = children
            self._unique[k][children] = node
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def path(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, weights that have it, weights that do not) down the path of masks with none of the variables so far."""
        out, node = [], self.root
        for level, variable in zip(self.levels, self.order):
            node, inside = level[node]
            out.append((variable, self.weight[inside], self.weight[node]))
        return out


def interactions(weights: dict[int, tuple[int, int, int]], names: list[str]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each order and step.
    weights: (documents, good ones, toxic ones) of every mask."""
    n = len(names)
    diagram = Diagram(weights, n)
    paths = [(tuple(diagram.order), diagram.path())]
    for k in adjacent_swaps(n):
        diagram.swap(k)
        paths.append((tuple(diagram.order), diagram.path()))
    failing, alone, shapley = [0] * n, [0] * n, [0] * n
    for _, steps in paths:
        failing[steps[0][0]] = steps[0][1][0]
        alone[steps[-1][0]] = steps[-1][1][0]
        for variable, removed, _ in steps:
            shapley[variable] += removed[0]
    out = []
    for order, steps in paths:
        text = "".join(names[v] for v in order)
        for k, (v, removed, kept) in enumerate(steps):
            out.append((text, k + 1, kept[0], removed[0], failing[v] - removed[0], alone[v], removed[1], removed[2], shapley[v]))
    return out


_COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, from failure_counts. A part is at most 2 ** filters rows."""

    def run(table: pa.Table) -> pa.Table:
        part, mask, *weights = (table.column(c).to_pylist() for c in ("part", "mask", "n", "good", "toxic"))
        rows = interactions(dict(zip(mask, zip(*weights))), names)
        order, step, *numbers = zip(*rows)
        columns = {"part": pa.array([part[0]] * len(rows)), "filter_order": pa.array(order), "step": pa.array(step, pa.int32())}
        return pa.table(columns | {c: pa.array(x, pa.int64()) for c, x in zip(_COLUMNS, numbers)})

    return counts.groupBy("part").applyInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS))
