"""Facts of groups that one aggregation would hold unbounded state for: each is a table of its own, put beside the others."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_count(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, name): how many different values of a column each group has. Two plain aggregations, so percentiles of the same
    groups need no sketch for each value."""
    return df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_value")).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def least_values(df: DataFrame, keys: list[str], column: str, n: int, name: str) -> DataFrame:
    """(keys, name): the n least different values of a column, as an array. No group ever holds more than n of them."""
    values = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_value")).distinct()
    ranked = values.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_value"))).filter(F.col("_rank") <= n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("_value")).alias(name))


def samples(df: DataFrame, keys: list[str], column: str, name: str, n: int = 5) -> DataFrame:
    """(keys, name): at most n different values, in order, as one text."""
    return least_values(df, keys, column, n, name).withColumn(name, F.array_join(name, ","))


def beside(groups: DataFrame, keys: list[str], *facts: DataFrame, otherwise: dict | None = None) -> DataFrame:
    """Groups with further facts of theirs; null keys are equal. otherwise: what a group without a fact gets."""
    for k, fact in enumerate(facts):
        renamed = fact.select(*[F.col(c).alias(f"_{k}_{c}") for c in keys], *[c for c in fact.columns if c not in keys])
        on = F.lit(True)
        for c in keys:
            on = on & groups[c].eqNullSafe(renamed[f"_{k}_{c}"])
        groups = groups.join(renamed, on, "left").drop(*[f"_{k}_{c}" for c in keys])
    return groups.fillna(otherwise) if otherwise else groups


def small(table: DataFrame, rows: int = 10_000) -> DataFrame:
    """A dimension table with the hint to broadcast it, if it has at most ``rows`` rows; else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


#: So many rows of a table dealt by key come to one task, about.
ROWS_A_TASK = 250_000


def parts_of(table: DataFrame) -> int:
    """Into how many parts to deal a table's rows, which are counted, so that what a task holds does not grow with the table."""
    return max(math.ceil(table.count() / ROWS_A_TASK), table.sparkSession.sparkContext.defaultParallelism)
