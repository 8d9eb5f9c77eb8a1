"""Aggregates of one column by the values of another, put back on every row or one for each group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.aggregates import TwoStage, group_values, is_custom

Aggregate = str | TwoStage | Callable[[np.ndarray], float]
PLAIN: dict[str, Callable[[Column], Column]] = {
    "array": F.collect_list,
    "n_unique": F.count_distinct,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "var": F.var_pop,
}


def free_name(df: DataFrame, name: str) -> str:
    """The name, with an m added until no column has it."""
    while name in df.columns:
        name += "m"
    return name


def _grouped(df: DataFrame, by: str, column: str, func: Aggregate, weights: str | None, name: str) -> DataFrame:
    x = F.col(column)
    if is_custom(func):
        return group_values(df, [by], column, func, name)
    if func not in PLAIN:
        raise ValueError(f"func must be a function or one of {sorted(PLAIN)}")
    if weights is None or func not in ("sum", "var"):
        return df.groupBy(by).agg(PLAIN[func](x).alias(name))
    w = F.col(weights)
    if func == "sum":
        return df.groupBy(by).agg(F.sum(x * w).alias(name))
    means = df.groupBy(F.col(by).alias("_by")).agg((F.sum(x * w) / F.sum(w)).alias("_mu"))
    near = df.select(F.col(by).alias(by), x.alias("_x"), w.alias("_w")).join(means, F.col(by).eqNullSafe(F.col("_by")))
    return near.groupBy(by).agg((F.sum(F.col("_w") * F.pow(F.col("_x") - F.col("_mu"), 2)) / F.sum("_w")).alias(name))


def aggregate_transform(df: DataFrame, by: str, column: str, func: Aggregate, *, weights: str | None = None, name: str | None = None, merge: bool = True) -> DataFrame:
    """Aggregate column by the values of `by`.

    func is array, n_unique, max, min, sum or var (of the population), a function from the
    group's values (a numpy array, in no stated order) to a number, or a TwoStage aggregate. Weights count for sum and var.
    With merge every row of df comes back with the group's value in a new column, called `name`
    (func's name, or m for a function) with an m added until it is free; without, one row for each
    group with the columns `by` and that one. Groups are summed in the tasks first and joined, so
    one that holds much of the table is split; only array and plain functions bring a group to one task.

    Rows with a null in `by` are a group of their own. Nulls in column count for nothing but in a
    function's array. The order of the rows doesn't matter. An empty table gives no row.
    """
    label = free_name(df, name or (func if isinstance(func, str) else "m"))
    found = _grouped(df, by, column, func, weights, label)
    if not merge:
        return found
    key = free_name(df, "_key")
    other = found.select(F.col(by).alias(key), label)
    return df.join(other, F.col(by).eqNullSafe(F.col(key)), "left").select(*df.columns, label)
