"""Aggregates that a user writes: functions of a group's values, and aggregates in two stages.

A function of the values (a numpy array, in no stated order) needs its whole group in one task. A
TwoStage aggregate doesn't: tasks add up what they read into states, one for each group they meet,
and only states move, one for each task and group.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups whose states a task holds; beyond it they are sent on as they are.
HELD = 50_000


@dataclass(frozen=True)
class TwoStage:
    """start() gives an empty state, add(state, values) takes in an array of values (null: NaN), merge(a, b) joins two states, finish(state) gives the number. States are pickled."""

    start: Callable[[], Any]
    add: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


def is_custom(how: Any) -> bool:
    return isinstance(how, TwoStage) or callable(how)


def as_column(how: Callable, column: str) -> Column | None:
    """The aggregate that a function of columns makes; None for a function of values."""
    try:
        made = how(F.col(column))
    except Exception:  # noqa: BLE001  a function of values may fail on a column in any way
        return None
    return made if isinstance(made, Column) else None


def _number(x: Any) -> float | None:
    return None if x is None else float(x)


def group_values(df: DataFrame, keys: list[str], column: str, how: TwoStage | Callable, name: str) -> DataFrame:
    """One row for each group of the keys (nulls are a group): the keys and the aggregate, a double."""
    if not isinstance(how, TwoStage):

        def own(values: pd.Series) -> float:
            return _number(how(values.to_numpy()))

        return df.groupBy(*keys).agg(F.pandas_udf(own, "double")(F.col(column).cast("double")).alias(name))
    fields = [df.schema[k] for k in keys]
    fields = [T.StructField(f"k{n}", f.dataType) for n, f in enumerate(fields)]
    named = [F.col(k).alias(f.name) for k, f in zip(keys, fields, strict=True)]
    names = [f.name for f in fields]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*states, strict=True), kinds, strict=True)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [*names, "state"])
            states.clear()
            return out

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            groups = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([("v", "list")])
            lists = groups.column("v_list").combine_chunks()
            for at, key in enumerate(zip(*(groups.column(n).to_pylist() for n in names), strict=True)):
                values = lists[at].values.to_numpy(zero_copy_only=False)
                states[key] = how.add(states[key] if key in states else how.start(), values)
            if len(states) > HELD:
                yield flush()
        if states:
            yield flush()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for states in batch.column(len(names)).to_pylist():
                merged = how.start()
                for state in states:
                    merged = how.merge(merged, pickle.loads(state))  # noqa: S301  our own tasks' states
                got.append(_number(how.finish(merged)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(got, pa.float64())], [*names, "v"])

    states = df.select(*named, F.col(column).cast("double").alias("v")).mapInArrow(first, T.StructType([*fields, T.StructField("state", T.BinaryType())]))
    each = states.groupBy(*names).agg(F.collect_list("state").alias("states"))  # one for each task at most, but for tasks of very many groups
    done = each.mapInArrow(last, T.StructType([*fields, T.StructField("v", T.DoubleType())]))
    return done.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.col("v").alias(name))
