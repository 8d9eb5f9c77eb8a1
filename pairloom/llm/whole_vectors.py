"""Vectors of whole numbers: what the operators on integer components share."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fine(vector_column: str) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    return F.coalesce(F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def largest_component(dim: int, times: int) -> int:
    """The bound within which `times` products summed over dim components fit a 64-bit integer."""
    return min(isqrt((2**63 - 1) // (times * max(1, dim))), 2**31 - 1)


def whole(vector_column: str, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component, as int; what lies outside the limit counts as the limit."""
    return F.transform(vector_column, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(limit))), F.lit(float(-limit)))).cast("int"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as int64, short ones filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(lists) * dim:
        return flat.reshape(-1, dim)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def longest(rows: DataFrame, vector_column: str) -> int:
    """Components of the longest vector; 0 for an empty table."""
    return rows.agg(F.max(F.size(vector_column))).first()[0] or 0
