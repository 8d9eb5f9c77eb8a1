"""What the operators of this subpackage share: inputs, scratch tables and Arrow maps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pairloom.plans.scratch import materialise  # noqa: F401  for the operators

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, columns: list[str], schema: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Run rows over Arrow batches of the named columns only, so that the scan reads no others."""
    return df.select(*columns).mapInArrow(rows, schema)


def give_back() -> None:
    """Hand memory that is free back to the system: a worker lives on from task to task, and what an earlier one held counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of about that many bytes from here on: texts vary in length, and a batch is in memory several times on its way."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows, so that what is made from long texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices_of_bytes(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about that many bytes, a longer text alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths.astype(np.int64) + 1) // size
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keep_rows(df: DataFrame, text_column: str, kept: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows whose text kept() says yes to, with all their columns; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(kept(utf8(part.column(at))), pa.bool_()))

    at = df.columns.index(text_column)
    return df.mapInArrow(run, df.schema)
