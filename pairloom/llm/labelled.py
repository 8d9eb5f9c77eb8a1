"""Labelled documents for fitting the classifiers, and the parts that both share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, chosen by a hash of their id; scoring covers all rows.
SAMPLE_ROWS = 12_000
#: Every FOLDS-th id (by checksum) is held out of learning.
FOLDS = 5


def held_out(id_column: str = "doc_id", folds: int = FOLDS):
    """Whether crc32 of the id as text is divisible by folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, text, y) to learn from: not held out, label 0 or 1, the first by a hash of the id.

    The chosen ids, at most `rows`, are the only thing broadcast. A repeated id has the label of its least row.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(id_column) & F.col(id_column).isNotNull())
    chosen = known.groupBy(F.col(id_column).alias("doc_id")).agg(F.min(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = chosen.toPandas()
    if not len(ids):
        return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.lit(0).alias("y")).limit(0)
    fixed = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(fixed), "doc_id")


def adam(gradient, size: int, steps: int, rate: float = 0.02) -> np.ndarray:
    """Minimise by Adam from zero; gradient(step, weights) may use a part of the data each time."""
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(t, w)
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
