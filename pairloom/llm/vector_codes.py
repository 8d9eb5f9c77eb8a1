"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Components are whole numbers and so are distances, which makes results exact. The nearest entry
is found by lower bounds. A part is cut into blocks; a block's mean, times the root of its size,
and the norm of what the means leave over are features whose squared distance is never above the
true one. One block is coarse, more blocks are finer. An entry stays while its bound is not above
the least exact distance known for the row; survivors of the finest level get exact integer
distances. A level's bounds are one matrix
product of features, in floating point with a margin far above its error, so none is lost.

Each round is one pass over the rows with the codebooks (a fixed number of entries) sent along.
Tasks add up their rows by entry, Spark adds up the tasks' sums, and the driver gets one number
for each component of the codebooks.

Results for special input: rows whose vector is null or holds null or non-finite components are
left out; vectors shorter than the longest one, rounded up to whole parts, are filled with zeros;
components so large that a squared distance could pass 64 bits (2**27.5 for 64 of them) count as
that bound; null ids come last in the order that starts the codebooks, and equal ids are ordered
by vector; fewer rows than entries give smaller codebooks; repeated rows are coded each; a label
whose errors pass 64 bits has a null label_error; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import map_batches, slices
from pairloom.llm.whole_vectors import fine, largest_component, longest, matrix, whole
from pairloom.plans.components import join_skewed
from pairloom.plans.scratch import materialise

#: Blocks of a part at each level of the bounds, coarse to fine.
LEVELS = (1, 4, 8)
#: Share of the norms by which a bound may be off; far above what double precision loses.
MARGIN = 1e-9


def features(x: np.ndarray, blocks: int) -> np.ndarray:
    """Block means (scaled) and the norm of the rest: squared distances between features bound those between rows from below."""
    x = x.astype(np.float64)
    sizes = np.array([len(b) for b in np.array_split(np.arange(x.shape[1]), min(blocks, x.shape[1]))])
    means = np.add.reduceat(x, np.cumsum(sizes) - sizes, axis=1) / sizes
    rest = x - np.repeat(means, sizes, axis=1)
    return np.column_stack([means * np.sqrt(sizes), np.sqrt((rest * rest).sum(axis=1))])


class Codebook:
    """Entries of one part position, with their features at every level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.levels = [features(self.entries, n) for n in LEVELS]
        self.norm = (self.entries.astype(np.float64) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry; of equal ones the lower index."""
        norm = (x.astype(np.float64) ** 2).sum(axis=1)
        apart = norm[:, None] + self.norm
        slack = MARGIN * (norm + self.norm.max()) + 1e-6
        least, alive = np.full(len(x), 2**63 - 1), np.ones(apart.shape, bool)
        for blocks, own in zip(LEVELS, self.levels, strict=True):
            bound = apart - 2 * features(x, blocks) @ own.T
            least = np.minimum(least, self._exact(x, np.arange(len(x)), bound.argmin(axis=1)))
            alive &= bound <= (least + slack)[:, None]
        row, entry = np.nonzero(alive)  # every row keeps an entry: its nearest one
        exact = self._exact(x, row, entry)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(exact, first)
        nearest = np.flatnonzero(exact == least[row])
        return entry[nearest[np.searchsorted(row[nearest], np.arange(len(x)))]], least

    def _exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = x[row] - self.entries[entry]
        return np.einsum("pf,pf->p", apart, apart)


def assign(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part) and squared distances of the rows of a matrix."""
    found = [book.nearest(part) for book, part in zip(books, np.split(x, len(books), axis=1), strict=True)]
    return np.column_stack([c for c, _ in found]), np.column_stack([e for _, e in found])


def _partial_sums(kept: DataFrame, books: list[Codebook], dim: int) -> DataFrame:
    """For each task: sums and numbers of the parts of each entry, a row for each component."""
    width = dim // len(books)
    shared = kept.sparkSession.sparkContext.broadcast([b.entries for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in shared.value]
        sums = [np.zeros((len(b.entries), width), np.int64) for b in own]
        counts = [np.zeros(len(b.entries), np.int64) for b in own]
        for batch in batches:
            for part in slices(batch, 1024):
                x = matrix(part.column(0), dim)
                codes, _ = assign(x, own)
                for p, parts in enumerate(np.split(x, len(own), axis=1)):
                    by = np.argsort(codes[:, p], kind="stable")
                    used, first = np.unique(codes[by, p], return_index=True)
                    sums[p][used] += np.add.reduceat(parts[by], first, axis=0)
                    counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
        for p in range(len(own)):
            used = np.flatnonzero(counts[p])
            columns = (np.full(len(used) * width, p), np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[p][used].ravel(), np.repeat(counts[p][used], width))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total", "n"])

    sums = map_batches(kept, ["q"], "part long, entry long, place long, total long, n long", run)
    return sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))


def train_codebooks(kept: DataFrame, dim: int, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """The codebooks of each part position after the rounds; kept has vec_id and q."""
    start = kept.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).toArrow()
    books = np.split(matrix(start.column("q").combine_chunks(), dim), parts, axis=1)
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for r in _partial_sums(kept, [Codebook(b) for b in books], dim).collect():  # one row for each component of the codebooks
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def compress(rows: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every row with a whole vector; at most 256 entries, two hex digits each."""
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v")).where(fine("v"))
    dim = -(-max(1, longest(found, "v")) // parts) * parts
    kept = materialise(found.select("vec_id", "label", whole("v", scale, largest_component(dim, 4)).alias("q")), "whole_vectors")
    columns = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    total = kept.count()
    if not total:
        return kept.sparkSession.createDataFrame([], columns)
    books = train_codebooks(kept, dim, parts=parts, entries=entries, rounds=rounds)
    text = ",".join(str(x) for book in books for x in book.ravel().tolist())
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        for batch in batches:
            for part in slices(batch, 1024):
                codes, errors = assign(matrix(part.column(2), dim), own)
                code = [x.tobytes().hex() for x in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code), pa.array(errors.sum(axis=1))], ["vec_id", "_label", "code", "error"])

    label = dict(kept.dtypes)["label"]
    coded = materialise(map_batches(kept, ["vec_id", "label", "q"], f"vec_id long, _label {label}, code string, error long", run), "codes")
    coded = coded.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit("")))
    sums = coded.groupBy("_key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_rows"))
    return join_skewed(coded, sums, "_key", total).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
