"""Benchmark decontamination by a prefix-filtered join of windows and documents.

A window is a run of `window` consecutive words of an item (all of it, if it has fewer). Its
tokens are its shingles of up to three words. Shingles are ordered by rarity, which is their
count over all documents. For a window of n shingles to be contained to the share
`containment` at one place of a document, at least ceil(containment * n) of its shingles must
stand there, so at least one of its n - ceil(containment * n) + 1 rarest does (for full
containment the rarest alone). Only those prefixes are joined with the documents' shingles.
A match fixes the place where the window would begin; the place must lie inside the document
with room for the whole window (length and position bounds). What remains is compared word by
word over the item-sized window.

The benchmark is the query set. It is cut into blocks of a bounded number of words, and only a
block's index goes to the tasks at once; one more block is one more pass over the documents, so
a benchmark of any size works. Documents stay where they are: nothing but shingle counts (per
task at most one row for each benchmark shingle) and, for several blocks, the hit places move.

Results for special input: a null or empty text has no words; null item_ids hit words but are
not named; rows with the same item_id are one item; rows with the same doc_id are separate
documents; an empty table gives no row, an empty benchmark no hit; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import keep_rows, slices, utf8
from pairloom.plans.scratch import drop_scratch, materialise

#: Words of the benchmark whose index is sent to the tasks at once (about 100 bytes a word there).
BLOCK_WORDS = 1 << 20
SHINGLE = 3
#: Fixed value: ASCII bytes that are not a letter or a digit part words; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Index:
    """Windows of a block of items, found by their rarest shingles."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, containment: float = 1.0):
        self.names: list[str | None] = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        seqs = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in items]
        self.flat = np.concatenate([*seqs, np.zeros(0, np.int64)])
        base = np.cumsum([0, *map(len, seqs)])
        start, size, item = [], [], []
        for k, seq in enumerate(seqs):
            n = max(0, len(seq) - window) + 1 if len(seq) else 0
            start.append(base[k] + np.arange(n))
            size.append(np.full(n, min(window, len(seq))))
            item.append(np.full(n, k))
        self.start, self.size, self.item = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (start, size, item))
        self.containment = containment
        self.pairs: list[np.ndarray] = []  # two words are numbered among the block's pairs of words, a number and a word among those
        for _ in range(SHINGLE - 1):
            codes = self._codes(self.flat, len(self.pairs) + 1)
            n = max(0, len(self.flat) - len(self.pairs) - 1)
            self.pairs.append(np.unique((codes[:n] << 32) | self.flat[len(self.flat) - n :]))
        self.shingles = {k: np.unique(self._codes(self.flat, k)[self._inside(k)]) for k in range(1, SHINGLE + 1)}

    def _widths(self) -> np.ndarray:
        return np.minimum(self.size, SHINGLE)

    def _codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Each run of k words of the block as one number, for any number of different words."""
        out = ids
        for j in range(1, k):
            n = max(0, len(ids) - j)
            out = np.searchsorted(self.pairs[j - 1], (out[:n] << 32) | ids[len(ids) - n :])
        return out

    def _inside(self, k: int) -> np.ndarray:
        """Places of shingles of k words that lie in a window of that shingle width."""
        mark = np.zeros(len(self.flat) + 1, np.int64)
        own = self._widths() == k
        np.add.at(mark, self.start[own], 1)
        np.add.at(mark, self.start[own] + self.size[own] - k + 1, -1)
        return np.flatnonzero(np.cumsum(mark)[: max(0, len(self.flat) - k + 1)])

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def found(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document of the block's shingles of k words, and which they are."""
        known, all_known = self.shingles[k], ids > 0
        n = len(ids) - k + 1
        if n <= 0 or not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = all_known[:n].copy()
        for j in range(1, k):
            ok &= all_known[j : n + j]
        at = np.flatnonzero(ok)
        code = ids[at]
        for j in range(1, k):
            step = (code << 32) | ids[at + j]
            code = np.searchsorted(self.pairs[j - 1], step)
            there = self.pairs[j - 1][np.minimum(code, len(self.pairs[j - 1]) - 1)] == step
            at, code = at[there], code[there]
        which = np.searchsorted(known, code)
        hit = known[np.minimum(which, len(known) - 1)] == code
        return at[hit], which[hit]

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's prefix by the shingles' counts over all documents."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, known in self.shingles.items():
            own = np.flatnonzero(self._widths() == k)
            codes = self._codes(self.flat, k)
            which, windows, offsets = [], [], []
            for size in np.unique(self.size[own]):
                w = own[self.size[own] == size]
                n = int(size) - k + 1
                inside = np.searchsorted(known, codes[self.start[w][:, None] + np.arange(n)])
                rarity = np.argsort(counts[k][inside], axis=1, kind="stable")[:, : n - ceil(self.containment * n - 1e-9) + 1]
                which.append(np.take_along_axis(inside, rarity, 1).ravel())
                windows.append(np.repeat(w, rarity.shape[1]))
                offsets.append(rarity.ravel())
            which, windows, offsets = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (which, windows, offsets))
            by = np.argsort(which, kind="stable")
            self.prefix[k] = (np.searchsorted(which[by], np.arange(len(known) + 1)), windows[by], offsets[by])

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur in a document, and where each begins."""
        windows, places = [], []
        for k, (bounds, of, offset) in self.prefix.items():
            at, which = self.found(ids, k)
            n = bounds[which + 1] - bounds[which]
            at, which, n = at[n > 0], which[n > 0], n[n > 0]
            if not len(at):
                continue
            entry = np.repeat(bounds[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = of[entry]
            begin = np.repeat(at, n) - offset[entry]
            fits = (begin >= 0) & (begin + self.size[w] <= len(ids))
            w, begin = w[fits], begin[fits]
            for size in np.unique(self.size[w]):
                sel = np.flatnonzero(self.size[w] == size)
                for part in np.array_split(sel, len(sel) * int(size) // (1 << 22) + 1):
                    same = ids[begin[part][:, None] + np.arange(size)] == self.flat[self.start[w[part]][:, None] + np.arange(size)]
                    if self.containment < 1:
                        whole = np.lib.stride_tricks.sliding_window_view(same, min(SHINGLE, int(size)), axis=1).all(axis=2)
                        good = whole.sum(axis=1) >= ceil(self.containment * whole.shape[1] - 1e-9)
                    else:
                        good = same.all(axis=1)
                    windows.append(w[part][good])
                    places.append(begin[part][good])
        none = np.zeros(0, np.int64)
        return np.concatenate([*windows, none]), np.concatenate([*places, none])


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items, block after block, each of a bounded number of words; the driver holds one at a time."""
    items = benchmark.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // (3 * block_words)) or 1
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        if got := sorted(((r.id, (r.text or "").encode()) for r in own.toLocalIterator()), key=lambda x: (x[0] or "", x[1])):
            yield got


def _rarity(docs: DataFrame, text_column: str, shared) -> dict[int, np.ndarray]:
    """Count of each of the block's shingles over all documents, summed inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        counts = {k: np.zeros(len(v), np.int64) for k, v in index.shingles.items()}
        for batch in batches:
            for text in utf8(batch.column(0)):
                ids = index.number(words_of(text))
                for k, of in counts.items():
                    if len(of):
                        np.add.at(of, index.found(ids, k)[1], 1)
        for k, of in counts.items():
            seen = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k), pa.int32()), pa.array(seen), pa.array(of[seen])], ["k", "shingle", "n"])

    got = docs.select(text_column).mapInArrow(run, "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(len(v), np.int64) for k, v in shared.value.shingles.items()}
    for k, of in out.items():
        own = got[got.k == k]
        of[own.shingle.to_numpy()] = own.n.to_numpy()
    return out


def _report(doc_id: pa.Array, n_words: list[int], n_hit: list[int], items: list[list[str]]) -> pa.RecordBatch:
    named = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(named, pa.string()), pa.array([n > 0 for n in n_hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, containment: float = 1.0, block_words: int = BLOCK_WORDS, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """For each document its words, the words inside occurring windows, and the items those belong to."""
    sc = docs.sparkSession.sparkContext
    blocks = []
    for items in _blocks(benchmark, item_column, item_text_column, block_words):
        index = Index(items, window, containment)
        shared = sc.broadcast(index)
        index.order(_rarity(docs, text_column, shared))
        shared.unpersist()
        blocks.append(sc.broadcast(index))
        if len(blocks) > 1:
            blocks[-2:] = [_merge_later(docs, b, id_column, text_column) if not isinstance(b, DataFrame) else b for b in blocks[-2:]]
    if not blocks:
        blocks = [sc.broadcast(_empty(window))]
    if len(blocks) == 1:
        return _one_block(docs, blocks[0], id_column, text_column)
    return _merged(blocks)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, containment: float = 1.0, block_words: int = BLOCK_WORDS, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows in which no window occurs, with all their columns.

    One block after another filters them. What a block keeps is written before the next block's
    turn, so a task holds one block's index at a time.
    """
    sc = docs.sparkSession.sparkContext
    kept, shared, written = docs, None, None
    for items in _blocks(benchmark, item_column, item_text_column, block_words):
        if shared is not None:
            before, written = written, materialise(kept, "clean")
            kept = written
            shared.unpersist()
            if before is not None:
                drop_scratch(before)
        index = Index(items, window, containment)
        counted = sc.broadcast(index)
        index.order(_rarity(docs, text_column, counted))
        counted.unpersist()
        shared = sc.broadcast(index)
        kept = keep_rows(kept, text_column, _clean_of(shared))
    return kept


def _clean_of(shared):
    def kept(texts: list[bytes]) -> list[bool]:
        index: Index = shared.value
        return [not len(index.hits(index.number(words_of(t)))[0]) for t in texts]

    return kept


def _empty(window: int) -> Index:
    index = Index([], window)
    index.order({k: np.zeros(0, np.int64) for k in index.shingles})
    return index


def _hit_words(index: Index, windows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, places, 1)
    np.add.at(mark, places + index.size[windows], -1)
    return np.cumsum(mark)[:n] > 0


def _one_block(docs: DataFrame, shared, id_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for part in slices(batch):
                n_words, n_hit, items = [], [], []
                for text in utf8(part.column(1)):
                    words = words_of(text)
                    windows, places = index.hits(index.number(words))
                    n_words.append(len(words))
                    n_hit.append(int(_hit_words(index, windows, places, len(words)).sum()) if len(windows) else 0)
                    items.append(list({index.names[k] for k in np.unique(index.item[windows]).tolist()} - {None}))
                yield _report(part.column(0).cast(pa.int64()), n_words, n_hit, items)

    return docs.select(id_column, text_column).mapInArrow(run, SCHEMA)


def _merge_later(docs: DataFrame, shared, id_column: str, text_column: str) -> DataFrame:
    """A block's hits: for each document the runs of hit words and the items; keyed by id and checksum of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], []]
                for text in utf8(part.column(1)):
                    words = words_of(text)
                    windows, places = index.hits(index.number(words))
                    edge = np.flatnonzero(np.diff(_hit_words(index, windows, places, len(words)).astype(np.int8), prepend=0, append=0))
                    for column, value in zip(out, (hashlib.sha256(text).digest(), len(words), edge.tolist(), list({index.names[k] for k in np.unique(index.item[windows]).tolist()} - {None})), strict=True):
                        column.append(value)
                kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "sum", "n_words", "edges", "items"])

    got = docs.select(id_column, text_column).mapInArrow(run, "doc_id long, sum binary, n_words long, edges array<long>, items array<string>")
    done = materialise(got, "hits")
    shared.unpersist()
    return done


def _merged(blocks: list[DataFrame]) -> DataFrame:
    """Unite the blocks' hits. Rows alike in id and text have alike hits, so one of them is worked out and counted."""
    first, *others = (b.groupBy("doc_id", "sum").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("edges").alias("edges"), F.first("items").alias("items")) for b in blocks)
    rows = first.select("doc_id", "sum", "copies", "n_words", F.array("edges").alias("edges"), "items")
    for b in others:
        other = b.select(F.col("doc_id").alias("d2"), F.col("sum").alias("s2"), F.col("edges").alias("e2"), F.col("items").alias("i2"))
        rows = rows.join(other, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("sum") == F.col("s2"))).select("doc_id", "sum", "copies", "n_words", F.concat("edges", F.array("e2")).alias("edges"), F.array_union("items", "i2").alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            n_hit = []
            for n, edges in zip(d["n_words"], d["edges"], strict=True):
                mark = np.zeros(n + 1, np.int64)
                for e in edges:
                    np.add.at(mark, np.array(e[::2], np.int64), 1)
                    np.add.at(mark, np.array(e[1::2], np.int64), -1)
                n_hit.append(int((np.cumsum(mark)[:n] > 0).sum()))
            copies = np.repeat(np.arange(batch.num_rows), d["copies"])
            yield _report(batch.column(0), d["n_words"], n_hit, d["items"]).take(pa.array(copies))

    return rows.select("doc_id", "copies", "n_words", "edges", "items").mapInArrow(run, SCHEMA)
