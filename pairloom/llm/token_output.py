"""Token-id output: one id array per shard with Elias-Fano coded document boundaries.

File format (version 1, little-endian): a shard is one byte string
    magic "EFT1" | u32 id width in bytes (2 or 4) | u64 documents | u64 ids | u32 low bits L | u64 length of the high part in bytes
    | i64 doc_id for each document | presence bits of doc_id | low part | high part | ids
The boundaries 0 = b0 <= b1 <= ... <= bn = ids are a monotone sequence. Each b is cut into L low
bits, packed, and a high rest, written in unary: bit (b >> L) + i is set for boundary i. That
takes about 2 + log2(ids / documents) bits a document. Boundary i is found by select(i) on the
high part, with a directory of one count per 64-byte block built on opening.

Shards lie as rows of a Parquet table in the shared folder: Spark's committer makes the write
atomic, tasks that are run again replace their own output, and any store that Spark writes works.
A partition holds one range of doc_id; its shards follow one another in ascending doc_id, and a
shard holds about shard_ids ids, never less than one whole document.

Results for special input: a null or empty text is its end id alone; rows with the same doc_id
are all written, the shorter first, then by checksum; a null doc_id comes before all others;
an empty table gives no shard and no row; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import map_batches, materialise, slices, utf8
from pairloom.llm.encoding import encoder

#: Ids a shard holds before the next one begins.
SHARD_IDS = 1 << 20
#: Bytes of text for each range of doc_id, ranges at most (their bounds are held by the driver and every task), and documents whose offsets are selected at once.
PART_BYTES, MOST_PARTS, READ_DOCS = 16 << 20, 10_000, 4096
HEAD = struct.Struct("<4sIQQIQ")


class EliasFano:
    """A monotone sequence of integers in near-minimal space, with select by block counts of 32 bits."""

    BLOCK = 64

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        if count >= 1 << 32:
            raise ValueError("a shard holds fewer than 2^32 documents")
        ones = np.add.reduceat(np.bitwise_count(high), np.arange(0, len(high), self.BLOCK), dtype=np.uint32) if len(high) else np.zeros(0, np.uint32)
        self.before = np.append(np.uint32(0), np.cumsum(ones, dtype=np.uint32))

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        marks[at] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little"))

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.int64)
        bit = index[:, None] * self.low_bits + np.arange(self.low_bits)
        got = (self.low[bit >> 3] >> (bit & 7)) & 1
        return (got.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, first: int, n: int = 1) -> np.ndarray:
        """Values first, first + 1, ... (n of them): the blocks that hold their set bits by bisection, then the places inside."""
        if not 0 <= first <= first + n <= self.count:
            raise IndexError(first)
        index = np.arange(first, first + n)
        if not n:
            return index
        begin = int(np.searchsorted(self.before, first, side="right")) - 1
        end = int(np.searchsorted(self.before, first + n - 1, side="right"))
        part = np.unpackbits(self.high[begin * self.BLOCK : end * self.BLOCK], bitorder="little")
        skip = first - int(self.before[begin])
        place = np.flatnonzero(part)[skip : skip + n] + begin * self.BLOCK * 8
        return ((place - index) << self.low_bits) | self._low(index)

    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes


def write_shard(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard of the documents, whose ids are unsigned 32-bit bytes."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    ends = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]))
    flat = np.frombuffer(b"".join(ids), "<u4")
    known = np.packbits(np.array([d is not None for d in doc_ids], np.uint8), bitorder="little")
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join((HEAD.pack(b"EFT1", width, len(ids), len(flat), ends.low_bits, ends.high.nbytes), names.tobytes(), known.tobytes(), ends.low.tobytes(), ends.high.tobytes(), flat.astype(f"<u{width}").tobytes()))


class Shard:
    """An opened shard: document i has ids(i) at offset(i)."""

    def __init__(self, blob: bytes):
        magic, width, self.n_docs, self.n_ids, bits, high = HEAD.unpack_from(blob)
        if magic != b"EFT1":
            raise ValueError("not a token shard")
        at = HEAD.size
        n = self.n_docs
        names = np.frombuffer(blob, "<i8", n, at)
        at += 8 * n
        there = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at), bitorder="little")[:n]
        at += -(-n // 8)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(names, there, strict=True)]
        low = np.frombuffer(blob, np.uint8, -(-(n + 1) * bits // 8), at)
        at += low.nbytes
        self.ends = EliasFano(n + 1, bits, low, np.frombuffer(blob, np.uint8, high, at))
        self.flat = np.frombuffer(blob, f"<u{width}", self.n_ids, at + high)

    def offset(self, i: int) -> int:
        return int(self.ends.select(i)[0])

    def ids(self, i: int) -> np.ndarray:
        a, b = self.ends.select(i, 2).tolist()
        return self.flat[a:b].astype("<u4")


def _ranges(docs: DataFrame, id_column: str, text_column: str, parts: int | None) -> list[float]:
    """Bounds that cut doc_id into ranges of about as many rows, one for PART_BYTES of text."""
    if parts is None:
        total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
        parts = min(MOST_PARTS, -(-total // PART_BYTES))
    if parts < 2:
        return []
    share = [k / parts for k in range(1, parts)]
    got = docs.select(F.col(id_column).cast("double").alias("x")).agg(F.percentile_approx("x", share, 10_000)).first()[0]
    return sorted(set(got or []))


def write_token_shards(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS, parts: int | None = None) -> DataFrame:
    """Encode all texts and write them as shards, ordered by id; returns the written table.

    Its columns: part int, shard int (both ascending with doc_id), before long (ids of the part
    that lie in earlier shards), n_docs long, n_ids long, blob binary. Rows are encoded once,
    before the only shuffle, which moves ids and no texts. The number of ranges follows the
    texts' bytes; a range is sorted (and spilled) by Spark and written shard by shard, so a task
    holds one shard, however many rows have one doc_id.
    """
    bounds = np.array(_ranges(docs, id_column, text_column, parts))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                names = part.column(0).cast(pa.int64())
                ids = [x + end for x in enc.encode(utf8(part.column(1)))]
                small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids] if narrow else ids
                where = np.searchsorted(bounds, np.array([float("-inf") if x is None else x for x in names.to_pylist()], float), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), names, pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(small, pa.binary())], ["part", "doc_id", "crc", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before, held, names, ids = None, 0, 0, 0, [], []

        def row() -> pa.RecordBatch:
            blob = write_shard(names, ids, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["part", "shard", "before", "n_docs", "n_ids", "blob"])

        for batch in batches:
            for p, name, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(x, "<u2").astype("<u4").tobytes() if narrow else x
                if ids and (p != part or held + len(x) // 4 > shard_ids):
                    yield row()
                    shard, before = (shard + 1, before + held) if p == part else (0, 0)
                    held, names, ids = 0, [], []
                part = p
                names.append(name)
                ids.append(x)
                held += len(x) // 4
        if ids:
            yield row()

    narrow = max(encoder(tokenizer_path).library.get_vocab_size(), end_id + 1) <= 1 << 16
    width = 2 if narrow else 4
    coded = map_batches(docs, [id_column, text_column], "part int, doc_id long, crc long, ids binary", encode)
    dealt = coded.repartitionById(max(1, len(bounds) + 1), F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.length("ids"), "crc")
    return materialise(dealt.select("part", "doc_id", "ids").mapInArrow(write, "part int, shard int, before long, n_docs long, n_ids long, blob binary"), "token-shards")


def read_token_index(shards: DataFrame) -> DataFrame:
    """Read the written shards back: each document's place, length and checksum.

    What reaches the driver is one total per range of doc_id, as many as there are partitions.
    """
    totals = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())
    starts = dict(zip((p for p, _ in totals), np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist(), strict=False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                shard = Shard(blob)
                for at in range(0, shard.n_docs, READ_DOCS):
                    n = min(READ_DOCS, shard.n_docs - at)
                    ends = shard.ends.select(at, n + 1)
                    ids = [shard.flat[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[at : at + n], pa.int64()), pa.array(starts[part] + before + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "blob").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
