"""Cost-balanced packing of documents into sequences of bounded length.

The cost of a piece of n tokens is linear * n + quadratic * n * n, the second part standing for
attention inside the piece. Documents are taken in descending cost; each goes to the sequence of
lowest cost that still has room for all of it. If none has, it is cut where the roomiest sequence
is full and goes on with the rest.

Packing needs no shuffle: each task packs the documents it has encoded in groups of about
group_tokens tokens. The sequences of a group have room for exactly its tokens: whole ones first,
and for the rest one sequence for each power of two in it, since a sequence whose length is a
power of two needs no padding. Results depend on a partition's rows only, so a task run again
gives the same pieces.

Results for special input: a null or empty text is its end id alone; rows with the same doc_id
are separate documents (the column row tells them apart inside a sequence's partition); a null
doc_id stays null; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairloom.llm.common import map_batches, slices, utf8
from pairloom.llm.encoding import encoder

#: Tokens that are packed together; the memory a task needs follows it, the result's padding doesn't.
GROUP_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def room(tokens: int, capacity: int) -> list[int]:
    """Lengths of a group's sequences: as many whole ones as fit, then the powers of two of the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << k for k in reversed(range(capacity.bit_length())) if rest >> k & 1]


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the sequences' lengths.

    A document longer than a sequence gives up whole sequences first; its rest is packed like any other.
    """
    rooms = room(sum(lengths), capacity)
    left = np.array(rooms, np.int64)
    cost = np.zeros(len(rooms))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, rooms[seq] - int(left[seq])))
        left[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    begun = [0] * len(lengths)
    fresh = 0
    for doc, n in enumerate(lengths):
        while n - begun[doc] >= capacity:
            put(doc, begun[doc], capacity, fresh)
            begun[doc] += capacity
            fresh += 1
    for doc in sorted(range(len(lengths)), key=lambda d: (begun[d] - lengths[d], d)):
        while begun[doc] < lengths[doc]:
            n = lengths[doc] - begun[doc]
            open_to = np.flatnonzero(left >= n)
            seq = int(open_to[np.argmin(cost[open_to])]) if len(open_to) else int(np.argmax(left))
            n = min(n, int(left[seq]))
            put(doc, begun[doc], n, seq)
            begun[doc] += n
    return pieces, rooms


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", group_tokens: int = GROUP_TOKENS, linear: float = 1.0, quadratic: float = 1.0 / 4096, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the column ids (unsigned 32-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, tokens
            lengths = [len(x) // 4 for x in held]
            pieces, rooms = pack(lengths, capacity, linear, quadratic)
            doc, start, n, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            ids = [held[d][4 * a : 4 * (a + k)] for d, a, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
            out = [pa.array([names[d] for d in doc.tolist()], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, n, [zlib.crc32(x) for x in ids], np.array(lengths)[doc], seq + first, offset, np.array(rooms)[seq]))]
            first += len(rooms)
            tokens = 0
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, fields)

        for batch in batches:
            for part in slices(batch):
                for name, ids in zip(part.column(0).cast(pa.int64()).to_pylist(), enc.encode(utf8(part.column(1))), strict=True):
                    names.append(name)
                    held.append(ids + end)
                    tokens += len(ids) // 4 + 1
                    if tokens >= group_tokens:
                        yield flush()
        if held:
            yield flush()

    schema = SCHEMA + ", ids binary" * with_ids
    fields = [x.split()[0] for x in schema.split(", ")]
    return map_batches(docs, [id_column, text_column], schema, run)
