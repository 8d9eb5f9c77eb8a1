"""Best-fit packing of documents into as few sequences as possible, improved by local search.

Only documents longer than a sequence are cut: whole sequences first, the rest is a piece like
any other. Pieces are packed by best fit in descending order, and then sequences that are not
full trade pieces: a piece moves, or is exchanged for a shorter one, or for two shorter ones, or
two are exchanged for a longer one. A trade carries length to a fuller sequence from the emptiest
one, so the sum of squared fills grows with each and the search ends; an emptied sequence is gone.

A task packs what it encodes in groups of bounded numbers of pieces. Sequences that stay open
(more than `slack` tokens short) are taken apart again and their pieces dealt into new groups,
from all tasks together, as long as the groups become half as many at least. What moves then are open
sequences only, a few for each group. Results depend on a partition's rows, and each round is
written before the next one reads it.

Results for special input: a null or empty text is its end id alone; rows with the same doc_id
are separate documents; a null doc_id stays null; an empty table gives no piece; other columns
are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import map_batches, slices, utf8
from pairloom.llm.encoding import encoder
from pairloom.plans.scratch import materialise

#: Pieces that are packed together, and tokens of those a task holds; memory follows them.
GROUP_PIECES, GROUP_TOKENS = 1 << 14, 1 << 23
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece: longest first, each where the least room is left over."""
    of = np.zeros(len(lengths), np.int64)
    rooms: list[int] = []  # room of open sequences, ascending
    at: dict[int, list[int]] = {}
    n = 0
    for p in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[p])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            seq = at[room].pop()
            if not at[room]:
                rooms.pop(k)
        else:
            room, seq, n = capacity, n, n + 1
        of[p] = seq
        if left := room - size:
            if not at.get(left):
                at[left] = []
                insort(rooms, left)
            at[left].append(seq)
    return of


def trade(lengths: np.ndarray, of: np.ndarray, capacity: int) -> np.ndarray:
    """Local search from an assignment: the emptiest sequence gives length to others until none gains.

    A sequence that can give nothing more is put aside as a giver, though not as a taker.
    """
    of, fill = of.copy(), np.bincount(of, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    done: set[int] = set()
    sequences = np.count_nonzero(fill)
    while sequences > least:
        open_to = np.flatnonzero((fill > 0) & (fill < capacity))
        givers = [s for s in open_to[np.argsort(fill[open_to], kind="stable")].tolist() if s not in done]
        if not givers or len(open_to) < 2:
            break
        giver = givers[0]
        pieces = np.flatnonzero((fill[of] < capacity) & (of != giver))  # of the takers
        if not _give(lengths, of, fill, giver, pieces, open_to[open_to != giver], capacity):
            done.add(giver)
        elif not fill[giver]:
            sequences -= 1
    return of


def _pairs(lengths: np.ndarray, of: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of pieces that share a sequence."""
    pieces = pieces[np.argsort(of[pieces], kind="stable")]
    own = of[pieces]
    ends = np.searchsorted(own, own, "right")
    after = ends - np.arange(len(own)) - 1
    first = np.repeat(np.arange(len(own)), after)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)
    return pieces[first], pieces[second]


def _give(lengths: np.ndarray, of: np.ndarray, fill: np.ndarray, giver: int, pieces: np.ndarray, takers: np.ndarray, capacity: int) -> bool:
    """Make the trade that carries the most length away from the giver, if one makes the squared fills grow; whether there is one."""
    own = np.flatnonzero(of == giver)
    room = capacity - fill
    a, b = _pairs(lengths, of, own)
    out = [((int(p),), int(lengths[p])) for p in own] + [((int(p), int(q)), int(lengths[p] + lengths[q])) for p, q in zip(a, b, strict=True)]
    c, d = _pairs(lengths, of, pieces)
    none = np.full(len(pieces), -1)
    singles = (pieces, none, of[pieces], lengths[pieces])
    doubles = (c, d, of[c], lengths[c] + lengths[d])
    nothing = (np.full(len(takers), -1), np.full(len(takers), -1), takers, np.zeros(len(takers), np.int64))
    best, chosen = 0, None
    for given, size in out:
        ways = (nothing, singles, doubles) if len(given) == 1 else (singles,)
        for one, two, seq, back in ways:
            gain = size - back
            gain = np.where((gain > 0) & (gain <= room[seq]) & (fill[seq] + gain > fill[giver]), gain, 0)
            if len(gain) and gain.max() > best:
                k = int(gain.argmax())
                best, chosen = int(gain[k]), (given, [int(x) for x in (one[k], two[k]) if x >= 0], int(seq[k]))
    if chosen is None:
        return False
    given, back, seq = chosen
    of[list(given)] = seq
    of[back] = giver
    fill[seq] += best
    fill[giver] -= best
    return True


def pack_group(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence (0, 1, ...), place in it and its fill for each piece."""
    sizes = np.array(lengths, np.int64)
    of = np.unique(trade(sizes, best_fit(sizes, capacity), capacity), return_inverse=True)[1]
    by = np.lexsort((-sizes, of))
    upto = np.cumsum(sizes[by])
    fill = np.bincount(of, weights=sizes).astype(np.int64)
    offset = np.empty(len(sizes), np.int64)
    offset[by] = upto - sizes[by] - (np.cumsum(fill) - fill)[of[by]]
    return of, offset, fill[of]


def _grouped(rows: Iterator[tuple[list, int]], capacity: int, group_pieces: int, fields: list[str], types: list[pa.DataType], round_: int) -> Iterator[pa.RecordBatch]:
    """Pack pieces (values, length) in groups; sequence_id tells round, task and sequence."""
    first = (round_ << 58) | (TaskContext.get().partitionId() << 34)
    held: list[list] = []
    lengths: list[int] = []

    def flush() -> pa.RecordBatch:
        nonlocal first
        of, offset, fill = pack_group(lengths, capacity)
        columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(of + first), pa.array(offset), pa.array(fill)], fields)
        first += int(of.max()) + 1
        held.clear()
        lengths.clear()
        return out

    tokens = 0
    for values, n in rows:
        held.append(values)
        lengths.append(n)
        tokens += n
        if len(held) >= group_pieces or tokens >= GROUP_TOKENS:
            yield flush()
            tokens = 0
    if held:
        yield flush()


def pack_best_fit(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, slack: int | None = None, group_pieces: int = GROUP_PIECES, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and sequence_length of each piece; with_ids adds ids (unsigned 32-bit, little-endian).

    slack: tokens a sequence may be short of its capacity and count as full, by default a 256th.
    group_pieces should be far more than a sequence has.
    """
    slack = capacity // 256 if slack is None else slack
    piece = PIECE + ", ids binary" * with_ids
    schema = f"{piece}, sequence_id long, offset long, sequence_length long"
    fields = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()

        def pieces() -> Iterator[tuple[list, int]]:
            for batch in batches:
                for part in slices(batch):
                    for name, ids in zip(part.column(0).cast(pa.int64()).to_pylist(), enc.encode(utf8(part.column(1))), strict=True):
                        ids += end
                        for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                            own = ids[4 * start : 4 * (start + capacity)]
                            yield [name, k, start, len(own) // 4, zlib.crc32(own)] + [own] * with_ids, len(own) // 4

        yield from _grouped(pieces(), capacity, group_pieces, fields, types, 0)

    def again(batches: Iterator[pa.RecordBatch], round_: int) -> Iterator[pa.RecordBatch]:
        rows = ((list(r), r[3]) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _grouped(rows, capacity, group_pieces, fields, types, round_)

    now = materialise(map_batches(docs, [id_column, text_column], schema, encode), "packed")
    done, groups = [], None
    while True:
        is_open = F.col("sequence_length") < capacity - slack
        n, tokens = now.where(is_open).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        parts = max(-(-n // group_pieces), -(-tokens // GROUP_TOKENS))
        if not n or groups is not None and (groups == 1 or 2 * parts > groups):
            break
        groups = parts
        done.append(now.where(~is_open))
        dealt = now.where(is_open).select(*fields[: len(types)], F.xxhash64("sequence_id", "offset").alias("_deal")).repartition(parts, "_deal").drop("_deal")
        now = materialise(dealt.mapInArrow(lambda batches, round_=len(done): again(batches, round_), schema), "packed")
    for full in done:
        now = now.unionByName(full)
    return now
