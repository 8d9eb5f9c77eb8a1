"""SimHash near-duplicates by a grid join on segment bit counts.

A fingerprint of 64 bits is embedded as its bit counts in 32 segments of 2 bits. The Manhattan
distance of two embeddings is never above the Hamming distance of the fingerprints, so pairs
within max_bits are looked for among pairs of embeddings within max_bits, and then verified.
The embedding is kept as a long in unary (counts 0, 1, 2 as 00, 01, 11), in which the Manhattan
distance is the number of differing bits.

The range join: the segments are cut into blocks, max_bits more than are compared. Two embeddings
at most max_bits apart differ in at most max_bits blocks, so they share the grid cell of one of
the choices of the other blocks. Cells are joined by equality. Distinct fingerprints take part
once, whatever the number of documents behind them.

A cell of more than CROWDED fingerprints would give pairs with the square of its size. Its
members are dealt again into a finer grid, of more and smaller blocks, whose cells fix more of
the embedding. What is crowded even in the finest grid goes another, exact way: each fingerprint
is listed under itself and under its neighbours at one bit. For 2 bits two fingerprints meet in
such a list exactly if they are within 2 bits of each other, and a list never has more than 65
members, so each member is linked to the least of its list. For another max_bits the finest
cells are joined like the rest.

Results for special input: a null or empty text has no words and fingerprint zero, which links
like any other; rows with the same doc_id count as documents of their own; a null doc_id has a
fingerprint and takes its group's component_id (null if the group has no other id); an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import map_batches, materialise, slices, utf8
from pairloom.plans.components import connected_components, join_skewed

#: Ids that are broadcast at most; beyond it they are joined by a shuffle.
FEW_IDS = 2_000_000

#: Fingerprints of a cell beyond which its members go into the next grid, and by how many the blocks of each grid outnumber max_bits.
CROWDED, GRIDS = 32, (3, 6, 14)
BITS = 64


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The text's fingerprint as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 1 << 16):
        ones += bits[at : at + (1 << 16)].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, words_per_shingle: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, words_per_shingle, seed) for t in utf8(part.column(1))], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs, [id_column, text_column], "doc_id long, fp long", run)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(max_bits: int, fixed: int = 3) -> list[int]:
    """For each choice of `fixed` of max_bits + fixed blocks the bits of their segments."""
    blocks = np.array_split(np.arange(BITS // 2), max_bits + fixed)
    of = [sum(3 << int(2 * s) for s in b) for b in blocks]
    return [_signed(sum(of[b] for b in chosen)) for chosen in combinations(range(max_bits + fixed), fixed)]


def embedding(fp):
    """Segment bit counts in unary: the pair's bits, with a single set bit moved to the low place."""
    low, odd = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    return (fp.bitwiseOR(low).bitwiseAND(odd)).bitwiseOR(F.shiftleft(fp.bitwiseAND(low).bitwiseAND(odd), 1))


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (src, dst) between the distinct fingerprints in column fp whose components are those of all pairs within max_bits."""
    rows, found = distinct.select("fp"), []
    for fixed in GRIDS:
        cells = F.array(*(F.struct(F.lit(n).alias("choice"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for n, m in enumerate(cell_masks(max_bits, fixed))))
        keyed = rows.select("fp", embedding(F.col("fp")).alias("e")).select("fp", "e", F.explode(cells).alias("c")).select("fp", "e", "c.choice", "c.cell")
        shared = keyed.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
        met = materialise(keyed.join(shared, ["choice", "cell"]), "cells")
        last = fixed == GRIDS[-1]
        calm = met if last and max_bits != 2 else met.where(F.col("n") <= CROWDED)
        a, b = calm.alias("a"), calm.alias("b")
        near = (
            (F.col("a.choice") == F.col("b.choice"))
            & (F.col("a.cell") == F.col("b.cell"))
            & (F.col("a.fp") < F.col("b.fp"))
            & (F.bit_count(F.col("a.e").bitwiseXOR(F.col("b.e"))) <= max_bits)
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
        )
        found.append(a.join(b, near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct())
        rows = met.where(F.col("n") > CROWDED).select("fp").distinct()
        if rows.isEmpty():
            break
    else:
        if max_bits == 2:
            at_one_bit = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)))
            lists = rows.select("fp", F.explode(at_one_bit).alias("near"))
            least = lists.select("fp", F.min("fp").over(Window.partitionBy("near")).alias("dst")).where("fp <> dst")
            found.append(least.select(F.col("fp").alias("src"), "dst").distinct())
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def near_duplicates(docs: DataFrame, *, max_bits: int = 2, words_per_shingle: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (least doc_id of the group) of each row."""
    fps = materialise(fingerprints(docs, words_per_shingle=words_per_shingle, seed=seed, id_column=id_column, text_column=text_column), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_rows")), "distinct")
    groups = materialise(connected_components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp"), "groups")
    least = distinct.join(groups, "fp").groupBy("component").agg(F.min("first_id").alias("least_id"))
    ids = distinct.join(groups.join(least, "component"), "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), "_rows")
    named = join_skewed(fps, materialise(ids, "ids"), "fp", fps.count())
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, max_bits: int = 2, words_per_shingle: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which each group keeps the one with the least id.

    Of rows that share an id one stays at most, the first by text. Rows with a null id stay.
    """
    groups = near_duplicates(docs, max_bits=max_bits, words_per_shingle=words_per_shingle, seed=seed, id_column=id_column, text_column=text_column)
    ids = materialise(groups.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("stays"), F.count("*").alias("n")), "ids")

    def few(found: DataFrame) -> DataFrame:
        return F.broadcast(found) if found.count() <= FEW_IDS else found

    names = [f"c{k}" for k in range(len(docs.columns))]  # any names, none of which is used here
    plain, at, of = docs.toDF(*names), names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    gone = few(ids.where("not stays").select("doc_id"))
    kept = plain.join(gone, plain[at] == gone["doc_id"], "left_anti")
    repeated = ids.where("stays and n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.toDF(*docs.columns)
    again = few(repeated)
    once = kept.join(again, kept[at] == again["doc_id"], "left_anti")
    rows = kept.join(again, kept[at] == again["doc_id"], "left_semi")
    first = rows.groupBy(at).agg(F.min_by(F.struct(*names), F.struct(of)).alias("r")).select("r.*")
    return once.unionByName(first).toDF(*docs.columns)
