"""Near copies by SimHash: a grid join on segment bit counts, and the Jaccard similarity of word shingles as the exact check.

Two texts are linked if the sets of their shingles (64-bit hashes) have a Jaccard similarity of
at least `similarity`; groups are the components of these links. A text's fingerprint is the
SimHash of its set, of WORDS words of 64 bits, since texts of similarity 0.8 differ in 15 % of
the bits, which few bits don't tell from chance. As in simhash.py it is embedded as its bit
counts in segments of two bits, in unary; the Manhattan distance of embeddings is never above
the Hamming distance of fingerprints. A grid's cell is what the embedding has in some segments.
There are GRIDS grids, each of other segments, as many as make cells small: they are finer for
more texts. Texts of one cell are looked at if their embeddings are within RADIUS, then if their
fingerprints are, and are then compared by their whole texts.

Texts with equal sets, by 128 bits of hashes, are taken together first. In each cell the set that meets others most often,
as the text does that the others are copies of, is compared with the rest, so that a crowded
cell makes no pairs of all its sets. Most copies are then in one group. What sets of different
groups still have in common, beyond the grids' reach or in crowded cells, goes through an exact join by prefixes:
shingles are ordered by rarity, two sets similar enough share one of the
n - ceil(similarity * n) + 1 rarest of each, so only these are joined, and a passage or a text
that many sets share makes no pairs of all of them. The sharper bound for a partner of a given
size holds as well: rows are joined by shingle and classes of sizes, each with those partners
only for which its place in the order is early enough. These candidates too are left out if
their fingerprints differ in more than RADIUS bits, which is five standard deviations above what
sets of similarity 0.8 differ in at most, those of four and five shingles (1e-6). The others are
compared by their whole texts: only these texts move, one for each different set.

Results for special input: texts without a word are copies of each other; a text of fewer words
than a shingle is one shingle; rows with a null id stay and link nothing; rows with the same id
count as documents of their own, but for those of equal text, of which one stays; an empty table
gives no row; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import give_back, materialise, slices, utf8
from pairloom.llm.simhash import embedding
from pairloom.plans.components import connected_components
from pairloom.plans.scratch import drop_scratch

#: Words of 64 bits of a fingerprint; bits that two fingerprints differ in at most.
WORDS, RADIUS = 4, 80
SEGMENTS = 32 * WORDS
#: Grids, and cells of each for every set: a finer grid makes fewer chance meetings and misses more near copies.
GRIDS, SPARE = 128, 4
#: Counters of shingles, by which they are ordered; how many share one changes the speed only.
COUNTERS = 1 << 17
#: Classes of set sizes for each factor of e between sizes; more make finer joins of more rows.
WIDTH = 32
#: Rows of ids that are broadcast at most; beyond it they are joined by a shuffle.
FEW_IDS = 2_000_000
#: Texts that one text is compared with in one place; a text of more pairs is sent to several.
TOGETHER = 256
FACTORS = np.random.default_rng(0).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
ORDERS = np.stack([np.random.default_rng(1 + k).permutation(SEGMENTS) for k in range(GRIDS)])


def shingles(text: bytes, words_per_shingle: int = 5) -> np.ndarray:
    """The different hashes of the text's shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set: a bit is 1 if it is set in over half the mixed hashes; as signed longs."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        x = hashes[at : at + (1 << 14), None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def fineness(sets: int) -> int:
    """Segments that a cell fixes: two texts made by chance agree in one with a probability of 3/8."""
    return max(8, min(34, ceil(log(SPARE * max(1, sets)) / log(8 / 3))))


def cells(sizes: DataFrame, fixed: int) -> DataFrame:
    """key and set for each set's cell in each grid; sizes has set and e (the embedding of the fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 3 ** np.arange(fixed, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 2048):
                e = part.column(1).flatten().to_numpy().astype("<i8").reshape(part.num_rows, WORDS)
                bits = np.unpackbits(e.view(np.uint8), axis=1, bitorder="little")
                counts = (bits[:, ::2] + bits[:, 1::2]).astype(np.int64)
                key = np.stack([counts[:, order[:fixed]] @ powers * GRIDS + k for k, order in enumerate(ORDERS)])
                sets = np.broadcast_to(part.column(0).to_numpy(), key.shape)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(sets.ravel())], ["key", "set"])

    return sizes.select("set", "e").mapInArrow(run, "key long, set long")


def hashed(docs: DataFrame, words_per_shingle: int, id_column: str, text_column: str) -> DataFrame:
    """id, own (a hash of the text), set (a hash of its shingle set), check (a second one), n (the set's size) and f (its fingerprint) of each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words_per_shingle) for t in utf8(part.column(2))]
                f = np.stack([fingerprint(s) for s in sets]) if sets else np.zeros((0, WORDS), np.int64)
                columns = [
                    part.column(0),
                    part.column(1),
                    *(pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)) for seed in (0, 1)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WORDS, pa.int32()), pa.array(f.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "own", "set", "check", "n", "f"])

    x = F.col(id_column)
    rows = docs.where(x.isNotNull()).select(x.alias("id"), own_hash(text_column).alias("own"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_column]}, own long, set long, check long, n long, f array<long>")


def told_apart(rows: DataFrame) -> DataFrame:
    """The rows without check, with a set of its own for each check where one set has several: so sets are equal if 128 bits are."""
    several = rows.groupBy("set").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least < most").select("set", "least")
    several = materialise(several, "several")
    if several.isEmpty():
        return rows.drop("check")
    own = F.when(F.col("check") > F.col("least"), F.xxhash64("set", "check")).otherwise(F.col("set"))
    return rows.join(few(several), "set", "left").withColumn("set", own).drop("check", "least")


def own_hash(text_column: str):
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def few(found: DataFrame) -> DataFrame:
    """Broadcast what is small enough for it."""
    return F.broadcast(found) if found.count() <= FEW_IDS else found


def _texts(named: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """set and one text of each named set."""
    one = rows.join(named, "set", "left_semi").groupBy("set").agg(F.min(F.struct("id", "own")).alias("r")).select("set", "r.id", "r.own")
    found = texts.join(few(materialise(one, "named")), ["id", "own"]).select("set", "text")
    return materialise(found.groupBy("set").agg(F.min("text").alias("text")), "texts")  # of rows alike in id and text


def _towards_hubs(pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) as (src, dst, part): dst is the end that more pairs have, and a part of its pairs has about TOGETHER of them."""
    ends = pairs.select(F.col("src").alias("set")).unionByName(pairs.select(F.col("dst").alias("set")))
    often = few(materialise(ends.groupBy("set").agg(F.count("*").alias("k")).where(F.col("k") > TOGETHER), "often"))
    for end in ("src", "dst"):
        pairs = pairs.join(often.select(F.col("set").alias(end), F.col("k").alias(f"k_{end}")), end, "left")
    k_src, k_dst = (F.coalesce(f"k_{end}", F.lit(0)) for end in ("src", "dst"))
    turned = F.when(k_src > k_dst, F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))).otherwise(F.struct("src", "dst"))
    cut = pairs.select(turned.alias("p"), F.ceil(F.greatest(k_src, k_dst, F.lit(1)) / TOGETHER).alias("parts"))
    return cut.select("p.src", "p.dst", F.pmod(F.xxhash64("p.src"), F.col("parts")).cast("int").alias("part"))


def _similar(pairs: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """The pairs (src, dst) of sets whose similarity is at least that, worked out from one whole text of each; texts has id, own and text.

    The text of dst goes once to each part of its pairs, in front of the texts it is compared with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, b = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                kept = []
                for src, dst, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                    a = shingles(text, words_per_shingle)
                    if src is None:
                        held, b = dst, a
                        kept.append(False)
                        continue
                    if dst != held:
                        raise ValueError("rows have come out of order")
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    kept.append(shared >= similarity * (len(a) + len(b) - shared))
                yield part.select(["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    pairs = materialise(_towards_hubs(pairs), "towards")
    named = pairs.select(F.col("src").alias("set")).unionByName(pairs.select(F.col("dst").alias("set"))).distinct()
    found = _texts(named, rows, texts)
    others = pairs.join(found.select(F.col("set").alias("src"), "text"), "src").select("src", "dst", "text", "part")
    own = pairs.select("dst", "part").distinct().join(found.select(F.col("set").alias("dst"), "text"), "dst")
    both = others.unionByName(own.select(F.lit(None).cast("long").alias("src"), "dst", "text", "part"))
    dealt = both.repartition("dst", "part").sortWithinPartitions("dst", "part", F.col("src").asc_nulls_first()).select("src", "dst", "text")
    out = materialise(dealt.mapInArrow(run, "src long, dst long"), "links")
    drop_scratch(found)
    drop_scratch(pairs)
    return out


def distance(a: str, b: str):
    """Differing bits of two columns of WORDS longs: the Hamming distance of fingerprints, the Manhattan distance of embeddings."""
    bits = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(WORDS)]
    return sum(bits[1:], bits[0])


def _fits(a, b, similarity: float):
    """Sets of sizes a and b can be similar enough."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def prefixes(found: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """set, shingle and place (from 0): of each set in found (set, text) the rarest shingles in order, of which two sets similar enough share one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in utf8(batch.column(0)):
                total += np.bincount((shingles(t, words_per_shingle) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["place", "n"])

    got = found.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[got.column("place").to_numpy()] = got.column("n").to_numpy()
    shared = found.sparkSession.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words_per_shingle) for t in utf8(part.column(1))]
                rarest = [s[np.lexsort((s, shared.value[(s % np.uint64(COUNTERS)).astype(np.int64)]))][: len(s) - ceil(similarity * len(s) - 1e-9) + 1] for s in sets]
                sizes = pa.array(np.repeat(np.arange(len(sets)), list(map(len, rarest))))
                place = np.concatenate([*(np.arange(len(x)) for x in rarest), np.zeros(0, np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(sizes), pa.array(np.concatenate([*rarest, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)), pa.array(place)], ["set", "shingle", "place"])

    return found.select("set", "text").mapInArrow(choose, "set long, shingle long, place long")


def size_class(n):
    """Sizes that differ by less than a WIDTH-th or so have one class; a larger size has no smaller class."""
    return F.floor(F.log(n) * WIDTH).cast("int")


def meetings(keyed: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (src, dst) of sets of different groups that share a shingle of the prefixes for a partner of that size.

    keyed has set, shingle, place, n (the set's size) and c (its group). Sets of sizes n and b that
    are similar enough share x >= (n + b) * similarity / (1 + similarity) shingles, so the first
    shingle they share is at place n - x at most. A row therefore stands for partners of at most
    a certain size, and is joined with sets of such sizes only, by classes of sizes.
    """
    n, place = F.col("n"), F.col("place")
    most = F.least(F.floor((n - place) * ((1 + similarity) / similarity) - n + 1e-6), F.floor(n / similarity + 1e-6))
    rows = keyed.withColumns({"own": size_class(n), "most": most, "least": F.ceil(n * similarity - 1e-6)}).where("most >= least")
    rows = rows.withColumn("other", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most"))))).drop("place", "least")
    groups = rows.groupBy("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    several = groups.agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select(F.col("shingle").alias("s"), "low", "high")
    several = materialise(several, "several")
    met = rows.join(several, (rows.shingle == several.s) & (F.least("own", "other") == several.low) & (F.greatest("own", "other") == several.high), "left_semi")
    met = materialise(met, "met")
    drop_scratch(several)
    a, b = met.alias("a"), met.alias("b")
    apart = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
    apart = apart & (F.col("a.set") < F.col("b.set")) & (F.col("a.c") != F.col("b.c")) & (F.col("a.n") <= F.col("b.most")) & (F.col("b.n") <= F.col("a.most"))
    pairs = materialise(a.join(b, apart).select(F.col("a.set").alias("src"), F.col("b.set").alias("dst")).distinct(), "candidates")
    drop_scratch(met)
    return pairs


def _candidates(open_sets: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """Pairs (src, dst) of sets of different groups that share a shingle of their prefixes; open_sets has set, n and c.

    Each step is written before the next, so that the shuffle of one is gone when the next begins.
    """
    found = _texts(open_sets.select("set"), rows, texts)
    keyed = materialise(prefixes(found, similarity, words_per_shingle).join(open_sets.select("set", "n", "c"), "set", "left"), "prefixes")
    drop_scratch(found)
    shared = keyed.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle")
    shared = materialise(shared, "shared")
    kept = materialise(keyed.join(shared, "shingle", "left_semi"), "kept")
    drop_scratch(keyed)
    drop_scratch(shared)
    pairs = meetings(kept, similarity)
    drop_scratch(kept)
    return pairs


def close(pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) of sets whose sizes fit, whose embeddings e are within RADIUS, and whose fingerprints f are."""
    ends = [sizes.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("f").alias(f"f_{x}"), F.col("e").alias(f"e_{x}")) for x in ("src", "dst")]
    near = (distance("e_src", "e_dst") <= RADIUS) & (distance("f_src", "f_dst") <= RADIUS)
    both = pairs.join(ends[0], "src").join(ends[1], "dst").where(_fits(F.col("n_src"), F.col("n_dst"), similarity) & near)
    return materialise(both.select("src", "dst"), "close")


def stars(sizes: DataFrame) -> DataFrame:
    """The distinct pairs (src, dst) of sets that share a cell, of which dst meets others most often there."""
    keyed = cells(sizes, fineness(sizes.count()))
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    met = materialise(keyed.join(shared, "key"), "cells")
    drop_scratch(shared)
    near = materialise(met.groupBy("set").agg(F.sum("k").alias("near")), "near")  # how often a set meets others
    ranked = materialise(met.join(near, "set"), "ranked")
    drop_scratch(met)
    drop_scratch(near)
    hubs = ranked.groupBy("key").agg(F.max(F.struct("near", "set")).alias("hub")).select("key", F.col("hub.set").alias("hub"))
    pairs = ranked.join(hubs, "key").where("set <> hub").select(F.col("set").alias("src"), F.col("hub").alias("dst")).distinct()
    pairs = materialise(pairs, "stars")
    drop_scratch(ranked)
    return pairs


def set_groups(rows: DataFrame, texts: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """set and component of each set that is linked to another."""
    sizes = rows.where("n > 0").groupBy("set").agg(F.any_value("n").alias("n"), F.any_value("f").alias("f"))
    sizes = materialise(sizes.withColumn("e", F.transform("f", embedding)), "sets")
    met = stars(sizes)
    pairs = close(met, sizes, similarity)
    drop_scratch(met)
    first = _similar(pairs, rows, texts, similarity, words_per_shingle)
    groups = materialise(connected_components(first).withColumnRenamed("node", "set"), "groups")
    placed = materialise(sizes.join(groups, "set", "left").select("set", "n", F.coalesce("component", "set").alias("c")), "placed")
    tried = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    rest = close(_candidates(placed, rows, texts, similarity, words_per_shingle).join(tried, ["src", "dst"], "left_anti"), sizes, similarity)
    for done in (pairs, placed, sizes):
        drop_scratch(done)
    more = _similar(rest, rows, texts, similarity, words_per_shingle)
    return materialise(connected_components(first.unionByName(more)).withColumnRenamed("node", "set"), "groups")


def drop_near_copies(docs: DataFrame, *, similarity: float = 0.8, words_per_shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which each group of near copies keeps exactly one: that of the least id, then of the least set.

    Rows with a null id stay.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # any names, none of which is used here
    at, of = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    plain = docs.toDF(*names)
    written = materialise(hashed(docs, words_per_shingle, id_column, text_column), "shingles")
    rows = told_apart(written)
    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), own_hash(text_column).alias("own"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    own = rows.groupBy("set", "id", "own").agg(F.count("*").alias("n"))
    groups = set_groups(rows, texts, similarity, words_per_shingle)
    placed = materialise(own.join(groups, "set", "left").select("set", "id", "own", "n", F.coalesce("component", "set").alias("c")), "placed")
    first = placed.groupBy("c").agg(F.min(F.struct("id", "set", "own")).alias("first"))
    judged = materialise(placed.join(first, "c").select("id", "own", "n", (F.struct("id", "set", "own") == F.col("first")).alias("stays")), "judged")
    drop_scratch(written)

    def same(of_rows: DataFrame):
        return (plain[at] == of_rows["id"]) & (F.xxhash64(F.coalesce(plain[of], F.lit(""))) == of_rows["own"])

    gone = few(judged.where("not stays").select("id", "own"))
    again = judged.where("stays and n > 1").select("id", "own")
    if again.isEmpty():
        return plain.join(gone, same(gone), "left_anti").toDF(*docs.columns)
    again = few(again)
    once = plain.join(gone, same(gone), "left_anti")
    kept = once.join(again, same(again), "left_anti")
    repeated = once.join(again, same(again), "left_semi").groupBy(at, F.xxhash64(F.coalesce(F.col(of), F.lit(""))).alias("own")).agg(F.min_by(F.struct(*names), F.struct(of)).alias("r"))
    return kept.unionByName(repeated.select("r.*")).toDF(*docs.columns)
