"""Approximate nearest neighbours: one navigable small-world graph for each shard.

Distinct vectors are dealt to shards of about shard_rows by a hash. A shard's graph has layers;
a vector is in layer l and all below with probability m ** -l. Each layer is one flat int32
array of neighbours, -1 where a node has fewer. Links come from each node's nearest vectors of
the layer, worked out with blocked matrix products, thinned so that a link is kept only if the
node is nearer to it than any link kept before is, then made mutual up to twice m.

A search starts in the top layer and takes each layer's best nodes down to the next. All
queries of a block move together: each expands its best open nodes, and what is found is merged
into its beam. Shard results are scored again in double precision and merged.

Queries are cut into blocks of a bounded size, each sent to all shards at once; a stated query
set against all rows. Copies of a vector are one node; with it go the k + 1 least ids, which is
all that a result of k rows can name of equal scores.

Results for special input: vectors that are null, empty or zero, or that hold null or
non-finite components, and rows with a null id take no part; vectors of different length are
never compared; rows that repeat an id are candidates of their own, except for the query with
that id; equal scores go by ascending id; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.plans.scratch import materialise

SHARD_ROWS = 1 << 14
#: Vectors of queries that are sent to all shards at once.
QUERY_BLOCK = 1 << 15
#: Queries that move through a graph together.
TOGETHER = 512


class Graph:
    """Layers of a shard, from the bottom up; nodes are places in vectors."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.members, self.links = vectors, members, links
        self.near = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int, m: int = 24, candidates: int = 96) -> Graph:
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
        near = vectors.astype(np.float32)
        members, links = [], []
        for at in range(int(level.max(initial=0)) + 1):
            own = np.flatnonzero(level >= at).astype(np.int32)
            if at and len(own) < 2 * m:
                break
            table = np.full((n, 2 * m), -1, np.int32)
            table[own] = cls._layer(near, own, m, candidates)
            members.append(own)
            links.append(table)
        return cls(vectors, members, links)

    @staticmethod
    def _layer(near: np.ndarray, own: np.ndarray, m: int, candidates: int) -> np.ndarray:
        """Neighbours (2 * m for each node of the layer)."""
        x, n = near[own], len(own)
        c = min(candidates, n - 1)
        if c < 1:
            return np.full((n, 2 * m), -1, np.int32)
        source, target, value = [], [], []
        for a in range(0, n, 256):
            sim = x[a : a + 256] @ x.T
            rows = np.arange(len(sim))
            sim[rows, a + rows] = -np.inf
            best = np.argpartition(-sim, c - 1, axis=1)[:, :c] if c < n - 1 else np.argsort(-sim, axis=1)[:, :c]
            score = np.take_along_axis(sim, best, 1)
            by = np.argsort(-score, axis=1, kind="stable")
            best, score = np.take_along_axis(best, by, 1), np.take_along_axis(score, by, 1)
            between = np.einsum("bcd,bed->bce", x[best], x[best], optimize=True)
            kept = np.zeros((len(sim), c), bool)
            count = np.zeros(len(sim), int)
            for k in range(c):
                nearest_kept = np.where(kept, between[:, k, :], -np.inf).max(axis=1)
                kept[:, k] = (count < m) & (score[:, k] > nearest_kept)
                count += kept[:, k]
            for k in range(c):  # nodes in tight groups keep their nearest as well
                more = ~kept[:, k] & (count < m // 2)
                kept[:, k] |= more
                count += more
            r, k = np.nonzero(kept)
            source.append(a + r)
            target.append(best[r, k])
            value.append(score[r, k])
        s, t, v = np.concatenate(source), np.concatenate(target), np.concatenate(value)
        turn = np.concatenate([np.zeros(len(s), int), np.ones(len(s), int)])  # own links before those of others
        s, t, v = np.concatenate([s, t]), np.concatenate([t, s]), np.concatenate([v, v])
        by = np.lexsort((turn, t, s))
        s, t, v, turn = s[by], t[by], v[by], turn[by]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        s, t, v, turn = s[new], t[new], v[new], turn[new]
        by = np.lexsort((-v, turn, s))
        s, t = s[by], t[by]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        out = np.full((n, 2 * m), -1, np.int32)
        fits = place < 2 * m
        out[s[fits], place[fits]] = own[t[fits]]
        return out

    def search(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nodes (and scores in double precision) of the best k found, best first; -1 where fewer."""
        nodes = np.full((len(queries), k), -1, np.int64)
        scores = np.full((len(queries), k), -np.inf)
        for a in range(0, len(queries), TOGETHER):
            q = queries[a : a + TOGETHER]
            top = self.members[-1][:: max(1, len(self.members[-1]) // 64)]
            found = np.broadcast_to(top, (len(q), len(top)))
            for at in reversed(range(len(self.links))):
                found = self._walk(q.astype(np.float32), self.links[at], found, beam if at == 0 else max(16, beam // 8))
            exact = np.where(found >= 0, np.einsum("qbd,qd->qb", self.vectors[found].astype(np.float64), q.astype(np.float64)), -np.inf)
            by = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            nodes[a : a + len(q), : by.shape[1]] = np.take_along_axis(found, by, 1)
            scores[a : a + len(q), : by.shape[1]] = np.take_along_axis(exact, by, 1)
        return nodes, scores

    def _walk(self, q: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int, at_once: int = 4) -> np.ndarray:
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.near) + 1), bool)
        seen[:, -1] = True  # where -1 points
        seen[rows, start] = True
        best = start.astype(np.int64)
        score = np.where(best >= 0, np.einsum("qbd,qd->qb", self.near[best], q), -np.inf)
        is_open = best >= 0
        while True:
            if best.shape[1] > beam:
                keep = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                best, score, is_open = (np.take_along_axis(x, keep, 1) for x in (best, score, is_open))
            if not is_open.any():
                return best
            waiting = np.where(is_open, score, -np.inf)
            take = np.argpartition(-waiting, min(at_once, waiting.shape[1]) - 1, axis=1)[:, :at_once]
            chosen = np.where(np.take_along_axis(is_open, take, 1), np.take_along_axis(best, take, 1), -1)
            np.put_along_axis(is_open, take, False, axis=1)
            found = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(q), -1)
            found = np.where(seen[rows, found], -1, found)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            seen[rows, found] = True
            width = int((found >= 0).sum(axis=1).max(initial=0))
            if not width:
                continue
            found = np.sort(found, axis=1)[:, -width:].astype(np.int64)
            value = np.where(found >= 0, np.einsum("qbd,qd->qb", self.near[found], q), -np.inf)
            best, score, is_open = np.concatenate([best, found], 1), np.concatenate([score, value], 1), np.concatenate([is_open, found >= 0], 1)

    def dump(self, ids: list[list[int]]) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, sizes=np.array(list(map(len, ids))), ids=np.array([x for own in ids for x in own], np.int64), **{f"m{k}": v for k, v in enumerate(self.members)}, **{f"l{k}": v for k, v in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> tuple[Graph, list[list[int]]]:
        with np.load(io.BytesIO(blob)) as f:
            layers = sum(k.startswith("l") for k in f.files)
            graph = cls(f["vectors"], [f[f"m{k}"] for k in range(layers)], [f[f"l{k}"] for k in range(layers)])
            ends = np.cumsum(f["sizes"])[:-1]
            return graph, [x.tolist() for x in np.split(f["ids"], ends)]


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows that take part, as vec_id, v, and two hashes that stand for the vector."""
    v = F.col("v")
    fine = F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")).where(fine).withColumns({"h1": F.xxhash64(v), "h2": F.hash(v), "dim": F.size(v)})


def build_index(rows: DataFrame, *, k: int = 20, shard_rows: int = SHARD_ROWS, m: int = 24, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The written index over every usable row: shard int, dim int, graph binary."""
    few = Window.partitionBy("h1", "h2", "dim").orderBy("vec_id")  # copies of a vector, of which k + 1 stay in each task
    least = usable(rows, id_column, vector_column).withColumn("r", F.row_number().over(few)).where(f"r <= {k + 1}")
    distinct = materialise(least.groupBy("h1", "h2", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")), "vectors")
    shards = max(1, -(-distinct.count() // shard_rows))
    kind = np.float32 if dict(distinct.dtypes)["v"] == "array<float>" else np.float64

    def graph(key: tuple, own: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        vectors = np.array(own.column("v").combine_chunks().flatten(), kind).reshape(-1, dim)
        ids = own.column("ids").to_pylist()
        by = sorted(range(len(ids)), key=ids.__getitem__)
        blob = Graph.build(vectors[by], zlib.crc32(f"{dim} {shard}".encode()), m).dump([ids[x] for x in by])
        return pa.table({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "graph": pa.array([blob], pa.binary())})

    dealt = distinct.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).select("dim", "shard", "ids", "v")
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(graph, "shard int, dim int, graph binary"), "graphs")


def search(index: DataFrame, queries: DataFrame, *, k: int = 20, beam: int = 256, block: int = QUERY_BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows found for each query other than the query's own."""
    spark = index.sparkSession
    rows = usable(queries, id_column, vector_column)
    distinct = materialise(rows.groupBy("h1", "h2", "dim").agg(F.first("v").alias("v")), "queries")
    parts = max(1, -(-distinct.count() // block))
    lists = []
    for part in range(parts):
        own = distinct.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(parts)) == part).toPandas()  # bounded by block
        if not len(own):
            continue
        by_dim = {int(dim): (group.index.to_numpy(), np.array(group.v.tolist())) for dim, group in own.groupby("dim")}
        shared = spark.sparkContext.broadcast((by_dim, own.h1.to_numpy(), own.h2.to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_dim, h1, h2 = shared.value
            for batch in batches:
                for dim, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if dim not in by_dim:
                        continue
                    place, q = by_dim[dim]
                    graph, ids = Graph.load(blob)
                    nodes, scores = graph.search(q, k + 1, max(beam, k + 1))
                    at, col = np.nonzero(nodes >= 0)
                    who = place[at]
                    yield pa.RecordBatch.from_arrays([pa.array(h1[who]), pa.array(h2[who]), pa.array(np.full(len(who), dim), pa.int32()), pa.array(scores[at, col]), pa.array([ids[x] for x in nodes[at, col].tolist()], pa.list_(pa.int64()))], ["h1", "h2", "dim", "score", "ids"])

        found = index.select("dim", "graph").repartition(index.count()).mapInArrow(run, "h1 long, h2 int, dim int, score double, ids array<long>")
        best = Window.partitionBy("h1", "h2", "dim").orderBy(F.col("score").desc(), F.col("ids")[0])
        few = found.withColumn("r", F.row_number().over(best)).where(f"r <= {k + 1}")
        each = F.transform("ids", lambda x: F.struct((-F.col("score")).alias("s"), x.alias("vec_id")))
        lists.append(materialise(few.groupBy("h1", "h2", "dim").agg(F.slice(F.sort_array(F.flatten(F.collect_list(each))), 1, k + 1).alias("best")), "found"))
        shared.unpersist()
    if not lists:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    asked = rows.select(F.col("vec_id").alias("query_id"), "h1", "h2", "dim").join(every, ["h1", "h2", "dim"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
