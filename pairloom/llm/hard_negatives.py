"""Hard-negative mining by one-dimensional distance keys.

Inner products become distances: with M the greatest norm, a row x is augmented to
(x, sqrt(M^2 - |x|^2)) and an anchor q to (q, 0); then the squared distance is
|q|^2 + M^2 - 2 <q, x>, so the best scores are the nearest rows. Each row belongs to its nearest
pivot and its key is (pivot, distance to it). The index keeps the rows sorted by key, in pages of
some thousand rows; a cell is one pivot's interval of distances, and a cell of many rows (copies
of a vector, say) is several pages.

For a row at distance s from pivot p and an anchor at distance t from p, the triangle inequality
puts their distance between |s - t| and s + t. A search for scores in (low, high] is one for an
annulus of distances, so of each pivot only an interval of keys can hold results. A scan has two
steps: the first reads the pages around an anchor's own keys, which gives each wanted list a k-th
best score; the second reads the key intervals that this score leaves open, nearest pages first,
and the interval shrinks as better rows come. What is skipped is certified to hold no result.
Scores are exact integers. The first scan finds the positives, the second one all windows of
negatives together.

Anchors move in blocks of some hundred. A stream is a block followed by the pages it asks for,
nearest first and at most STREAM_PAGES of them; Spark sorts the streams, and a task holds one
block and one page at a time. Directory and pivots are bounded (MOST_CELLS, MOST_PIVOTS), fitted on at most
PIVOT_ROWS rows; every row is indexed.

Results for special input: rows with a null id or label, a null vector or null or non-finite
components take no part; short vectors are filled with zeros; components so large that 100 scores
could pass 64 bits count as that bound; rows that repeat an anchor's id aren't its positives, and
otherwise repeated rows are rows of their own, each anchor among them with results of its own;
equal scores go by ascending id; zero vectors take part; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import map_batches, slices
from pairloom.llm.whole_vectors import fine, largest_component, longest, matrix, whole
from pairloom.plans.scratch import materialise

PAGE_ROWS = 1 << 10
MOST_PIVOTS, MOST_CELLS, PIVOT_ROWS = 64, 4096, 4096
BLOCK_ANCHORS = 512
#: Pages that a block reads first, and pages of a stream.
FIRST_PAGES, STREAM_PAGES = 4, 16
#: Share of the distances by which a bound may be off; far above what double precision loses.
MARGIN = 1e-7


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision where they fit it, else in integers."""
    peak = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if peak < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Space:
    """Pivots in the augmented space, and the square of the greatest norm."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top = pivots, top
        self.norm = (pivots * pivots).sum(axis=1)

    @classmethod
    def fit(cls, sample: np.ndarray, top: float, n: int, rounds: int = 5) -> Space:
        """Pivots by some rounds of averaging over a sample; any pivots give right results."""
        x = cls.augmented(sample, top)
        pivots = x[:n].copy()
        for _ in range(rounds):
            near = cls(pivots, top)._distances(x).argmin(axis=1)
            for k in np.unique(near):
                pivots[k] = x[near == k].mean(axis=0)
        return cls(pivots, top)

    @staticmethod
    def augmented(x: np.ndarray, top: float) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))])

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + self.norm - 2 * x @ self.pivots.T))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._distances(self.augmented(x, self.top))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]))

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which each anchor's rows have the score (a matrix with a column for each list)."""
        return np.sqrt(np.maximum(0, (q.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.top - 2.0 * score))

    def slack(self, q: np.ndarray) -> np.ndarray:
        return MARGIN * (1 + np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) + np.sqrt(self.top))


class Scan:
    """A block's lists while its pages pass: the best k scores of each anchor and list in [low, high], of rows of its label or of others."""

    def __init__(self, space: Space, block: dict[str, np.ndarray], k: int, same: bool):
        self.space, self.b, self.k, self.same = space, block, k, same
        self.least = block["low"].copy()  # rows below can't be among the best k any more
        self.apart = space.of_anchors(block["q"])
        self.slack = space.slack(block["q"])
        self.far = space.radius(block["q"], block["high"])  # rows nearer than that are above the window
        empty = np.zeros(0, np.int64)
        self.found = [empty] * 4  # anchor * lists + list, score, id, row

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each anchor that can still hold results: from, to (to < 0: none)."""
        open_to = self.least <= self.b["high"]
        to = np.where(open_to, self.space.radius(self.b["q"], self.least), -np.inf).max(axis=1)
        return np.where(open_to, self.far, np.inf).min(axis=1), to

    def read(self, pivot: int, page: dict[str, np.ndarray]) -> int:
        """Take in what the page's key interval holds; the number of rows looked at."""
        start, to = self.reach()
        t, s = self.apart[:, pivot], page["key"]
        lo, hi = np.maximum(t - to, start - t) - self.slack, t + to + self.slack
        ask = np.flatnonzero((to >= 0) & (lo <= s[-1]) & (hi >= s[0]))
        if not len(ask):
            return 0
        a, z = np.searchsorted(s, lo[ask].min()), np.searchsorted(s, hi[ask].max(), "right")
        near = scores(self.b["q"][ask], page["q"][a:z])
        equal = self.b["label"][ask][:, None] == page["label"][a:z]
        fit = equal & (self.b["id"][ask][:, None] != page["id"][a:z]) if self.same else ~equal
        lists = self.least.shape[1]
        more = []
        for j in range(lists):
            r, c = np.nonzero(fit & (near >= self.least[ask, j][:, None]) & (near <= self.b["high"][ask, j][:, None]))
            more.append((ask[r] * lists + j, near[r, c], page["id"][a:z][c], page["row"][a:z][c]))
        slot, score, name, row = (np.concatenate(x) for x in zip(self.found, *more, strict=True))
        by = np.lexsort((row, name, -score, slot))
        slot, score, name, row = slot[by], score[by], name[by], row[by]
        first = np.searchsorted(slot, slot)
        best = np.arange(len(slot)) - first < self.k
        self.found = [x[best] for x in (slot, score, name, row)]
        last = np.arange(len(slot)) - first == self.k - 1
        self.least.ravel()[slot[last]] = score[last]
        return (z - a) * len(ask)


def route(space: Space, cells: np.ndarray, block: dict[str, np.ndarray], scan: Scan, first: bool) -> np.ndarray:
    """(cell, order) of the cells a block asks for: those around its anchors' own keys at first, then all others that can hold results."""
    pivot, low, high = cells["pivot"], cells["low"], cells["high"]
    t = scan.apart[:, pivot]
    out = np.maximum(0, np.maximum(low - t, t - high))  # no row of the cell is nearer
    order = np.lexsort((np.abs((low + high) / 2 - t).min(axis=0), out.min(axis=0)))
    n = int(np.searchsorted(np.cumsum(cells["pages"][order]), FIRST_PAGES)) + 1
    if first:
        return order[:n]
    start, to = scan.reach()
    can = (out <= (to + scan.slack)[:, None]) & (t + high >= (start - scan.slack)[:, None])
    return order[n:][can[:, order[n:]].any(axis=0)]


class Index:
    """Pages on disk, the cells they belong to, and the space."""

    def __init__(self, pages: DataFrame, cells: np.ndarray, space: Space, dim: int):
        self.pages, self.cells, self.space, self.dim = pages, cells, space, dim


def build(rows: DataFrame, dim: int) -> Index:
    """The index of rows (row, vec_id, label, q) of a written table."""
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("top")).first()
    pages = -(-facts.n // PAGE_ROWS)
    pivots = min(MOST_PIVOTS, max(1, round(pages**0.5)), facts.n)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(PIVOT_ROWS).select("q").toArrow()  # bounded; for pivots and annuli only
    x = matrix(sample.column("q").combine_chunks(), dim)
    space = Space.fit(x, facts.top, pivots)
    apart = space.of_rows(x)
    near, key = apart.argmin(axis=1), apart.min(axis=1)
    rings = max(1, min(MOST_CELLS // pivots, -(-pages // pivots)))
    cuts = np.array([np.quantile(key[near == p], np.arange(1, rings) / rings) if (near == p).any() else np.full(rings - 1, np.inf) for p in range(len(space.pivots))]).reshape(len(space.pivots), rings - 1)
    shared = spark.sparkContext.broadcast((space, cuts))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, cuts = shared.value
        for batch in batches:
            for part in slices(batch, 1024):
                apart = space.of_rows(matrix(part.column(3), dim))
                pivot, key = apart.argmin(axis=1), apart.min(axis=1)
                ring = (key[:, None] >= cuts[pivot]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key), pa.array(pivot * (cuts.shape[1] + 1) + ring)], ["row", "vec_id", "label", "q", "key", "cell"])

    keys = materialise(map_batches(rows, ["row", "vec_id", "label", "q"], "row long, vec_id long, label long, q array<int>, key double, cell long", keyed), "keys")
    known = keys.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.ceil(F.count("*") / PAGE_ROWS).alias("pages")).orderBy("cell").toPandas()  # MOST_CELLS at most
    cells = known.assign(pivot=known.cell // rings).to_records(index=False)
    sizes = spark.createDataFrame(known[["cell", "pages"]])

    def page(name: tuple, own: pa.Table) -> pa.Table:
        by = np.lexsort([own.column(c).to_numpy() for c in ("row", "key")])
        blob = pack(q=matrix(own.column("q").combine_chunks(), dim)[by].astype(np.int32), **{k: own.column(c).to_numpy()[by] for k, c in (("row", "row"), ("id", "vec_id"), ("label", "label"), ("key", "key"))})
        return pa.table({"cell": pa.array([name[0].as_py()]), "slice": pa.array([name[1].as_py()]), "page": pa.array([blob], pa.binary())})

    dealt = keys.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("row"), "pages"))
    made = dealt.groupBy("cell", "slice").applyInArrow(page, "cell long, slice long, page binary").repartitionByRange("cell", "slice").sortWithinPartitions("cell", "slice")
    return Index(materialise(made, "pages"), cells, space, dim)


def scan(index: Index, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, list, score, vec_id, found): the best k of each anchor's lists; blocks has block and anchors."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((index.space, index.cells))
    fields = ["row", "list", "score", "vec_id", "found"]
    hits = None
    for first in (True, False):
        if not first:
            blocks = _narrowed(blocks, hits, k)

        def ask(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
            space, cells = shared.value
            for batch in batches:
                for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = unpack(blob)
                    chosen = route(space, cells, own, Scan(space, own, k, same), first)
                    cell, piece = np.repeat(chosen, cells["pages"][chosen]), np.concatenate([np.arange(cells["pages"][c]) for c in chosen]) if len(chosen) else chosen
                    order = np.arange(len(cell))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), name)), pa.array(cells["cell"][cell].astype(np.int64)), pa.array(piece.astype(np.int64)), pa.array(order), pa.array(cells["pivot"][cell].astype(np.int64))], ["block", "cell", "slice", "place", "pivot"])

        asked = materialise(map_batches(blocks, ["block", "anchors"], "block long, cell long, slice long, place long, pivot long", ask), "asked")
        asked = asked.withColumn("streams", F.ceil(F.count("*").over(Window.partitionBy("block")) / STREAM_PAGES)).withColumn("stream", F.expr("place % streams"))
        heads = asked.select("block", "stream").distinct().join(blocks, "block").select("block", "stream", F.lit(-1).cast("long").alias("place"), F.lit(-1).cast("long").alias("pivot"), F.col("anchors").alias("blob"))
        body = asked.join(index.pages, ["cell", "slice"]).select("block", "stream", "place", "pivot", F.col("page").alias("blob"))
        streams = heads.unionByName(body).repartition("block", "stream").sortWithinPartitions("block", "stream", "place")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, _ = shared.value
            own: Scan | None = None

            def results(own: Scan) -> pa.RecordBatch:
                slot, score, name, row = own.found
                lists = own.least.shape[1]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (own.b["row"][slot // lists], slot % lists, score, name, row)], fields)

            for batch in batches:
                for at in range(batch.num_rows):
                    pivot, blob = batch.column(0)[at].as_py(), unpack(batch.column(1)[at].as_py())
                    if pivot >= 0:
                        own.read(pivot, blob)
                        continue
                    if own:
                        yield results(own)
                    own = Scan(space, blob, k, same)
            if own:
                yield results(own)

        more = streams.select("pivot", "blob").mapInArrow(run, "row long, list long, score long, vec_id long, found long")
        hits = materialise(_best(more if first else hits.unionByName(more), k), "hits")
    return hits


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row", "list").orderBy(F.col("score").desc(), "vec_id", "found")
    return hits.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").drop("rank")


def _blocks(anchors: DataFrame, lists: int) -> DataFrame:
    """Blocks of anchors (row, vec_id, label, q, block, and low and high, arrays with a number for each list)."""
    from_lists = lambda own, c: np.array(own.column(c).combine_chunks().flatten(), np.int64).reshape(-1, lists)

    def run(name: tuple, own: pa.Table) -> pa.Table:
        by = np.argsort(own.column("row").to_numpy(), kind="stable")
        q = own.column("q").combine_chunks()
        blob = pack(q=matrix(q, max(1, len(q[0])))[by], low=from_lists(own, "low")[by], high=from_lists(own, "high")[by], **{k: own.column(c).to_numpy()[by] for k, c in (("row", "row"), ("id", "vec_id"), ("label", "label"))})
        return pa.table({"block": pa.array([name[0].as_py()]), "anchors": pa.array([blob], pa.binary())})

    return materialise(anchors.groupBy("block").applyInArrow(run, "block long, anchors binary"), "blocks")


def _narrowed(blocks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The blocks with each list's low raised to its k-th best score so far."""
    raised = hits.groupBy("row", "list").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(f"n = {k}")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = unpack(blob)["row"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name)), pa.array(rows)], ["block", "row"])

    where = map_batches(blocks, ["block", "anchors"], "block long, row long", flat).join(raised, "row")
    news = where.groupBy("block").agg(F.collect_list(F.struct("row", "list", "low")).alias("news"))  # a block's lists at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, own, new = batch.column(0)[at].as_py(), unpack(batch.column(1)[at].as_py()), batch.column(2)[at].as_py() or []
                at_row = {r: p for p, r in enumerate(own["row"].tolist())}
                for x in new:
                    own["low"][at_row[x["row"]], x["list"]] = x["low"]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack(**own)], pa.binary())], ["block", "anchors"])

    return materialise(blocks.join(news, "block", "left").select("block", "anchors", "news").mapInArrow(run, "block long, anchors binary"), "blocks")


def mine(rows: DataFrame, is_anchor: str = "vec_id % 100 = 0", *, label: str = "label", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor and label are SQL over vec_id and label: which rows are anchors, and the label to
    use. window: percent of the positive's score between which a negative's score lies.
    """
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v"))
    found = found.where(fine("v") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    dim = max(1, longest(found, "v"))
    q = whole("v", scale, largest_component(dim, 100))
    padded = F.concat(q, F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    kept = materialise(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.expr(label).cast("long").alias("label"), padded.alias("q")).where("label is not null"), "whole_vectors")
    asked = materialise(kept.where(is_anchor), "anchors")
    n = asked.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = build(kept, dim)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(-(-n // BLOCK_ANCHORS))))
    least, most = -(2**62), 2**62
    ends = lambda x: F.array(F.lit(x).cast("long"))
    near = scan(index, _blocks(dealt.withColumns({"low": ends(least), "high": ends(most)}), 1), positives, True)
    numbered = near.withColumn("list", F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "found")) - 1)
    pairs = materialise(numbered.select("row", F.col("list").cast("long").alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    a, b = window
    bounds = F.struct(F.col("list"), F.ceil(F.col("positive_score") * F.lit(a).cast("decimal(10,0)") / 100).cast("long").alias("low"), F.floor(F.col("positive_score") * F.lit(b).cast("decimal(10,0)") / 100).cast("long").alias("high"))
    lists = pairs.groupBy("row").agg(F.collect_list(bounds).alias("w"))  # as many as positives
    of = lambda side, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda j: F.coalesce(F.element_at(F.map_from_entries(F.transform("w", lambda x: F.struct(x["list"].cast("int"), x[side]))), j), F.lit(none)))
    windows = dealt.join(lists, "row").withColumns({"low": of("low", 1), "high": of("high", 0)})
    worst = scan(index, _blocks(windows.drop("w"), positives), negatives, False)
    ranked = worst.withColumn("rank", F.row_number().over(Window.partitionBy("row", "list").orderBy(F.col("score").desc(), "vec_id", "found")))
    named = ranked.join(pairs, ["row", "list"]).join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
