"""Bridges, cut vertices, blocks and strong components of edge tables, for all components at once.

Every step is a join and an aggregation over tables in the shared folder; no task holds a
component and nothing but flags and depths reaches the driver. Values spread along edges from a
frontier, so a round reads the edges of what changed. Rounds follow distances: those of a spanning
forest the greatest distance from a component's least node, those below it the logarithm of that.
A very long path of nodes therefore takes many rounds, though small ones.

Ids must be integers. Loops and repeated edges are allowed, edges with a null end are left out,
and an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.plans.components import connected_components, join_skewed
from pairloom.plans.scratch import drop_scratch, materialise


def spread(nodes: DataFrame, edges: DataFrame, step: Callable[[Column, Column], Column] = lambda value, src: value) -> DataFrame:
    """The least value that reaches each node.

    nodes has node and value (null: none yet) for each end of the edges (src, dst). A value goes
    from src to dst as step(value, src), until no node gets a lesser one.
    """
    now = materialise(nodes.select("node", "value", F.col("value").isNotNull().alias("fresh")), "spread")
    changed = True
    while changed:
        seen = Observation()
        sent = now.where("fresh").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), step(F.col("value"), F.col("src")).alias("offer"))
        offers = sent.groupBy("node").agg(F.min("offer").alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("value").isNull() | (F.col("offer") < F.col("value")))
        after = now.join(offers, "node", "left").select("node", F.when(better, F.col("offer")).otherwise(F.col("value")).alias("value"), better.alias("fresh"))
        before, now = now, materialise(after.observe(seen, F.count_if("fresh").alias("fresh")), "spread")
        changed = seen.get["fresh"] > 0
        drop_scratch(before)
    return now


def _pairs(edges: DataFrame, undirected: bool) -> DataFrame:
    a, b = F.col("src").cast("long"), F.col("dst").cast("long")
    ends = [F.least(a, b), F.greatest(a, b)] if undirected else [a, b]
    return edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(ends[0].alias("src"), ends[1].alias("dst")).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has an edge out; others are on no cycle."""
    starts, ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
    return edges.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")


def strong_components(edges: DataFrame, trims: int = 2) -> DataFrame:
    """Rows (node, component) of the vertices of directed edges; component is the least node of the strong component.

    Each round takes vertices without an edge in or out away, then gives each node the foremost
    vertex that reaches it as its pivot. A strong component has one pivot, so edges between nodes
    of different pivots are done with. What reaches its own pivot is the pivot's strong component;
    the rest goes on. Every set of one pivot gives a component in each round. The foremost vertex
    is at first that of the most paths through it, afterwards one drawn by a hash, which keeps the
    number of rounds low.
    """
    every = materialise(_pairs(edges, False), "edges")
    left, found, round_ = every, [], 0
    while True:
        for _ in range(trims):
            left = _trimmed(left)
        left = materialise(left, "edges")
        if left.isEmpty():
            break
        ways = left.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
        degrees = ways.groupBy("node").agg(F.sum("out").alias("o"), F.count("*").alias("n"))
        first = F.col("o").cast("double") * (F.col("o") - F.col("n")) if round_ == 0 else F.xxhash64("node", F.lit(round_)).cast("double")
        pivots = spread(degrees.select("node", F.struct(first.alias("at"), F.col("node").alias("pivot")).alias("value")), left)
        of = pivots.select("node", F.col("value.pivot").alias("pivot"))
        ends = [of.select(F.col("node").alias(c), F.col("pivot").alias(f"of_{c}")) for c in ("src", "dst")]
        inner = materialise(left.join(ends[0], "src").join(ends[1], "dst").where("of_src = of_dst").select("src", "dst"), "inner")
        back = spread(of.select("node", F.when(F.col("node") == F.col("pivot"), F.col("pivot")).alias("value")), inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = materialise(back.where("value is not null").select("node", F.col("value").alias("pivot")), "strong")
        found.append(reached)
        for table in (left, pivots, back):
            drop_scratch(table)
        left = inner.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        round_ += 1
    nodes = every.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    sets = found[0]
    for more in found[1:]:
        sets = sets.unionByName(more)
    sets = materialise(sets, "strong")
    least = sets.groupBy("pivot").agg(F.min("node").alias("component"), F.count("*").alias("_rows"))
    named = join_skewed(sets, least, "pivot", sets.count()).select("node", "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """For each node of undirected pairs: root (the least node reachable), depth (distance to it) and parent, one step nearer; a root is its own parent."""
    both = materialise(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges")
    here = both.select(F.col("src").alias("node")).distinct().select("node", F.struct(F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.col("node").alias("parent")).alias("value"))
    got = spread(here, both, lambda value, src: F.struct(value["root"].alias("root"), (value["depth"] + 1).alias("depth"), src.alias("parent")))
    drop_scratch(both)
    return got.select("node", "value.root", "value.depth", "value.parent")


class Forest:
    """A spanning forest, the pairs it leaves over with their meeting points, and what leaves each subtree.

    tree: node, depth, parent. extra: (src, dst, top), top being the depth at which the ends'
    paths to the root meet. low: for each node the least top of the extra pairs at nodes of its
    subtree (null if there is none). Since distances to a root differ by 1 at most along a pair,
    ends of an extra pair are never above one another.
    """

    def __init__(self, pairs: DataFrame):
        self.tree = materialise(spanning_forest(pairs), "forest")
        deepest = self.tree.agg(F.max("depth")).first()[0] or 0
        self.ups = [self.tree.select("node", F.col("parent").alias("up"))]
        while 2 ** len(self.ups) < deepest:
            last = self.ups[-1]
            twice = last.select(F.col("node").alias("up"), F.col("up").alias("above"))
            self.ups.append(materialise(last.join(twice, "up").select("node", F.col("above").alias("up")), "ups"))
        self.extra = materialise(self._meet(pairs), "extra")
        self.low = self._least_below()

    def _meet(self, pairs: DataFrame) -> DataFrame:
        ends = [self.tree.select(F.col("node").alias(c), F.col("depth").alias(f"depth_{c}"), F.col("parent").alias(f"up_{c}")) for c in ("src", "dst")]
        at = pairs.join(ends[0], "src").join(ends[1], "dst").where("up_src <> dst and up_dst <> src")
        level = F.least("depth_src", "depth_dst")
        at = at.select("src", "dst", *(F.when(F.col(f"depth_{c}") > level, F.col(f"up_{c}")).otherwise(F.col(c)).alias(x) for c, x in (("src", "x"), ("dst", "y"))), level.alias("level"))
        for k in reversed(range(len(self.ups))):
            x, y = (self.ups[k].select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in ("x", "y"))
            apart = F.col("up_x") != F.col("up_y")
            at = at.join(x, "x").join(y, "y").select("src", "dst", *(F.when(apart, F.col(f"up_{c}")).otherwise(F.col(c)).alias(c) for c in ("x", "y")), (F.col("level") - F.when(apart, 2**k).otherwise(0)).alias("level"))
        return at.select("src", "dst", (F.col("level") - 1).alias("top"))

    def _least_below(self) -> DataFrame:
        """Least top in each subtree: after step k what is less than 2 ** (k + 1) steps below is in."""
        own = self.extra.select(F.explode(F.array("src", "dst")).alias("node"), "top").groupBy("node").agg(F.min("top").alias("low"))
        low = materialise(self.tree.select("node").join(own, "node", "left"), "low")
        for ups in self.ups:
            raised = low.where("low is not null").join(ups, "node").groupBy("up").agg(F.min("low").alias("from_below")).withColumnRenamed("up", "node")
            before, low = low, materialise(low.join(raised, "node", "left").select("node", F.least("low", "from_below").alias("low")), "low")
            drop_scratch(before)
        return low

    def edges(self) -> DataFrame:
        """Tree edges as (node, parent, depth, low)."""
        return self.tree.where("node <> parent").join(self.low, "node")


def bridges(edges: DataFrame) -> DataFrame:
    """Undirected pairs (src < dst) on no cycle: tree edges that no extra pair leads around."""
    return _bridges(Forest(materialise(_pairs(edges, True), "pairs")))


def _bridges(forest: Forest) -> DataFrame:
    return forest.edges().where("low is null or low >= depth").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))


def blocks(edges: DataFrame) -> DataFrame:
    """For each distinct undirected pair (src < dst): block, the same number for pairs that lie on a cycle together, and bridge.

    A tree edge is known by its lower node. Those of an extra pair's ends lie on one cycle, and so
    does a tree edge with the one above if an extra pair of its subtree meets higher than that;
    components of these links are the blocks, numbered by their least lower node.
    """
    pairs = materialise(_pairs(edges, True), "pairs")
    forest = Forest(pairs)
    up = materialise(forest.edges(), "tree")
    itself = up.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    along = up.where("low <= depth - 2").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    of = materialise(connected_components(itself.unionByName(along).unionByName(forest.extra.select("src", "dst"))), "blocks").withColumnRenamed("component", "block")
    tree = up.join(of, "node").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"), "block", F.expr("low is null or low >= depth").alias("bridge"))
    return tree.unionByName(forest.extra.join(of, forest.extra.src == of.node).select("src", "dst", "block", F.lit(False).alias("bridge")))


def cut_vertices(edges: DataFrame) -> DataFrame:
    """Vertices (node) whose removal parts their component: those in several blocks."""
    ends = blocks(edges).select(F.explode(F.array("src", "dst")).alias("node"), "block").distinct()
    return ends.groupBy("node").count().where("count > 1").select("node")
