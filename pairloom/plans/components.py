"""Connected components of an edge table, by alternating star contraction.

Every half of a round is an aggregation and a join on the edge table, written to the shared folder;
nothing is collected and no task ever holds a component. A node with more than a thousandth of
all edges is joined by broadcast, so that its edges stay where they are. A round rewires each node's edges to
the least node it knows of, first on the larger side of the node and then on its smaller side,
until each component is a star around its least node (about log2 of the node count rounds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.scratch import drop_scratch, materialise


#: Share of all rows from which on a key counts as hot, and rows from which on it can; there are no more hot keys than 1 / HOT.
HOT, HOT_ROWS = 1 / 1000, 256


def join_skewed(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with facts, which has one row for each key and, in _rows, how many of the `total` rows have it.

    Facts of hot keys are broadcast, which at most 1 / HOT of them can be; the other rows are
    joined as Spark sees fit.
    """
    hot = F.col("_rows") >= max(HOT_ROWS, HOT * total)
    few = facts.where(hot).drop("_rows")
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(others.join(facts.where(~hot).drop("_rows"), key))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_rows")).select("u", F.least("u", "m").alias("m"), "_rows")
    return join_skewed(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges point from the larger node u to the smaller node v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_rows"))
    pairs = join_skewed(edges, least, "u", n)
    least = least.drop("_rows")
    moved = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the least node reachable.

    Ids must be integers. Loops and repeated edges are allowed, edges with a null end are left
    out; an empty table gives no row.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull())
    loops = ends.where("u = v").select("u", "v").distinct()
    now = materialise(ends.where("u <> v").distinct(), "edges")
    before = _state(now)
    while before[0]:
        turned = materialise(_large_star(now, before[0]), "edges")
        after = materialise(_small_star(turned, before[0]), "edges")
        drop_scratch(turned)
        state = _state(after)
        drop_scratch(now)
        now = after
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
