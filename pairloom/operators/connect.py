"""Connected sets of firms, and the sets that stay connected when something is left out.

Firms are vertices, moves of workers are edges; the leave-out sets use the graph of workers and
firms, in which a worker's vertex is -1 - i. Ids must be integers (cleaning makes them so).
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.rows import by_worker, keep_ids, min_moves_frame, one_worker, tidy, with_spell, worker_m
from pairloom.plans.components import connected_components
from pairloom.plans.graph import blocks, bridges, cut_vertices, strong_components
from pairloom.plans.scratch import materialise

if TYPE_CHECKING:
    from pairloom.operators.panel import Panel


def firm_links(panel: Panel, steps: int = 1) -> DataFrame:
    """Pairs (src, dst) of firms that follow each other at a distance of up to `steps` among a worker's rows of m > 0."""
    long = panel.as_long()
    moves = long.df.where("m > 0")
    w = by_worker(long)
    ahead = moves.select(F.col("j").alias("src"), F.array(*(F.lead("j", k).over(w) for k in range(1, steps + 1))).alias("to"))
    return ahead.select("src", F.explode("to").alias("dst")).where("dst is not null").distinct()


def worker_links(panel: Panel) -> DataFrame:
    """Pairs (src: the worker's vertex, dst: the firm) of movers, with the number of their rows and spells."""
    long = panel.as_long()
    marked = with_spell(long).withColumn("_mover", worker_m()).where("_mover")
    return marked.groupBy("i", "j").agg(F.count("*").alias("rows"), F.count_distinct("_spell").alias("spells")).select((-1 - F.col("i")).cast("long").alias("src"), F.col("j").cast("long").alias("dst"), "rows", "spells")


def firm_parts(panel: Panel, edges: DataFrame, strong: bool = False) -> DataFrame:
    """Each firm of the panel with its component and the component's number of vertices; firms without edges are alone."""
    found = strong_components(edges) if strong else connected_components(edges)
    every = panel.as_long().df.select(F.col("j").cast("long").alias("node")).distinct()
    nodes = every.join(found, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("vertices"))
    return materialise(nodes.join(sizes, "component").where("node >= 0").select(F.col("node").alias("j"), "component", "vertices"), "parts")


SIZE = {
    "len": lambda: F.count("*"),
    "firms": lambda: F.count_distinct("j"),
    "workers": lambda: F.count_distinct("i"),
    "stayers": lambda: F.count_distinct(F.when(F.col("m") == 0, F.col("i"))),
    "movers": lambda: F.count_distinct(F.when(F.col("m") > 0, F.col("i"))),
    "stays": lambda: F.count(F.when(F.col("m") == 0, 1)),
    "moves": lambda: F.count(F.when(F.col("m") > 0, 1)),
    "len_stayers": lambda: F.count(F.when(~F.col("_mover"), 1)),
    "len_movers": lambda: F.count(F.when(F.col("_mover"), 1)),
}


def measure(name: str):
    """The aggregate of rows (with _mover) that makes up a size."""
    name = name.replace("length", "len")
    if name.startswith("firms_plus_"):
        return SIZE["firms"]() + SIZE[name.removeprefix("firms_plus_")]()
    return SIZE[name]()


def panel_size(panel: Panel, name: str) -> int:
    """A size of a whole panel; firms and workers of wide rows are counted over all periods."""
    if panel.meta.layout.wide:
        rows = panel.df.withColumn("_mover", worker_m())
        firms = panel.unique_ids("j").count() if "firms" in name else 0
        if name == "firms":
            return firms
        return firms + rows.agg(measure(name.removeprefix("firms_plus_")).alias("x")).first()[0]
    return panel.df.withColumn("_mover", worker_m()).agg(measure(name).alias("x")).first()[0]


def part_sizes(panel: Panel, parts: DataFrame, name: str) -> DataFrame:
    """component, vertices, first firm and size of each component, all in one plan.

    A worker whose rows fall into several components is a worker of each: the worker's id is
    written together with the component, so that spells and m are worked out inside components.
    """
    if name == "firms":
        return parts.groupBy("component").agg(F.first("vertices").alias("vertices"), F.min("j").alias("first"), F.count_distinct("j").alias("size"))
    rows = panel.df.join(parts.select("j", "component"), "j").withColumn("i", F.concat_ws(":", "i", "component")).select(*panel.df.columns)
    own = tidy(panel.rows(rows)).df.withColumn("_mover", worker_m()).withColumn("component", F.substring_index("i", ":", -1).cast("long"))
    sizes = own.groupBy("component").agg(measure(name).alias("size"))
    facts = parts.groupBy("component").agg(F.first("vertices").alias("vertices"), F.min("j").alias("first"))
    return facts.join(sizes, "component")


def _firms(parts: DataFrame, component: int) -> DataFrame:
    return parts.where(F.col("component") == component).select("j")


def largest(panel: Panel, parts: DataFrame, name: str, to_stays: bool) -> Panel:
    """The rows of the component of the largest size; of equal ones that of more vertices, then of the smallest firm."""
    best = part_sizes(panel, parts, name).orderBy(F.col("size").desc(), F.col("vertices").desc(), "first", "component").first()
    return panel if best is None else keep_ids(panel, "j", _firms(parts, best.component), to_stays)


def _graph(panel: Panel, strong: bool) -> DataFrame:
    return firm_links(panel) if strong else worker_links(panel)


def articulation_rows(panel: Panel, group: str, cross_membership: bool = False) -> DataFrame:
    """Pairs (i, j) or workers (i) whose rows hold the graph together.

    observation: pairs of one row on a bridge; spell: pairs of one spell on a bridge; match: pairs
    on a bridge; worker: workers that are cut vertices. cross_membership takes all pairs of a
    worker on some bridge and a firm on some bridge.
    """
    links = materialise(worker_links(panel), "links")
    if group == "worker":
        return cut_vertices(links).where("node < 0").select((-1 - F.col("node")).alias("i"))
    found = bridges(links).join(links, ["src", "dst"])
    if group != "match":
        found = found.where("rows = 1" if group == "observation" else "spells = 1")
    pairs = found.select((-1 - F.col("src")).alias("i"), F.col("dst").alias("j"))
    if cross_membership:
        every = links.select((-1 - F.col("src")).alias("i"), F.col("dst").alias("j"))
        pairs = every.join(pairs.select("i").distinct(), "i", "left_semi").join(pairs.select("j").distinct(), "j", "left_semi").select("i", "j")
    return pairs


def _without(panel: Panel, rows: DataFrame, to_stays: bool) -> Panel:
    kept = panel.df.join(rows.distinct(), rows.columns, "left_anti").select(*panel.df.columns)
    return tidy(panel.rows(kept), to_stays)


def _may_grow(size: str) -> bool:
    """Whether a size can grow when rows go: movers may become stayers."""
    return "stay" in size


def _span(panel: Panel) -> int:
    """A number above every firm, by which a worker and a firm make one id."""
    low, workers, firms = panel.df.agg(F.least(F.min("i"), F.min("j")), F.max("i"), F.max("j")).first()
    if low is not None and (low < 0 or (workers + 1) * (firms + 1) >= 2**62):
        raise ValueError("ids must be dense (clean() makes them so)")
    return 1 if low is None else firms + 1


def _branches(parts: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Firms (j) with their branch: the part's least firm, and its path, which sorts branches as they are tried."""
    facts = parts.groupBy("component").agg(F.min("j").alias("branch"), F.first("vertices").alias("_n"))
    named = parts.select("j", "component").join(facts, "component")
    step = F.array((-F.col("_n")).cast("long"), F.col("branch").cast("long"))
    if above is None:
        return materialise(named.select("j", "branch", step.alias("path")), "branches")
    old = above.select(F.col("j").alias("branch"), F.col("path").alias("_above"))
    return materialise(named.join(old, "branch").select("j", "branch", F.concat("_above", step).alias("path")), "branches")


def _apart(panel: Panel, firms: DataFrame, origin, span: int, to_stays: bool) -> Panel:
    """The rows of the branches' firms. A worker of several branches becomes one of each: its id and the least firm it has there make the new id."""
    rows = panel.df.join(firms.select("j", "branch"), "j")
    first = F.min("j").over(Window.partitionBy("i", "branch")).cast("long")
    split = rows.withColumn("_first", first).withColumn("i", origin * F.lit(span).cast("long") + F.col("_first"))
    return _held(tidy(panel.rows(split.select(*panel.df.columns)), to_stays))


def _branch_sizes(panel: Panel, firms: DataFrame, size: str, suffix: str) -> DataFrame:
    rows = panel.df.withColumn("_mover", worker_m()).join(firms.select("j", "branch"), "j")
    return rows.groupBy("branch").agg(measure(size).alias(f"size{suffix}"), F.count("*").alias(f"rows{suffix}"))


def _of(panel: Panel, firms: DataFrame, branches: DataFrame) -> Panel:
    """The rows of some branches."""
    js = firms.join(branches.select("branch"), "branch", "left_semi").select("j")
    return panel.on(panel.df.join(js, "j", "left_semi").select(*panel.df.columns))


def _several(panel: Panel, firms: DataFrame, strong: bool) -> DataFrame:
    """Parts (j, component, vertices, branch) of the branches that fall into more than one."""
    found = firm_parts(panel, _graph(panel, strong), strong).join(firms.select("j", "branch"), "j")
    many = found.groupBy("branch").agg(F.count_distinct("component").alias("n")).where("n > 1")
    return materialise(found.join(many.select("branch"), "branch", "left_semi").select("j", "component", "vertices", "branch"), "several")


def leave_out(panel: Panel, group: str, strong: bool, size: str, to_stays: bool, cross_membership: bool = False) -> Panel:
    """The largest set of firms that no single observation, spell, match or worker holds together.

    A set of firms is a branch. It loses firms of fewer than two moves. Rows that hold it together
    are taken out to see what it falls into, and stay in the parts, which are the branches of the
    next level; a branch that doesn't fall apart is a candidate. All branches of a level go
    through the same jobs, as one panel in which they share no firm and no worker, so jobs grow
    with the levels and not with the branches. Branches come by path: most vertices first, then
    the smallest firm, inside the branch they are part of. Of the largest candidates the first
    one wins, and branches that can't beat the best one so far are left. For sizes that may grow
    when rows go, all branches are looked at, and the candidate is the one that trying the
    branches in order, and only those larger than the best so far, would end with.
    """
    span, grows = _span(panel), _may_grow(size)
    frame, origin, firms = panel, F.col("i").cast("long"), _branches(firm_parts(panel, _graph(panel, strong), strong))
    best, looked = None, []
    while True:
        own = _apart(frame, firms, origin, span, to_stays)
        origin = F.floor(F.col("i") / F.lit(span).cast("decimal(20,0)")).cast("long")
        table = firms.select("branch", "path").distinct().join(_branch_sizes(own, firms, size, ""), "branch")
        table = materialise(_beating(table, "size", best if not grows else None), "tried")
        if table.isEmpty():
            break
        pruned = _held(min_moves_frame(_of(own, firms, table), 2, to_stays))
        after = table.join(_branch_sizes(pruned, firms, size, "_after"), "branch", "left").na.fill(0, ["size_after", "rows_after"])
        after = materialise(after.withColumn("resplit", F.lit(False)), "pruned")
        parts = None
        if strong:
            parts = _several(_of(pruned, firms, after.where("rows <> rows_after")), firms, True)
            again = parts.select("branch", F.lit(True).alias("_again")).distinct()
            after = materialise(after.join(again, "branch", "left").withColumn("resplit", F.coalesce("_again", F.lit(False))).drop("_again"), "pruned")
        whole = _beating(after.where("not resplit"), "size_after", best if not grows else None)
        asked = _held(_of(pruned, firms, whole))
        loose = materialise(articulation_rows(asked, group, cross_membership), "articulation")
        touched = asked.df.join(loose, loose.columns, "left_semi").select("j").join(firms, "j").select("branch").distinct()
        less = _held(_without(_of(asked, firms, materialise(touched, "touched")), loose, to_stays))
        fallen = _several(less, firms, strong)
        parts = fallen if parts is None else parts.unionByName(fallen)
        held = whole.join(fallen.select("branch").distinct(), "branch", "left_anti")
        if grows:
            leaves = held.select("branch", F.lit(True).alias("_leaf"))
            looked.append((after.join(leaves, "branch", "left").select("path", "branch", "size", "size_after", "resplit", F.coalesce("_leaf", F.lit(False)).alias("leaf"), F.lit(len(looked)).alias("level")), pruned, firms, origin))
        else:
            top = _beating(held, "size_after", best[:2] if best else None).orderBy(F.col("size_after").desc(), "path").first()
            if top is not None and (best is None or top.size_after > best[0] or list(top.path) < best[1]):
                best = top.size_after, list(top.path), pruned, firms, top.branch
        if parts.isEmpty():
            break
        frame, above = pruned, firms
        paths = above.select("branch", "path").distinct().withColumnRenamed("branch", "_up")
        kids = parts.withColumnRenamed("branch", "_up").join(paths, "_up")
        firms = _branches(parts, kids.select("j", "path"))
    if grows:
        best = _tried_in_order(looked)
    if best is None:
        return panel.rows(panel.df.limit(0))
    _, _, pruned, firms, branch = best
    rows = pruned.df.join(firms.where(F.col("branch") == branch).select("j"), "j", "left_semi").withColumn("i", F.floor(F.col("i") / F.lit(span).cast("decimal(20,0)")).cast(dict(panel.df.dtypes)["i"]))
    return pruned.on(rows.select(*panel.df.columns))


def _beating(table: DataFrame, column: str, best: tuple | None) -> DataFrame:
    """Branches that could take the place of the best candidate: larger, or as large and earlier."""
    if best is None:
        return table
    size, path = best[:2]
    return table.where((F.col(column) > size) | ((F.col(column) == size) & (F.col("path") < F.array(*(F.lit(x).cast("long") for x in path)))))


def _tried_in_order(looked: list[tuple]) -> tuple | None:
    """The candidate that trying the branches one after another ends with, where a branch not larger than the best so far is left with all its parts. Branches stream by in order; one is held."""
    log = looked[0][0]
    for more in looked[1:]:
        log = log.unionByName(more[0])
    best, left = None, None
    for x in log.orderBy("path").toLocalIterator():
        path = list(x.path)
        if left is not None and path[: len(left)] == left:
            continue
        if best is not None and (x.size <= best[0] or not x.resplit and x.size_after <= best[0]):
            left = path
        elif x.leaf:
            best = x.size_after, path, *looked[x.level][1:3], x.branch
    return best


def _held(panel: Panel) -> Panel:
    return panel.on(materialise(panel.df, "panel"))


def connected(panel: Panel, how: str | None, size: str = "firms", drop_single_stayers: bool = False, to_stays: bool = False, cross_membership: bool = False) -> Panel:
    """Keep the largest connected set by one of the measures."""
    if how is None:
        return panel.on(panel.df, panel.meta.but(connectedness=None))
    if panel.meta.layout.wide:
        return panel.through_long(lambda p: connected(p, how, size, drop_single_stayers, to_stays, cross_membership))
    panel = _held(panel)
    if how in ("connected", "strongly_connected"):
        strong = how != "connected"
        out = largest(panel, firm_parts(panel, firm_links(panel), strong), size, to_stays)
    elif how == "leave_out_firm":
        ends = materialise(blocks(firm_links(panel, 2)).select(F.col("block").alias("component"), F.explode(F.array("src", "dst")).alias("j")).distinct(), "ends")
        parts = materialise(ends.join(ends.groupBy("component").agg(F.count("*").alias("vertices")), "component").select("j", "component", "vertices"), "blocks")
        out = largest(panel, parts, size, to_stays)
    else:
        strong = how.startswith("strongly_")
        out = leave_out(panel, how.removeprefix("strongly_").removeprefix("leave_out_"), strong, size, to_stays, cross_membership)
    if drop_single_stayers:
        weight = F.sum("w").over(one_worker()) if out.meta.has("w") else F.count("*").over(one_worker())
        rows = out.df.withColumns({"_mover": worker_m(), "_w": weight}).where("_mover or _w > 1").select(*out.df.columns)
        out = out.rows(rows)
    return out.on(out.df, out.meta.but(connectedness=how))
