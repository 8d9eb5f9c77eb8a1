"""From one layout to another.

Runs of rows become wide rows with lag and lead over a worker's rows, wide rows become runs by
exploding an array of structs; neither joins a table with itself. Only the permuted event study,
whose result is all pairs of a worker's spells, does.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.functions.aggregates import group_values, is_custom
from pairloom.operators.model import Layout
from pairloom.operators.rows import by_worker, gen_m, one_worker, row_order, with_spell, worker_m
from pairloom.plans.numbering import running_sum
from pairloom.plans.scratch import materialise

if TYPE_CHECKING:
    from pairloom.operators.panel import Panel


def _merged(rows: DataFrame, panel: Panel, keys: list[str], again: bool) -> DataFrame:
    """One row for each key: every column by its rule. rows has _at, the place of a row in its worker.

    Means, variances and deviations are weighted if there are weights: variance is then that of
    the population, otherwise of a sample. Functions of values and two-stage aggregates are worked
    out for themselves and joined. again: spells are merged that were merged before, so a
    variance can't be told any more and is null.
    """
    weighted = panel.meta.has("w")
    group = Window.partitionBy(*keys)
    kept = [c for c in panel.meta.names() if c not in ("i", "j", "t", "m", "w") and panel.meta.columns[c].collapse is not None]
    for c in kept:
        if weighted and not again and panel.meta.columns[c].collapse in ("var", "std"):
            rows = rows.withColumn(f"_mean_{c}", F.sum(F.col("w") * F.col(c)).over(group) / F.sum("w").over(group))

    def rule(c: str) -> Column:
        how = panel.meta.columns[c].collapse
        x, w = F.col(c), F.col("w")
        if how == "mean":
            return F.sum(w * x) / F.sum(F.when(x.isNotNull(), w)) if weighted else F.avg(x)
        if how in ("var", "std"):
            if again:
                return F.lit(None).cast("double")
            if weighted:
                var = F.sum(w * F.pow(x - F.col(f"_mean_{c}"), 2)) / F.sum("w")
                return var if how == "var" else F.sqrt(var)
            return F.var_samp(x) if how == "var" else F.stddev_samp(x)
        if how in ("first", "last"):
            at = F.when(x.isNotNull(), F.col("_at"))
            return F.min_by(x, at) if how == "first" else F.max_by(x, at)
        if how == "nunique":
            return F.count_distinct(x)
        return {"sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "count": F.count, "size": lambda _: F.count("*")}[how](x)

    spans = panel.meta.base("t") if panel.meta.has("t") else []
    times = [F.min(spans[0]).alias("t1"), F.max(spans[-1]).alias("t2")] if spans else []
    firm = [] if "j" in keys else [F.min("j").alias("j")]
    weight = F.sum("w") if weighted else F.count("*").cast("double")
    staged = [c for c in kept if is_custom(panel.meta.columns[c].collapse)]
    got = rows.groupBy(*keys).agg(*firm, *times, *(rule(c).alias(c) for c in kept if c not in staged), weight.alias("w"), F.count("*").alias("_rows"))
    for c in staged:
        got = got.join(group_values(rows, keys, c, panel.meta.columns[c].collapse, c), keys)
    return got


def _collapsed(panel: Panel, rows: DataFrame, **facts) -> Panel:
    columns = {c: v for c, v in panel.meta.columns.items() if v.collapse is not None or c in ("m", "w", "t")}
    from pairloom.operators.model import STANDARD

    meta = panel.meta.but(layout=Layout.COLLAPSED, columns=columns | {"w": STANDARD["w"], "m": STANDARD["m"]}, **facts)
    return gen_m(panel.on(rows.withColumn("m", F.lit(0)), meta))


def collapse(panel: Panel, level: str = "spell") -> Panel:
    """One row for each spell (a worker's run of rows at one firm) or each match (worker and firm)."""
    if panel.meta.layout is not Layout.LONG:
        raise NotImplementedError(f"a panel in {panel.meta.layout.value} form can't be collapsed; make it long first")
    if level not in ("spell", "match"):
        raise ValueError("level must be 'spell' or 'match'")
    match = level == "match" or not panel.meta.has("t")
    rows = with_spell(panel)
    got = _merged(rows, panel, ["i", "j"] if match else ["i", "_spell"], again=False).drop("_rows", "_spell")
    return _collapsed(panel, got, no_returns=True if match else panel.meta.no_returns, i_t_unique=panel.meta.i_t_unique)


def recollapse(panel: Panel, drop_returns_to_stays: bool = False) -> Panel:
    """Merge spells of a worker and firm that follow one another, or drop them (and look again)."""
    if panel.meta.layout is not Layout.COLLAPSED:
        raise NotImplementedError("only collapsed long panels are merged again")
    if panel.meta.no_returns:
        return gen_m(panel)
    if drop_returns_to_stays:
        from pairloom.operators.rows import until_stable

        def lone(p: Panel) -> Panel:
            n = F.count("*").over(Window.partitionBy("i", "_spell"))
            return p.on(with_spell(p).withColumn("_n", n).where("_n = 1").select(*p.df.columns))

        return gen_m(until_stable(panel, lone))
    got = _merged(with_spell(panel), panel, ["i", "_spell"], again=True)
    var = [c for c in panel.meta.names() if panel.meta.columns[c].collapse in ("var", "std")]
    if var:  # a spell of one row keeps what it had
        old = with_spell(panel).groupBy("i", "_spell").agg(*(F.max(c).alias(f"_old_{c}") for c in var))
        got = got.join(old, ["i", "_spell"]).withColumns({c: F.when(F.col("_rows") == 1, F.col(f"_old_{c}")) for c in var}).drop(*(f"_old_{c}" for c in var))
    return _collapsed(panel, got.drop("_rows", "_spell"))


def uncollapse(panel: Panel, drop_no_collapse_columns: bool = True) -> Panel:
    """One row for each period of a spell; sums are spread evenly, other columns repeated."""
    if panel.meta.layout is not Layout.COLLAPSED:
        raise NotImplementedError(f"a panel in {panel.meta.layout.value} form can't be uncollapsed; make it long first")
    columns = {c: v for c, v in panel.meta.columns.items() if not drop_no_collapse_columns or v.collapse is not None or c == "m"}
    meta = panel.meta.but(layout=Layout.LONG, columns=columns)
    if not panel.meta.has("t"):
        return gen_m(panel.on(panel.df, meta))
    span = F.col("t2") - F.col("t1") + 1
    sums = [c for c, v in columns.items() if v.collapse == "sum"]
    rows = panel.df.withColumns({c: F.col(c) / span for c in sums}).select("*", F.explode(F.sequence("t1", "t2")).alias("t")).drop("t1", "t2")
    return gen_m(panel.on(rows, meta))


def _carried(panel: Panel) -> list[str]:
    return [c for c in panel.meta.names() if c not in ("i", "m") and panel.meta.columns[c].split is False]


def _split(panel: Panel) -> list[str]:
    return [c for c in panel.meta.names() if c != "i" and panel.meta.columns[c].split is True]


def _wide_meta(panel: Panel, layout: Layout, periods: int):
    columns = {c: v for c, v in panel.meta.columns.items() if v.split is not None or c == "m"}
    return panel.meta.but(layout=layout, columns=columns, periods=periods)


def worker_by_row(panel: Panel) -> Panel:
    """Each wide row becomes a worker of its own: i is the row's place in the sorted panel."""
    from pairloom.operators.rows import numbered

    rows = numbered(panel).withColumn("i", F.col("_row")).drop("_row")
    return panel.on(rows, panel.meta.but(dense={**panel.meta.dense, "i": True}))


def to_eventstudy(panel: Panel, move_to_worker: bool = False) -> Panel:
    """Movers: each row with the row before it. Stayers: each row with itself."""
    if panel.meta.layout.wide:
        raise NotImplementedError("the panel is wide already")
    if not panel.meta.has("t"):
        raise NotImplementedError("event studies need the column t (see construct_artificial_time)")
    w = by_worker(panel)
    mover = worker_m()
    cols: list[Column] = [F.col("i")]
    meta = _wide_meta(panel, panel.meta.layout.as_event(), 2)
    for c in _split(panel):
        for b in panel.meta.base(c):
            tail = b[len(c) :]
            cols += [F.when(F.col("_mover"), F.lag(b).over(w)).otherwise(F.col(b)).alias(f"{c}1{tail}"), F.col(b).alias(f"{c}2{tail}")]
    cols += [F.col(b) for c in _carried(panel) for b in panel.meta.base(c)]
    rows = panel.df.withColumn("_mover", mover).select(*cols, "_mover", F.row_number().over(w).alias("_at")).where("not _mover or _at > 1")
    out = panel.on(rows.withColumn("m", (F.col("j1") != F.col("j2")).cast("int")), meta)
    return worker_by_row(out) if move_to_worker else out


def to_extendedeventstudy(panel: Panel, periods_pre: int = 2, periods_post: int = 2, stable_pre: list[str] | str | None = None, stable_post: list[str] | str | None = None, transition_col: list[str] | str | None = None, move_to_worker: bool = True) -> Panel:
    """Runs of periods_pre + periods_post consecutive rows of a worker.

    transition_col: columns that change between the two blocks; stable_pre and stable_post:
    columns that don't change inside a block (a block of one row never does).
    """
    if panel.meta.layout.wide:
        raise NotImplementedError("the panel is wide already")
    if not panel.meta.has("t"):
        raise NotImplementedError("event studies need the column t (see construct_artificial_time)")
    n = periods_pre + periods_post
    w = by_worker(panel)
    listed = [[x] if isinstance(x, str) else list(x or []) for x in (stable_pre, stable_post, transition_col)]
    meta = _wide_meta(panel, panel.meta.layout.as_extended(), n)
    cols: list[Column] = [F.col("i")]
    for c in _split(panel):
        for k in range(1, n + 1):
            cols += [(F.lead(b, k - 1).over(w) if k > 1 else F.col(b)).alias(f"{c}{k}{b[len(c) :]}") for b in panel.meta.base(c)]
    cols += [F.col(b) for c in _carried(panel) for b in panel.meta.base(c)]
    rows = panel.df.select(*cols, F.lead(F.lit(1), n - 1).over(w).alias("_last") if n > 1 else F.lit(1).alias("_last")).where("_last = 1")
    for c in listed[2]:
        rows = rows.where(F.col(f"{c}{periods_pre}") != F.col(f"{c}{periods_pre + 1}"))
    for names, span in ((listed[0], range(2, periods_pre + 1)), (listed[1], range(periods_pre + 2, n + 1))):
        for c in names:
            for k in span:
                rows = rows.where(F.col(f"{c}{k - 1}") == F.col(f"{c}{k}"))
    moved = F.lit(False)
    for k in range(2, n + 1):
        moved = moved | (F.col(f"j{k}") != F.col("j1"))
    out = panel.on(rows.withColumn("m", moved.cast("int")), meta)
    return worker_by_row(out) if move_to_worker else out


def _period(panel: Panel, long_meta, k: int) -> Column:
    parts = []
    for c in long_meta.names():
        if c in ("i", "m"):
            continue
        parts += [F.col(p).alias(b) for p, b in zip(panel.meta.parts(c, k), long_meta.base(c), strict=True)]
    return F.struct(*parts)


def to_long(panel: Panel, is_clean: bool = True, drop_no_split_columns: bool = True) -> Panel:
    """Wide rows back into their runs.

    Event studies: the first period of every row, and the second of a mover's last row (with
    is_clean=False of all of a mover's rows). Extended ones: all periods, equal rows once.
    drop_no_split_columns: leave out columns that have one value for a wide row.
    """
    if not panel.meta.layout.wide:
        return panel
    columns = {c: v for c, v in panel.meta.columns.items() if v.split is True or c in ("i", "m") or not drop_no_split_columns}
    meta = panel.meta.but(layout=panel.meta.layout.as_long(), columns=columns, periods=1)
    if panel.meta.layout.extended:
        each = F.array(*(_period(panel, meta, k) for k in range(1, panel.meta.periods + 1)))
        rows = panel.df.select("i", F.explode(each).alias("x")).select("i", "x.*").dropDuplicates()
    else:
        first, second = _period(panel, meta, 1), _period(panel, meta, 2)
        last = F.lead("i").over(by_worker(panel)).isNull() if is_clean else F.lit(True)
        rows = panel.df.withColumns({"_mover": worker_m(), "_last": last}).select("i", F.explode(F.when(F.col("_mover") & F.col("_last"), F.array(first, second)).otherwise(F.array(first))).alias("x")).select("i", "x.*")
    return gen_m(panel.on(rows.withColumn("m", F.lit(0)), meta))


def get_cs(panel: Panel) -> DataFrame:
    """Cross-section: every row with cs = 1, and rows of movers a second time with the periods swapped and cs = 0."""
    if panel.meta.layout not in (Layout.EVENT, Layout.COLLAPSED_EVENT):
        raise NotImplementedError("cross-sections are of event studies")
    names = panel.meta.physical()
    swap = {}
    for c in panel.meta.names():
        if c != "i" and panel.meta.columns[c].split is True:
            for a, b in zip(panel.meta.parts(c, 1), panel.meta.parts(c, 2), strict=True):
                swap |= {a: b, b: a}
    as_is = F.struct(*(F.col(p) for p in names), F.lit(1).alias("cs"))
    turned = F.struct(*(F.col(swap.get(p, p)).alias(p) for p in names), F.lit(0).alias("cs"))
    return panel.df.select(F.explode(F.when(F.col("m") > 0, F.array(as_is, turned)).otherwise(F.array(as_is))).alias("x")).select("x.*")


def to_permutedeventstudy(panel: Panel, order: str = "sequential", move_to_worker: bool = False, seed: int = 0) -> Panel:
    """All pairs of a mover's spells, and each stayer's spell with itself.

    sequential: the earlier spell first. income: for each pair of firms, the half of its workers
    with the lower mean income goes one way, the other half the other way, an odd one by a coin
    (the first digit of a checksum of the two firms and the seed). Workers are ranked in ranges of
    the order, so a pair of firms with many workers is in no task as a whole.
    A worker may not come back to a firm. The result has n (n - 1) / 2 rows for n spells.
    """
    if panel.meta.layout is not Layout.COLLAPSED:
        raise NotImplementedError("permuted event studies are made of collapsed long panels")
    if order not in ("sequential", "income"):
        raise ValueError("order must be 'sequential' or 'income'")
    found = returns_exist(panel) if panel.meta.no_returns is None else not panel.meta.no_returns
    if found:
        raise NotImplementedError("workers must not come back to a firm (see drop_returns)")
    w = by_worker(panel)
    weight = F.col("w") if panel.meta.has("w") else F.lit(1.0)
    income = F.sum(weight * F.col("y")).over(one_worker()) / F.sum(weight).over(one_worker())
    split = [b for c in _split(panel) for b in panel.meta.base(c)]
    rest = [b for c in _carried(panel) for b in panel.meta.base(c)]
    rows = panel.df.withColumns({"_at": F.row_number().over(w), "_mover": worker_m(), "_income": income})
    own = F.struct(*split, "_at").alias("a")
    left = rows.where("_mover").select("i", "_income", own, *rest)
    right = rows.where("_mover").select("i", F.struct(*split, "_at").alias("b"))
    pairs = left.join(right, "i").where("a._at < b._at")
    if order == "income":
        pairs = pairs.withColumns({"_lo": F.least("a.j", "b.j"), "_hi": F.greatest("a.j", "b.j"), "_one": F.lit(1)})
        ranked = materialise(running_sum(pairs, ["_income", "i"], "_one", "_rank", within=("_lo", "_hi")), "ranked")  # a pair of firms may span ranges
        pairs = ranked.join(ranked.groupBy("_lo", "_hi").agg(F.count("*").alias("_n")), ["_lo", "_hi"])
        coin = (F.substring(F.md5(F.concat_ws("|", "_lo", "_hi", F.lit(seed))), 1, 1) < "8").cast("int")
        half = F.floor(F.col("_n") / 2) + F.when(F.col("_n") % 2 == 1, coin).otherwise(0)
        from_hi = F.col("_rank") <= half
        first_is_a = from_hi == (F.col("a.j") == F.col("_hi"))
        pairs = pairs.withColumns({"_x": F.when(first_is_a, F.col("a")).otherwise(F.col("b")), "_y": F.when(first_is_a, F.col("b")).otherwise(F.col("a"))})
        pairs = pairs.select("i", F.col("_x").alias("a"), F.col("_y").alias("b"), *rest)
    else:
        pairs = pairs.select("i", "a", "b", *rest)
    same = rows.where("not _mover").select("i", own, F.struct(*split, "_at").alias("b"), *rest)
    meta = _wide_meta(panel, Layout.COLLAPSED_EVENT, 2)

    def wide(name: str) -> list[Column]:
        c = next(c for c in _split(panel) if name in panel.meta.base(c))
        tail = name[len(c) :]
        return [F.col(f"a.{name}").alias(f"{c}1{tail}"), F.col(f"b.{name}").alias(f"{c}2{tail}")]

    got = pairs.unionByName(same).select("i", *(x for b in split for x in wide(b)), *rest)
    out = panel.on(got.withColumn("m", (F.col("j1") != F.col("j2")).cast("int")), meta)
    return worker_by_row(out) if move_to_worker else out


def returns_exist(panel: Panel) -> bool:
    from pairloom.operators.rows import returns_flag

    return not returns_flag(panel).where("_returns").isEmpty()


def construct_artificial_time(panel: Panel, time_per_worker: bool = False) -> Panel:
    """Add t where there is none: a counter over the sorted panel, or over each worker's rows.

    Wide rows get consecutive values for their periods; stayers of event studies one value twice.
    """
    if panel.meta.has("t"):
        return panel
    from pairloom.operators.model import STANDARD
    from pairloom.operators.rows import numbered

    meta = panel.meta.but(columns={**panel.meta.columns, "t": STANDARD["t"]})
    if time_per_worker:
        rows = panel.df.withColumn("_row", (F.row_number().over(Window.partitionBy("i").orderBy(*row_order(panel))) - 1).cast("long"))
    else:
        rows = numbered(panel)
    if not panel.meta.layout.wide:
        spans = meta.base("t")
        return panel.on(rows.withColumns(dict.fromkeys(spans, F.col("_row"))).drop("_row"), meta)
    n = panel.meta.periods
    begin = F.col("_row") * n if panel.meta.layout.extended else F.col("_row")
    still = F.lit(True) if panel.meta.layout.extended else F.col("m") > 0
    times = {p: begin + F.when(still, k - 1).otherwise(0) for k in range(1, n + 1) for p in meta.parts("t", k)}
    return panel.on(rows.withColumns(times).drop("_row"), meta)
