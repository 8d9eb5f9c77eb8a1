"""Operators on long panels that keep, drop, merge or mark rows.

All of them see a worker's rows in one order, by_worker(panel); each needs the worker's rows in
one partition, so a chain of them is one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pairloom.functions.aggregates import TwoStage, as_column, group_values, is_custom
from pairloom.plans.scratch import drop_scratch, materialise

if TYPE_CHECKING:
    from pairloom.operators.panel import Panel

Ids = Iterable | DataFrame


def row_order(panel: Panel) -> list[str]:
    """Columns that order a worker's rows: time, firm, then the rest; total but for equal rows."""
    first = [p for c in ("t", "j") if panel.meta.has(c) for p in panel.meta.parts(c)]
    return first + [p for p in panel.meta.physical() if p not in first and p not in ("i", "m")]


def by_worker(panel: Panel) -> WindowSpec:
    return Window.partitionBy("i").orderBy(*row_order(panel))


def so_far(panel: Panel) -> WindowSpec:
    return by_worker(panel).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def one_worker() -> WindowSpec:
    return Window.partitionBy("i")



def gen_m(panel: Panel) -> Panel:
    """m: how many of a row's neighbours (the worker's row before and after) are at another firm."""
    w = by_worker(panel)
    other = [F.coalesce((x.over(w) != F.col("j")).cast("int"), F.lit(0)) for x in (F.lag("j"), F.lead("j"))]
    return panel.with_column("m", (other[0] + other[1]).cast("int"))


def worker_m() -> Column:
    """Whether the row's worker ever moves."""
    return F.max("m").over(one_worker()) > 0


def spell_number(panel: Panel) -> Column:
    """Running number of a worker's spells: it goes up where the firm changes."""
    w = by_worker(panel)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.lag("j").over(w).eqNullSafe(F.col("j"))).cast("int"))
    return changed


def with_spell(panel: Panel, name: str = "_spell") -> DataFrame:
    """The rows with their spell number and their place in the worker's order (_at)."""
    w = by_worker(panel)
    marked = panel.df.select("*", spell_number(panel).alias("_new"), F.row_number().over(w).alias("_at"))
    return marked.withColumn(name, F.sum("_new").over(Window.partitionBy("i").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def drop_na(panel: Panel) -> Panel:
    """Rows without a null or NaN in any column (m aside, which is worked out anew)."""
    return panel.rows(panel.df.na.drop(subset=[p for p in panel.meta.physical() if p != "m"]), no_na=True)


AGGREGATES: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "median": F.median, "var": F.var_samp, "std": F.stddev_samp, "count": F.count, "size": lambda c: F.count("*")}


def drop_i_t_duplicates(panel: Panel, how: str | Callable = "max") -> Panel:
    """One row for each worker and period: the one of largest y.

    Other than for max, y first becomes its aggregate over the worker's rows of the firm and
    period. how is a name, a function of a column, a function of the values (a numpy array) or a
    TwoStage aggregate. Equal y: the smaller j stays, then the row first in order of the other columns. Spells
    are first taken apart into periods and then merged again. Without t equal rows are merged.
    """
    if panel.meta.layout.collapsed and panel.meta.has("t"):
        return panel.uncollapse().drop_i_t_duplicates(how).collapse()
    if not panel.meta.has("t"):
        return panel.rows(panel.df.dropDuplicates(), no_duplicates=True)
    df = panel.df
    if is_custom(how):
        key = ["i", "t", "j"]
        made = None if isinstance(how, TwoStage) else as_column(how, "y")
        merged = group_values(df, key, "y", how, "y") if made is None else df.groupBy(*key).agg(made.alias("y"))
        df = df.drop("y").join(merged, key).select(*df.columns)
    elif how != "max":
        df = df.withColumn("y", AGGREGATES[how](F.col("y")).over(Window.partitionBy("i", "t", "j")).cast("double"))
    rest = [p for p in panel.meta.physical() if p not in ("i", "t", "y", "j", "m")]
    best = Window.partitionBy("i", "t").orderBy(F.col("y").desc(), "j", *rest)
    kept = df.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return gen_m(panel.rows(kept, no_duplicates=True, i_t_unique=True))


def returns_flag(panel: Panel) -> DataFrame:
    """Rows with _returns: whether the worker has more than one spell at the row's firm."""
    pair = Window.partitionBy("i", "j")
    return with_spell(panel).withColumn("_returns", F.min("_spell").over(pair) < F.max("_spell").over(pair))


def drop_returns(panel: Panel, how: str | bool) -> Panel:
    """Drop rows of firms that a worker comes back to, the workers who do, or all but the first or last such spell.

    With False nothing is dropped, but it is found out whether there are returns.
    """
    found = returns_flag(panel)
    if how is False:
        none = found.where("_returns").isEmpty()
        return panel.rows(panel.df, keep_facts=True, no_returns=none)
    pair = Window.partitionBy("i", "j")
    test = {
        "returns": ~F.col("_returns"),
        "returners": ~F.max("_returns").over(one_worker()),
        "keep_first_returns": F.col("_spell") == F.min("_spell").over(pair),
        "keep_last_returns": F.col("_spell") == F.max("_spell").over(pair),
    }[how]
    kept = found.withColumn("_keep", test).where("_keep").select(*panel.df.columns)
    return tidy(panel.rows(kept, no_returns=True))


def tidy(panel: Panel, drop_returns_to_stays: bool = False) -> Panel:
    """After rows went: merge spells that became neighbours, and work out m again."""
    if panel.meta.layout.collapsed:
        return panel.recollapse(drop_returns_to_stays)
    return gen_m(panel)


def id_frame(panel: Panel, ids: Ids, name: str) -> DataFrame:
    """Distinct ids as a table of one column, of the panel's type."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    kind = dict(panel.df.dtypes)[panel.meta.parts(name)[0]]
    return panel.df.sparkSession.createDataFrame([(x,) for x in set(ids)], f"`{name}` {kind}")


def keep_ids(panel: Panel, name: str, ids: Ids, drop_returns_to_stays: bool = False, keep: bool = True) -> Panel:
    """Rows whose id is (or, with keep=False, is not) among ids. Spark broadcasts the ids only if they are few."""
    if panel.meta.layout.wide:
        return panel.through_long(lambda long: keep_ids(long, name, ids, drop_returns_to_stays, keep))
    kept = panel.df.join(id_frame(panel, ids, name), name, "left_semi" if keep else "left_anti").select(*panel.df.columns)
    out = panel.rows(kept)
    return out if name == "i" else tidy(out, drop_returns_to_stays)


def numbered(panel: Panel) -> DataFrame:
    """Rows with _row, their place when the panel is sorted by worker and time."""
    from pairloom.plans.numbering import number_rows

    return number_rows(panel.df, [F.col("i"), *map(F.col, row_order(panel))], "_row")


def keep_rows(panel: Panel, rows: Ids, drop_returns_to_stays: bool = False, keep: bool = True) -> Panel:
    """Rows at the given places of the sorted panel (or all others)."""
    if panel.meta.layout.wide:
        chosen = panel.rows(numbered(panel).join(places(panel, rows), "_row", "left_semi" if keep else "left_anti").select(*panel.df.columns))
        return chosen.through_long(lambda long: tidy(long, drop_returns_to_stays)) if panel.meta.layout.collapsed else chosen
    kept = numbered(panel).join(places(panel, rows), "_row", "left_semi" if keep else "left_anti").select(*panel.df.columns)
    return tidy(panel.rows(kept), drop_returns_to_stays)


def places(panel: Panel, rows: Ids) -> DataFrame:
    if isinstance(rows, DataFrame):
        return rows.select(F.col(rows.columns[0]).cast("long").alias("_row")).distinct()
    return panel.df.sparkSession.createDataFrame([(int(x),) for x in set(rows)], "_row long")


def min_obs_ids(panel: Panel, threshold: int = 2, name: str = "j") -> DataFrame:
    """Ids with at least threshold rows of the long panel; counted in the tasks before they meet."""
    return panel.as_long().df.groupBy(name).count().where(F.col("count") >= threshold).select(name)


def min_workers_firms(panel: Panel, threshold: int = 15) -> DataFrame:
    """Firms with at least threshold workers."""
    return panel.as_long().df.select("j", "i").distinct().groupBy("j").count().where(F.col("count") >= threshold).select("j")


def min_moves_firms(panel: Panel, threshold: int = 2) -> DataFrame:
    """Firms with at least threshold rows of m > 0."""
    return panel.as_long().df.where("m > 0").groupBy("j").count().where(F.col("count") >= threshold).select("j")


def min_movers_firms(panel: Panel, threshold: int = 15) -> DataFrame:
    """Firms with at least threshold workers among rows of m > 0."""
    return panel.as_long().df.where("m > 0").select("j", "i").distinct().groupBy("j").count().where(F.col("count") >= threshold).select("j")


def until_stable(panel: Panel, step: Callable[[Panel], Panel], loop: bool = True) -> Panel:
    """Apply step until no row goes; each round is written to the shared folder."""
    if not loop:
        return step(panel)
    now, scratch = panel, None
    before = panel.df.count()
    while True:
        after = step(now)
        held = materialise(after.df, "round")
        count = held.count()
        now = after.on(held)
        if scratch is not None:
            drop_scratch(scratch)
        scratch = held
        if count == before:
            return now
        before = count


def _moves_of(rows: DataFrame, distinct: bool) -> DataFrame:
    """How many rows of m > 0 each worker has at a firm; with distinct, one for each such worker."""
    count = F.lit(1).cast("long") if distinct else F.count("*")
    return rows.where("m > 0").groupBy("i", "j").agg(count.alias("n"))


def peel_firms(panel: Panel, threshold: int, distinct: bool) -> Panel:
    """Drop firms of too few moves (distinct: movers) until all that stay have enough, by what changes.

    Firms' counts are kept in a table. When firms go, only workers with rows there can have other
    moves than before: their rows before and after give what to take from the counts of other
    firms, and those that fall below the threshold go next. The panel itself is written once and
    then filtered; a round shuffles rows of touched workers only.
    """
    rows = materialise(panel.df.where("j is not null"), "panel")
    counts = _moves_of(rows, distinct).groupBy("j").agg(F.sum("n").alias("n"))
    counts = materialise(rows.select("j").distinct().join(counts, "j", "left").na.fill(0, ["n"]), "counts")
    gone = counts.where(F.col("n") < threshold).select("j")
    last = None
    while not gone.isEmpty():
        touched = materialise(rows.join(rows.join(gone, "j", "left_semi").select("i").distinct(), "i", "left_semi"), "touched")
        was = touched if last is None else touched.join(last, "j", "left_anti").select(*panel.df.columns)
        every = materialise(gone if last is None else last.unionByName(gone), "gone")
        now = touched.join(every, "j", "left_anti").select(*panel.df.columns)
        less = _moves_of(gen_m(panel.on(was)).df, distinct).unionByName(_moves_of(gen_m(panel.on(now)).df, distinct).withColumn("n", -F.col("n")))
        lost = less.groupBy("j").agg(F.sum("n").alias("lost")).where("lost <> 0")
        left = counts.join(every, "j", "left_anti").join(lost, "j", "left")
        after = materialise(left.select("j", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")), "counts")
        for table in (counts, touched):
            drop_scratch(table)
        counts, last = after, every
        gone = counts.where(F.col("n") < threshold).select("j")
    if last is None:
        return panel.on(rows)
    return gen_m(panel.rows(rows.join(last, "j", "left_anti").select(*panel.df.columns)))


def peel_pairs(panel: Panel, thresholds: dict[str, int]) -> Panel:
    """Drop ids of either column with too few rows until all that stay have enough, by what changes.

    Rows are counted by pair of ids once. Rows of ids that go, and haven't gone already, are taken
    from the counts of the other column's ids.
    """
    a, b = thresholds
    rows = materialise(panel.df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), "panel")
    pairs = materialise(rows.groupBy(a, b).agg(F.count("*").alias("n")), "pairs")
    counts = {c: materialise(pairs.groupBy(c).agg(F.sum("n").alias("n")), "counts") for c in (a, b)}
    gone: dict[str, DataFrame | None] = {a: None, b: None}
    name, other, idle = a, b, 0
    while idle < 2:
        new = materialise(counts[name].where(F.col("n") < thresholds[name]).select(name), "gone")
        idle = idle + 1 if new.isEmpty() else 0
        if not idle:
            went = pairs.join(new, name, "left_semi")
            went = went if gone[other] is None else went.join(gone[other], other, "left_anti")
            lost = went.groupBy(other).agg(F.sum("n").alias("lost"))
            counts[other] = materialise(counts[other].join(lost, other, "left").select(other, (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")), "counts")
            counts[name] = counts[name].join(new, name, "left_anti")
            gone[name] = new if gone[name] is None else materialise(gone[name].unionByName(new), "gone")
        name, other = other, name
    kept = rows
    for c, ids in gone.items():
        kept = kept if ids is None else kept.join(ids, c, "left_anti")
    return gen_m(panel.rows(kept.select(*panel.df.columns)))


def _merges(panel: Panel) -> bool:
    return panel.meta.layout.collapsed and panel.meta.no_returns is not True


def _frame(panel: Panel, find: Callable[[Panel], DataFrame], name: str, to_stays: bool, loop: bool) -> Panel:
    if panel.meta.layout.wide:
        return panel.through_long(lambda long: _frame(long, find, name, to_stays, loop))
    return until_stable(panel, lambda p: keep_ids(p, name, find(p), to_stays), loop)


def min_obs_frame(panel: Panel, threshold: int = 2, name: str = "j", drop_returns_to_stays: bool = False) -> Panel:
    """Rows whose id has at least threshold rows; again where merged spells make rows fewer."""
    return panel if threshold <= 1 else _frame(panel, lambda p: min_obs_ids(p, threshold, name), name, drop_returns_to_stays, _merges(panel.as_long()))


def min_joint_obs_frame(panel: Panel, threshold_1: int = 2, threshold_2: int = 2, name_1: str = "j", name_2: str = "i", drop_returns_to_stays: bool = False) -> Panel:
    """Rows of the largest set in which every id of either column has enough rows."""
    if panel.meta.layout.wide:
        return panel.through_long(lambda long: min_joint_obs_frame(long, threshold_1, threshold_2, name_1, name_2, drop_returns_to_stays))
    if not _merges(panel) and name_1 != name_2:
        return peel_pairs(panel, {name_1: threshold_1, name_2: threshold_2})
    return until_stable(panel, lambda p: min_obs_frame(min_obs_frame(p, threshold_1, name_1, drop_returns_to_stays), threshold_2, name_2, drop_returns_to_stays))


def min_workers_frame(panel: Panel, threshold: int = 15, drop_returns_to_stays: bool = False) -> Panel:
    return panel if threshold <= 1 else _frame(panel, lambda p: min_workers_firms(p, threshold), "j", drop_returns_to_stays, _merges(panel.as_long()))


def min_moves_frame(panel: Panel, threshold: int = 2, drop_returns_to_stays: bool = False) -> Panel:
    """Rows of firms with enough moves, where dropping firms takes moves from others: until nothing changes."""
    return panel if threshold <= 0 else _peeled(panel, threshold, False, drop_returns_to_stays)


def min_movers_frame(panel: Panel, threshold: int = 15, drop_returns_to_stays: bool = False) -> Panel:
    return panel if threshold <= 0 else _peeled(panel, threshold, True, drop_returns_to_stays)


def _peeled(panel: Panel, threshold: int, distinct: bool, to_stays: bool) -> Panel:
    """Spells that merge change a worker's rows for good, so such panels are gone through as a whole in each round."""
    if panel.meta.layout.wide:
        return panel.through_long(lambda long: _peeled(long, threshold, distinct, to_stays))
    if not _merges(panel):
        return peel_firms(panel, threshold, distinct)
    return _frame(panel, lambda p: (min_movers_firms if distinct else min_moves_firms)(p, threshold), "j", to_stays, True)


def fill_missing_periods(panel: Panel, fill: dict | None = None) -> DataFrame:
    """The rows and one more for each period between a worker's consecutive rows: j is -1, other columns null.

    fill gives other values: a constant, or 'prev' for the value of the row before. A text for a
    column of numbers makes the whole column text.
    """
    fill = {"j": -1} | (fill or {})
    df = panel.df
    for name, value in fill.items():
        if value != "prev" and isinstance(value, str) and dict(df.dtypes)[name] != "string":
            df = df.withColumn(name, F.col(name).cast("string"))
    upto = F.lead("t").over(by_worker(panel)) - 1
    gaps = df.withColumn("_to", upto).where(F.col("_to") > F.col("t")).select("*", F.explode(F.sequence(F.col("t") + 1, F.col("_to"))).alias("_t"))
    kinds = dict(df.dtypes)

    def value(name: str) -> Column:
        if name == "i":
            return F.col("i")
        if name == "t":
            return F.col("_t").cast(kinds["t"]).alias("t")
        if name in fill:
            return F.col(name) if fill[name] == "prev" else F.lit(fill[name]).cast(kinds[name]).alias(name)
        return F.lit(None).cast(kinds[name]).alias(name)

    return df.unionByName(gaps.select(*map(value, df.columns)))
