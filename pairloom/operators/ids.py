"""Dense ids and the way back to the original ones."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.rows import row_order
from pairloom.plans.numbering import number_rows
from pairloom.plans.scratch import materialise

if TYPE_CHECKING:
    from pairloom.operators.panel import Panel


def unique_ids(panel: Panel, name: str) -> DataFrame:
    """Distinct non-null ids over all parts of a column."""
    parts = panel.meta.parts(name)
    each = panel.df.select(F.explode(F.array(*parts)).alias(name)) if len(parts) > 1 else panel.df.select(F.col(parts[0]).alias(name))
    return each.where(F.col(name).isNotNull()).distinct()


def dense_map(panel: Panel, name: str) -> DataFrame:
    """Each id of a column with its number, 0, 1, ... by first appearance in the sorted panel.

    A row's parts appear in order. Ids are brought down to one row each, with their first place,
    before they are numbered, so only distinct ids are sorted.
    """
    parts = panel.meta.parts(name)
    if name == "i":
        return number_rows(unique_ids(panel, "i"), [F.col("i")], "_new")
    order = ["i", *(p for p in row_order(panel))]
    place = F.struct(*order)
    seen = panel.df.select(F.posexplode(F.array(*parts)).alias("_k", name), place.alias("_p")).where(F.col(name).isNotNull())
    first = seen.groupBy(name).agg(F.min(F.struct("_p", "_k")).alias("_first"))
    return number_rows(first, [F.col("_first"), F.col(name)], "_new").select(name, "_new")


def make_dense(panel: Panel, name: str, force: bool = True) -> Panel:
    """Replace a column's ids by 0, 1, ...; integers that are dense already stay as they are."""
    if panel.meta.dense.get(name) and not force:
        return panel
    ids = unique_ids(panel, name)
    if dict(ids.dtypes)[name] in ("int", "bigint", "smallint", "tinyint"):
        lo, hi, n = ids.agg(F.min(name), F.max(name), F.count("*")).first()
        if n and (lo, hi) == (0, n - 1):
            return panel.on(panel.df, panel.meta.but(dense={**panel.meta.dense, name: True}))
    known = materialise(dense_map(panel, name), f"ids-{name}")
    df = panel.df
    for p in panel.meta.parts(name):
        df = df.join(known.select(F.col(name).alias("_old"), F.col("_new").alias("_id")), F.col(p) == F.col("_old"), "left").drop(p, "_old").withColumnRenamed("_id", p)
    history = panel.meta.history
    if history is not None:
        if name in history:
            old = history[name]
            last = old.columns[-1]
            step = known.select(F.col(name).alias("_k"), F.col("_new").alias(f"adjusted_ids_{len(old.columns)}"))
            table = old.join(step, F.col(last) == F.col("_k"), "left").drop("_k")
        else:
            table = known.select(F.col(name).alias("original_ids"), F.col("_new").alias("adjusted_ids_1"))
        history = {**history, name: table}
    return panel.on(df.select(*panel.df.columns), panel.meta.but(dense={**panel.meta.dense, name: True}, history=history))


def original_ids(panel: Panel) -> DataFrame | None:
    """The rows with original_<part> for every part whose ids were replaced; None if ids aren't tracked."""
    if panel.meta.history is None:
        return None
    df = panel.df
    for name, table in panel.meta.history.items():
        for p in panel.meta.parts(name):
            back = table.select(F.col(table.columns[-1]).alias("_k"), F.col("original_ids").alias(f"original_{p}"))
            df = df.join(back, F.col(p) == F.col("_k"), "left").drop("_k")
    return df
