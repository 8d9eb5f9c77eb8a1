"""What a panel holds, as tables: summary, checks and comparisons."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.numbering import exact_quantiles

if TYPE_CHECKING:
    from pairloom.operators.panel import Panel


def summary(panel: Panel) -> DataFrame:
    """One row: statistics of y over all periods, and numbers of rows and ids."""
    parts = panel.meta.parts("y")
    each = panel.df.select(F.explode(F.array(*parts)).alias("y"))
    stats = each.agg(F.avg("y").alias("mean_y"), F.lit(exact_quantiles(each, "y", [0.5])[0]).cast("double").alias("median_y"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.var_pop("y").alias("var_y"))
    counts = panel.df.agg(F.count("*").alias("n_rows"))
    for name, label in (("i", "n_workers"), ("j", "n_firms"), ("g", "n_clusters")):
        if panel.meta.has(name):
            counts = counts.crossJoin(panel.unique_ids(name).agg(F.count("*").alias(label)))  # rows of one number each
    facts = {k: getattr(panel.meta, k) for k in ("connectedness", "no_na", "no_duplicates", "i_t_unique", "no_returns")}
    return stats.crossJoin(counts).select("*", *(F.lit(v).cast("string").alias(k) for k, v in facts.items()))


def diagnostic(panel: Panel) -> DataFrame:
    """One row (check, value) for each property, worked out from the rows and not from remembered facts."""
    from pairloom.operators import rows
    from pairloom.operators.connect import firm_parts, firm_links

    long = panel.as_long()
    long = long if long.meta.has("m") else rows.gen_m(long)
    spark = panel.df.sparkSession
    physical = panel.df.columns
    nulls = panel.df.select(*(F.sum(F.col(p).isNull().cast("long")).alias(p) for p in physical)).first()
    total = panel.df.count()
    found: dict[str, object] = {"rows": total, "nulls": sum(x or 0 for x in nulls), "duplicates": total - panel.df.distinct().count()}
    if long.meta.has("t"):
        key = ["i", *long.meta.parts("t")[:1]]
        found["i_t_unique"] = long.df.groupBy(*key).count().where("count > 1").isEmpty()
    found["no_returns"] = rows.returns_flag(long).where("_returns").isEmpty()
    again = rows.gen_m(long).df.agg(F.sum("m")).first()[0]
    found["m_sum"], found["m_sum_expected"] = long.df.agg(F.sum("m")).first()[0], again
    for name in ("i", "j", "g"):
        if panel.meta.has(name):
            ids = panel.unique_ids(name)
            found[f"n_{name}"] = ids.count()
            if dict(ids.dtypes)[name] in ("int", "bigint"):
                lo, hi = ids.agg(F.min(name), F.max(name)).first()
                found[f"{name}_dense"] = (lo, hi) == (0, found[f"n_{name}"] - 1)
    if dict(long.df.dtypes)["j"] in ("int", "bigint"):
        for label, strong in (("connected", False), ("strongly_connected", True)):
            found[label] = firm_parts(long, firm_links(long), strong).select("component").distinct().count() <= 1
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "check string, value string")


def compare(a: Panel, b: Panel, size: str = "len", operator: str = "geq") -> bool:
    """Compare a size of two panels."""
    from pairloom.operators.connect import panel_size

    x, y = panel_size(a, size), panel_size(b, size)
    return {"eq": x == y, "gt": x > y, "lt": x < y, "geq": x >= y, "leq": x <= y}[operator]
