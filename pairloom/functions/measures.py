"""Measures of firms from the rows of their workers.

A measure is an object with columns(rows) -> DataFrame: rows has j, y and w (a weight, 1 where
there are none); the result has j and one or more numbers for each firm. Any such object can be
given to cluster().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.numbering import running_sum
from pairloom.plans.scratch import materialise


def weighted_quantiles(rows: DataFrame, shares: list[float], value: str = "y") -> list[float]:
    """Quantiles of a weighted sample: the least value whose cumulative weight passes share * total; where it
    meets it exactly, the mean with the next value.

    Weights are summed for distinct values first. The cumulative sum goes by ranges of values, of
    which only the totals reach the driver.
    """
    sums = rows.groupBy(value).agg(F.sum("w").alias("w")).where("w > 0")
    summed = materialise(running_sum(sums, [value], "w", "_c"), "cumulative")
    total = summed.agg(F.max("_c")).first()[0] or 0.0
    near = 1e-9 * max(total, 1.0)
    asks = [F.struct(F.min(F.when(F.col("_c") >= s * total - near, F.col(value))), F.min(F.when(F.col("_c") > s * total + near, F.col(value)))) for s in shares]
    got = summed.agg(*asks).first()
    top = summed.agg(F.max(value)).first()[0]
    return [((a if a is not None else top) + (b if b is not None else a if a is not None else top)) / 2 for a, b in got]


@dataclass(frozen=True)
class CDFs:
    """A firm's distribution of y at a number of points.

    quantile_all: its share of weight at or below quantiles of all rows. quantile_firm: its own
    value where its cumulative share of weight first passes each point.
    """

    cdf_resolution: int = 10
    measure: str = "quantile_all"
    outcome_col: str = "y"

    def __post_init__(self) -> None:
        if self.measure not in ("quantile_all", "quantile_firm"):
            raise ValueError("measure must be 'quantile_all' or 'quantile_firm'")

    def columns(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("y", F.col(self.outcome_col))
        shares = [k / self.cdf_resolution for k in range(1, self.cdf_resolution + 1)]
        if self.measure == "quantile_all":
            cuts = weighted_quantiles(rows, shares)
            return rows.groupBy("j").agg(*((F.sum(F.when(F.col("y") <= q, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"cdf_{k}") for k, q in enumerate(cuts)))
        sums = rows.groupBy("j", "y").agg(F.sum("w").alias("w"))
        marked = running_sum(sums, ["y"], "w", "_c", ("j",)).join(sums.groupBy("j").agg(F.sum("w").alias("_all")), "j").withColumn("_s", F.col("_c") / F.col("_all"))
        return marked.groupBy("j").agg(*(F.coalesce(F.min(F.when(F.col("_s") > s, F.col("y"))), F.max("y")).alias(f"cdf_{k}") for k, s in enumerate(shares)))


@dataclass(frozen=True)
class Moments:
    """Weighted mean, weighted population variance, maximum or minimum of a firm's y."""

    measures: str | tuple[str, ...] | list[str] = "mean"
    outcome_col: str = "y"

    def columns(self, rows: DataFrame) -> DataFrame:
        listed = [self.measures] if isinstance(self.measures, str) else list(self.measures)
        y, w = F.col(self.outcome_col), F.col("w")
        if "var" in listed:  # two sums, the second about the means of the first; a large firm is summed in many tasks
            rows = rows.join(rows.groupBy("j").agg((F.sum(w * y) / F.sum(w)).alias("_mu")), "j")
        ways = {"mean": lambda: F.sum(w * y) / F.sum(w), "var": lambda: F.sum(w * F.pow(y - F.col("_mu"), 2)) / F.sum(w), "max": lambda: F.max(y), "min": lambda: F.min(y)}
        if unknown := set(listed) - ways.keys():
            raise ValueError(f"unknown measures: {sorted(unknown)}")
        return rows.groupBy("j").agg(*(ways[m]().alias(m) for m in listed))
