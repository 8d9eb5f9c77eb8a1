"""Numbers 0, 1, 2, ..., running sums and quantiles over a whole table in a stated order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.plans.scratch import materialise


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the column name: each row's place in the order.

    Rows are dealt into ranges of the order and numbered inside them; only the ranges' sizes, one
    number for each partition, reach the driver. The dealt table is written first, so that a task
    that runs again finds the same ranges. The order should be total.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = sorted(tuple(r) for r in dealt.groupBy("_part").count().collect())
    starts = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    if not starts:
        return dealt.select(*df.columns, F.lit(0).cast("long").alias(name))
    known = df.sparkSession.createDataFrame(list(starts.items()), "_part int, _start long")
    return dealt.withColumn("_place", place).join(F.broadcast(known), "_part").select(*df.columns, (F.col("_start") + F.col("_place")).cast("long").alias(name))


def running_sum(df: DataFrame, order: list[str], value: str, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Add the column name: the sum of value over the rows up to this one in the order, inside each group of within.

    Rows are dealt into ranges of the order and summed inside them; a group that spans several
    ranges gets the totals of those before, so no task holds more than a range. The order should
    be total inside a group. Without groups one number for each partition reaches the driver.
    """
    dealt = materialise(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), "running")
    totals = dealt.groupBy("_part", *within).agg(F.sum(value).alias("_sum"))
    if within:
        earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("_part", *within, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    else:
        known = sorted(tuple(r) for r in totals.collect())
        starts = list(zip((p for p, _ in known), accumulate((float(n) for _, n in known), initial=0.0), strict=False))
        offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _before double"))
    upto = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("_upto", F.sum(value).over(upto)).join(offsets, ["_part", *within]).select(*df.columns, (F.col("_before") + F.col("_upto")).alias(name))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles of the column's values by linear interpolation; null and NaN have no place. None for each share of an empty column.

    Equal values are counted in the tasks first, so a value that many rows share is one row of the
    running sum.
    """
    x = F.col(column).cast("double")
    counts = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy("_x").agg(F.count("*").alias("_k"))
    summed = materialise(running_sum(counts, ["_x"], "_k", "_upto"), "quantiles")
    total = summed.agg(F.max("_upto")).first()[0]
    if not total or not shares:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    ends = sorted({float(f) for p in places for f in (int(p), min(int(p) + 1, int(total) - 1))})
    got = summed.agg(*(F.min(F.when(F.col("_upto") > e, F.col("_x"))) for e in ends)).first()
    at = dict(zip(ends, got, strict=True))
    return [at[float(int(p))] + (p - int(p)) * (at[min(float(int(p) + 1), total - 1.0)] - at[float(int(p))]) for p in places]
