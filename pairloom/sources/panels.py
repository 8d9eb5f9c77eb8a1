"""Panels over the star-schema tables, and readers and writers of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.panel import Panel


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> Panel:
    """A panel from a file or folder that Spark reads; its layout follows from the columns."""
    return Panel.of(spark.read.format(fmt).load(path), **options)


def write_panel(panel: Panel, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    panel.df.write.format(fmt).mode(mode).save(path)


def lineitem_rows(spark: SparkSession, sf_dir: str, firm: str = "l_suppkey", where: str = "true", weight: bool = False) -> DataFrame:
    """Orders as workers, suppliers or parts as firms, line numbers as periods, prices as outcomes."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where)
    cols = [F.col("l_orderkey").cast("long").alias("i"), F.col(firm).cast("long").alias("j"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_linenumber").cast("long").alias("t")]
    return rows.select(*cols, *([F.col("l_quantity").cast("double").alias("w")] if weight else []))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as workers, the number in props as firm, days as periods, values as outcomes."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return rows.select(F.col("user_id").cast("long").alias("i"), F.get_json_object("props", "$.k").cast("long").alias("j"), F.col("value").cast("double").alias("y"), day.alias("t"))
