"""Firm clusters: measures of firms, groups of similar firms, and the column g."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.groupings import KMeans
from pairloom.functions.measures import CDFs
from pairloom.operators.model import STANDARD
from pairloom.operators.params import CleanParams, ClusterParams
from pairloom.operators.rows import worker_m
from pairloom.plans.scratch import materialise

if TYPE_CHECKING:
    from pairloom.operators.panel import Panel


def prepared(panel: Panel, params: ClusterParams) -> DataFrame:
    """The rows that measures see, with weights in w."""
    long = panel.as_long()
    if params.t is not None and long.meta.layout.collapsed:
        raise NotImplementedError("periods can be chosen in long panels only")
    rows = long.df.withColumn("_mover", worker_m())
    if params.stayers_movers:
        rows = rows.where({"stayers": "not _mover", "movers": "_mover", "stays": "m = 0", "moves": "m > 0"}[params.stayers_movers])
    if params.t is not None:
        rows = rows.where(F.col("t").isin(*(params.t if isinstance(params.t, (list, tuple, set, range)) else [params.t])))
    weight = F.col("w").cast("double") if params.weighted and long.meta.has("w") else F.lit(1.0)
    return rows.withColumn("w", weight).drop("_mover")


def firm_measures(panel: Panel, params: ClusterParams) -> tuple[DataFrame, list[str]]:
    """One row for each firm: its measures (in the given names) and its weight w."""
    rows = prepared(panel, params)
    listed = params.measures if isinstance(params.measures, (list, tuple)) else [params.measures or CDFs()]
    firms, names = rows.groupBy("j").agg(F.sum("w").alias("w")), []
    for k, m in enumerate(listed):
        got = m.columns(rows)
        own = [c for c in got.columns if c != "j"]
        firms = firms.join(got.withColumnsRenamed({c: f"x{k}_{c}" for c in own}), "j")
        names += [f"x{k}_{c}" for c in own]
    return materialise(firms, "measures"), names


def cluster(panel: Panel, params: ClusterParams, seed: int = 0) -> Panel | tuple[Panel, DataFrame]:
    """Give every row its firm's group in g (null for firms no measure saw); with silhouette=True the firms' scores as well."""
    firms, names = firm_measures(panel, params)
    grouping = params.grouping or KMeans()
    groups = materialise(grouping.groups(firms, names, seed), "groups")
    meta = panel.meta.but(columns={**panel.meta.columns, "g": STANDARD["g"]})
    df = panel.df.drop(*(panel.meta.parts("g") if panel.meta.has("g") else []))
    for p, g in zip(panel.meta.parts("j"), meta.parts("g"), strict=True):
        df = df.join(groups.select(F.col("j").alias("_j"), F.col("g").alias(g)), F.col(p) == F.col("_j"), "left").drop("_j")
    out = panel.on(df, meta)
    if params.dropna:
        from pairloom.operators.clean import clean

        out = clean(out, params.clean_params or CleanParams())
    return (out, silhouettes(firms, names, groups)) if params.silhouette else out


#: Firms of a block; two blocks meet in a task.
BLOCK = 2048


def silhouettes(firms: DataFrame, names: list[str], groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Silhouette of each firm: (b - a) / max(a, b), a being its mean Euclidean distance to the others of its group and b the least mean distance to another group.

    Firms lie in blocks of bounded size. A task takes two blocks and adds up the distances from
    each firm of the one to the other's firms of each group; Spark adds up these sums, so there is
    no table of pairs. A firm alone in its group has 0; where there is one group only, or a
    measure is null, the silhouette is null.
    """
    own = materialise(firms.join(groups, "j").select(F.monotonically_increasing_id().alias("_row"), "j", F.col("g").cast("long").alias("g"), F.array(*(F.col(n).cast("double") for n in names)).alias("x")), "points")
    blocks = max(1, -(-own.count() // block))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
        return pa.table({"block": pa.array([key[0].as_py()]), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("rows", table.column("_row").to_numpy()), ("groups", table.column("g").to_numpy()), ("points", x))}})

    packed = materialise(own.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks))).groupBy("block").applyInArrow(pack, "block long, rows binary, groups binary, points binary"), "blocks")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row, x, g, y = (np.frombuffer(batch.column(k)[at].as_py(), t) for k, t in enumerate(("<i8", "<f8", "<i8", "<f8")))
                x, y = x.reshape(len(row), -1), y.reshape(len(g), -1)
                known, of = np.unique(g, return_inverse=True)
                member = np.eye(len(known))[of]
                for a in range(0, len(row), 256):
                    near = np.zeros((len(row[a : a + 256]), len(g)))
                    for c in range(x.shape[1]):
                        near += (x[a : a + 256, c, None] - y[:, c]) ** 2
                    total = np.sqrt(near) @ member
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row[a : a + 256], len(known))), pa.array(np.tile(known, len(total))), pa.array(total.ravel())], ["_row", "to", "total"])

    left = packed.select("block", F.col("rows"), F.col("points").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    right = packed.select(F.col("block").alias("other"), F.col("groups"), F.col("points").alias("y"))
    met = left.join(right, "other").repartition("block", "other").select("rows", "x", "groups", "y").mapInArrow(sums, "_row long, to long, total double")
    sizes = own.groupBy(F.col("g").alias("to")).agg(F.count("*").alias("n"))
    far = met.groupBy("_row", "to").agg(F.sum("total").alias("total")).join(sizes, "to").join(own.select("_row", "j", "g"), "_row")
    same = F.col("to") == F.col("g")
    means = far.groupBy("_row", "j", "g").agg(F.max(F.when(same, F.col("n"))).alias("_n"), F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("_a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("_b"))
    most = F.greatest("_a", "_b")
    score = F.when(F.col("_b").isNull() | F.isnan("_b"), None).when(F.col("_n") == 1, 0.0).when(F.isnan("_a"), None).when(most == 0, 0.0).otherwise((F.col("_b") - F.col("_a")) / most)
    return means.select("j", "g", score.alias("silhouette"))
