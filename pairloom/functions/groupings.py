"""Groupings of firms by their measures: objects with groups(firms, names, seed) -> DataFrame of j and g.

firms has j, w (the firm's weight) and the measures in names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans as MLKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.numbering import exact_quantiles


@dataclass(frozen=True)
class KMeans:
    """Weighted k-means by the library's distributed implementation."""

    n_clusters: int = 8
    max_iter: int = 100
    tol: float = 1e-4
    seed: int | None = None

    def groups(self, firms: DataFrame, names: list[str], seed: int = 0) -> DataFrame:
        points = VectorAssembler(inputCols=names, outputCol="_x").transform(firms)
        model = MLKMeans(k=self.n_clusters, featuresCol="_x", predictionCol="g", weightCol="w", maxIter=self.max_iter, tol=self.tol, seed=self.seed if self.seed is not None else seed).fit(points)
        return model.transform(points).select("j", F.col("g").cast("long").alias("g"))


@dataclass(frozen=True)
class Quantiles:
    """Groups between quantiles (linear interpolation, no weights) of one measure: the number of cuts below it."""

    n_quantiles: int = 4

    def groups(self, firms: DataFrame, names: list[str], seed: int = 0) -> DataFrame:
        if len(names) != 1:
            raise NotImplementedError("quantile groups are made of one measure")
        x = F.col(names[0])
        shares = [k / self.n_quantiles for k in range(1, self.n_quantiles)]
        cuts = [c for c in exact_quantiles(firms, names[0], shares) if c is not None]
        below = sum(((x > c).cast("long") for c in cuts), F.lit(0).cast("long"))
        return firms.select("j", below.alias("g"))
