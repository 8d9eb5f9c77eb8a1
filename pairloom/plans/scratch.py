"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no shared folder, as in local tests.
LOCAL_SCRATCH = "/tmp/checkpoints/pairloom"
#: Spark's setting for removing a query's shuffle files as soon as it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return named or LOCAL_SCRATCH


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the driver ends."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Spark's own file system layer."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back, which cuts lineage and survives lost executors.

    Nothing reads the shuffles behind it again, so their files go when it is written, and not when
    the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    if path := getattr(df, "_scratch_path", None):
        delete(df.sparkSession, path)


@atexit.register
def _clean_up() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before us; then the cluster's own clean-up has the files
            return
