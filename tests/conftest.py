import os
import sys

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def panel(spark):
    from pairloom.operators.panel import Panel

    def make(rows, columns="i j y t", **options):
        names = columns.split()
        typed = [tuple(float(x) if n[0] in "ywc" and not isinstance(x, str) else x for n, x in zip(names, row, strict=True)) for row in rows]
        return Panel.of(spark.createDataFrame(typed, names), **options)

    return make


@pytest.fixture
def rows_of():
    def get(panel, *columns):
        df = panel.df if hasattr(panel, "df") else panel
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())

    return get
