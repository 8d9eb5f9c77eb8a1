"""Every panel query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from pairloom.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if a[c].dtype == object:
            assert a[c].tolist() == b[c].tolist(), c
        else:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=2e-4, err_msg=c)
