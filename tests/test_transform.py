"""aggregate_transform, running sums and quantiles against plain versions."""

import numpy as np
import pytest

from pairloom.functions.aggregates import TwoStage, group_values
from pairloom.operators.transform import aggregate_transform
from pairloom.plans.numbering import exact_quantiles, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", 1.0, 2.0), ("a", 3.0, 1.0), ("a", 3.0, 1.0), ("b", None, 1.0), ("b", 5.0, 2.0), (None, 7.0, 1.0), (None, 9.0, 3.0)]
    return spark.createDataFrame(data, "k string, x double, w double").repartition(3)


def test_aggregates(rows):
    def got(func, **options):
        return {r.k: r[-1] for r in aggregate_transform(rows, "k", "x", func, merge=False, **options).collect()}

    assert got("n_unique") == {"a": 2, "b": 1, None: 2}
    assert got("max") == {"a": 3, "b": 5, None: 9} and got("min")["a"] == 1
    assert got("sum") == {"a": 7, "b": 5, None: 16}
    assert got("sum", weights="w")["a"] == 8
    assert got("var", weights="w")["a"] == pytest.approx(np.average((np.array([1, 3, 3]) - 2) ** 2, weights=[2, 1, 1]))
    assert sorted(got("array")["a"]) == [1, 3, 3]
    assert got(lambda x: np.nanmax(x) - np.nanmin(x)) == {"a": 2, "b": 0, None: 2}
    with pytest.raises(ValueError):
        aggregate_transform(rows, "k", "x", "mode")


def test_merged(rows):
    out = aggregate_transform(rows, "k", "x", "max", name="w")
    assert out.columns == ["k", "x", "w", "wm"] and out.count() == rows.count()
    assert {(r.k, r.wm) for r in out.collect()} == {("a", 3.0), ("b", 5.0), (None, 9.0)}
    assert aggregate_transform(rows.limit(0), "k", "x", "var").count() == 0


def test_running_sums(spark):
    r = np.random.default_rng(0)
    data = [(int(k), float(v), 1.0) for k, v in zip(r.integers(0, 3, 500), r.permutation(500), strict=True)]
    df = spark.createDataFrame(data, "k int, x double, w double").repartition(5)
    got = sorted((x.k, x.x, x.s) for x in running_sum(df, ["x"], "w", "s", ("k",)).collect())
    want, seen = [], {}
    for k, x, _ in sorted(data):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, x, seen[k]))
    assert got == want
    assert sorted(x.s for x in running_sum(df, ["x"], "w", "s").collect()) == list(range(1, 501))


def test_quantiles(spark):
    values = [3.0, 1.0, 1.0, 1.0, 8.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert exact_quantiles(df, "x", shares) == pytest.approx(np.quantile([3, 1, 1, 1, 8], shares).tolist())
    assert exact_quantiles(df.limit(0), "x", shares) == [None] * 5


def two_stage_range():
    def wider(a, b):
        return b if a is None else a if b is None else (min(a[0], b[0]), max(a[1], b[1]))

    return TwoStage(lambda: None, lambda s, v: wider(s, (np.nanmin(v), np.nanmax(v))) if (~np.isnan(v)).any() else s, wider, lambda s: None if s is None else s[1] - s[0])


RANGE = two_stage_range()


def test_two_stages(rows):
    def got(func):
        return {r.k: r[-1] for r in aggregate_transform(rows, "k", "x", func, merge=False).collect()}

    assert got(RANGE) == got(lambda x: np.nanmax(x) - np.nanmin(x)) == {"a": 2, "b": 0, None: 2}
    assert aggregate_transform(rows.limit(0), "k", "x", RANGE).count() == 0
    nulls = rows.where("x is null")
    assert [r[-1] for r in aggregate_transform(nulls, "k", "x", RANGE, merge=False).collect()] == [None]
    two = {(r.k, r.w): r.v for r in group_values(rows, ["k", "w"], "x", RANGE, "v").collect()}
    assert two == {("a", 2.0): 0, ("a", 1.0): 0, ("b", 1.0): None, ("b", 2.0): 0, (None, 1.0): 0, (None, 3.0): 0}


@pytest.mark.parametrize("how", [None, RANGE])
def test_functions_where_rows_are_merged(panel, rows_of, how):
    how = how or (lambda y: y.max() - y.min())
    rows = [(0, 0, 1, 1), (0, 0, 5, 1), (0, 1, 3, 1), (0, 1, 2, 2), (1, 0, 4, 1), (1, 0, 4, 2)]
    got = panel(rows).drop_i_t_duplicates(how)
    assert rows_of(got, "i", "j", "y", "t") == [(0, 0, 4, 1), (0, 1, 0, 2), (1, 0, 0, 1), (1, 0, 0, 2)]
    from pyspark.sql import functions as F

    p = panel(rows).drop_i_t_duplicates().add_column("c", F.col("y") * 2, dtype="float", how_collapse=how).collapse()
    assert rows_of(p, "i", "j", "c") == [(0, 0, 0), (0, 1, 0), (1, 0, 0)]
    assert panel(rows).clean(i_t_how=how).df.count() == 4


def test_functions_of_columns(panel, rows_of):
    from pyspark.sql import functions as F

    got = panel([(0, 0, 1, 1), (0, 0, 5, 1)]).drop_i_t_duplicates(lambda c: F.max(c) - F.min(c))
    assert rows_of(got, "y") == [(4,)]
