"""Small panels with known results."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions.groupings import Quantiles
from pairloom.functions.measures import Moments
from pairloom.operators.panel import Panel
from pairloom.operators.reshape import returns_exist

F1 = [(0, 0, 2, 1, 1), (0, 1, 1, 2, 2), (1, 1, 1, 1, 2), (1, 2, 1, 2, 1), (1, 2, 2, 3, 1), (1, 5, 1, 3, 3), (3, 2, 1, 1, 1), (3, 2, 1, 2, 1), (4, 0, 1, 1, 1)]
F3 = [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 2), (1, 2, 1.5, 2), (1, 3, 0.5, 2), (3, 2, 1, 1), (3, 1, 1.5, 1), (3, 2, 1, 2)]
F4 = [(0, 0, 2, 1, 1), (0, 1, 1, 2, 2), (1, 1, 1, 1, 2), (1, 2, 1, 2, 2), (1, 2, 1.5, 2, 2), (1, 3, 0.5, 2, 2), (3, 2, 1, 1, 2), (3, 1, 1.5, 1, 2)]
F6 = [(0, 0, 2, 1), (0, 1, 1, 2), (0, 0, 1, 4), (1, 1, 1, 1), (1, 2, 1, 2), (2, 2, 1, 1), (2, 1, 2, 2)]
F7 = [(0, 0, 2, 1), (0, 0, 3, 2), (0, 1, 1, 3), (0, 0, 1, 5), (0, 0, 1, 6), *F6[3:]]
F10 = [(0, 0, 2, 1), (0, 1, 1, 2), (0, 2, 0.5, 3), (0, 2, 0.5, 4), (0, 2, 0.75, 5), (0, 3, 1.5, 6), (1, 1, 1, 1), (1, 2, 1, 2), (2, 2, 1, 1), (2, 2, 1, 2)]
F12 = [(0, 0, 2, 1, 0), (0, 1, 1, 2, 1), (0, 1, 1, 3, 1), (0, 0, 1, 4, 0), (1, 1, 1, 1, 1), (1, 2, 1, 2, 2), (1, 2, 2, 3, 2), (1, 5, 1, 3, 5), (3, 2, 1, 1, 2), (3, 2, 1, 2, 2), (3, 3, 1.5, 3, 3), (4, 0, 1, 1, 0)]
F13 = [(0, 0, 2, 1, 1), (0, 1, 1, 2, 2), (0, 1, 1.5, 3, 3), (0, 0, 1, 4, 1), (1, 1, 1, 1, 1), (1, 2, 1, 2, 1.8), (1, 2, 2, 3, 2.5), (1, 5, 1, 3, 1), (3, 2, 1, 1, 1), (3, 2, 1.5, 2, 2), (3, 3, 1.5, 3, 1)]


def test_six_conversions(panel, rows_of):
    p = panel(F1, "i j y t g").clean()
    back = p.to_eventstudy().to_long()
    assert rows_of(back, "i", "j", "y", "t", "g") == rows_of(p, "i", "j", "y", "t", "g")
    last = back.collapse().to_eventstudy()
    assert rows_of(last.df.where("m = 0"), "i", "j1", "y1", "t11", "t12") == [(2, 2, 1, 1, 2), (3, 0, 1, 1, 1)]
    assert rows_of(last.df.where("m > 0"), "i", "j1", "j2", "y1", "y2", "t21", "t22") == [(0, 0, 1, 2, 1, 2, 2), (1, 1, 2, 1, 1.5, 2, 3)]


@pytest.mark.parametrize("how, y", [("max", 1.5), ("sum", 2.5), ("mean", 1.25)])
def test_one_row_for_a_worker_and_period(panel, rows_of, how, y):
    p = panel(F3).clean(i_t_how=how)
    assert (1, 2, y, 2) in rows_of(p, "i", "j", "y", "t")
    assert rows_of(p.df.where("i = 2"), "j", "t") == [(1, 1), (2, 2)]
    assert p.df.where("m = 0").count() == 0


def test_collapsed_duplicates(panel, rows_of):
    p = panel(F4, "i j y t1 t2").clean()
    assert rows_of(p, "i", "j", "y", "t1", "t2") == [(0, 0, 2, 1, 1), (0, 1, 1, 2, 2), (1, 1, 1, 1, 1), (1, 2, 1.5, 2, 2), (2, 1, 1.5, 1, 2)]


def test_string_ids_and_history(panel, rows_of):
    rows = [("a", "a", 2, 1), ("a", "b", 1, 2), ("b", "b", 1, 1), ("b", "c", 1, 2), ("b", "d", 0.5, 2), ("d", "c", 1, 1), ("d", "b", 1.5, 1), ("d", "c", 1, 2)]
    p = panel(rows, track_id_changes=True).clean()
    assert rows_of(p, "i", "j", "y", "t") == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 1.5, 1), (2, 2, 1, 2)]
    assert rows_of(p.original_ids(), "original_i", "original_j", "t") == [("a", "a", 1), ("a", "b", 2), ("b", "b", 1), ("b", "c", 2), ("d", "b", 1), ("d", "c", 2)]
    assert panel(rows).clean().original_ids() is None


def test_returns(panel, rows_of):
    p = panel(F6)
    assert returns_exist(p.gen_m())
    assert rows_of(p.clean(drop_returns="returns").df.where("i = 0"), "j", "m") == [(0, 0)]
    assert p.clean(drop_returns="returners").df.where("m > 0").count() == 4
    assert rows_of(panel(F7).clean(drop_returns="keep_first_returns").df.where("i = 0"), "t") == [(1,), (2,), (3,)]
    assert rows_of(panel(F7).clean(drop_returns="keep_last_returns").df.where("i = 0"), "t") == [(3,), (5,), (6,)]


def test_gaps(panel, rows_of):
    p = panel([(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 4), (3, 2, 1, 1), (3, 2, 1, 2)]).clean()
    got = p.fill_missing_periods()
    assert sorted(tuple(r) for r in got.where("j = -1").select("i", "j", "t", "y", "m").collect()) == [(1, -1, 2, None, None), (1, -1, 3, None, None)]
    assert rows_of(p.fill_missing_periods({"y": "prev", "j": "prev"}).where("i = 1 and t in (2, 3)"), "j", "y") == [(1, 1.0), (1, 1.0)]
    assert dict(p.fill_missing_periods({"y": "none"}).dtypes)["y"] == "string"


def test_uncollapse_and_back(panel, rows_of):
    p = panel(F4, "i j y t1 t2")
    assert p.gen_m().uncollapse().df.count() == 11
    long = panel(F10).clean()
    spells = long.collapse()
    assert spells.df.agg(F.sum("w")).first()[0] == long.df.count()
    assert rows_of(spells.uncollapse().collapse(), "i", "j", "t1", "t2") == rows_of(spells, "i", "j", "t1", "t2")


def test_event_study_with_stays(panel, rows_of):
    p = panel(F10).clean()
    es = p.to_eventstudy()
    assert rows_of(es.df.where("m = 0"), "i", "j1", "j2", "t1", "t2") == [(0, 2, 2, 3, 4), (0, 2, 2, 4, 5), (2, 2, 2, 1, 1), (2, 2, 2, 2, 2)]
    assert rows_of(es.df.where("m > 0"), "i", "j1", "j2") == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 1, 2)]
    assert rows_of(es.to_long(), "i", "j", "y", "t") == rows_of(p, "i", "j", "y", "t")


def test_cross_section(panel, rows_of):
    es = panel([(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 2), (3, 2, 1, 1), (3, 2, 2, 2)]).clean().to_eventstudy()
    assert rows_of(es.get_cs().where("m > 0"), "i", "j1", "j2", "y1", "y2", "cs") == [(0, 0, 1, 2, 1, 1), (0, 1, 0, 1, 2, 0), (1, 1, 2, 1, 1, 1), (1, 2, 1, 1, 1, 0)]
    assert rows_of(es.get_cs().where("m = 0"), "i", "cs") == [(2, 1), (2, 1)]


def test_extended_event_study(panel, rows_of):
    p = panel(F12, "i j y t g").clean()
    ees = p.to_extendedeventstudy(2, 1, transition_col="g", move_to_worker=False)
    assert rows_of(ees, "i", "j1", "j2", "j3", "y1", "y2", "y3", "t1", "t3") == [(0, 1, 1, 0, 1, 1, 1, 2, 4), (2, 2, 2, 3, 1, 1, 1.5, 1, 3)]
    stable = p.to_extendedeventstudy(2, 2, stable_post="j", move_to_worker=False)
    assert stable.df.where("j3 <> j4").count() == 0
    assert p.to_extendedeventstudy(2, 1).n_workers() == p.to_extendedeventstudy(2, 1).df.count()


def test_weighted_merges(panel, rows_of):
    p = panel(F13, "i j y t w").clean()
    assert rows_of(p.collapse(), "i", "j", "y", "t1", "t2", "w") == [(0, 0, 1, 4, 4, 1), (0, 0, 2, 1, 1, 1), (0, 1, 1.3, 2, 3, 5), (1, 1, 1, 1, 1, 1), (1, 2, round(6.8 / 4.3, 6), 2, 3, 4.3), (2, 2, round(4 / 3, 6), 1, 2, 3), (2, 3, 1.5, 3, 3, 1)]
    assert (0, 0, 1.5, 1, 4, 2) in rows_of(p.collapse("match"), "i", "j", "y", "t1", "t2", "w")
    var = p.add_column("v", F.col("y"), dtype="float", how_collapse="var").collapse().df
    assert rows_of(var.where("i = 0"), "j", "v") == [(0, 0), (0, 0), (1, 0.06)]


@pytest.mark.parametrize("how, value", [("first", 0), ("last", 1.5), ("mean", 0.75), (None, None)])
def test_custom_columns(panel, how, value):
    rows = [(0, 0, 2, 1, 0), (0, 0, 2, 2, 1.5), (0, 1, 1, 3, 2), (0, 0, 1, 4, 3), (1, 1, 1, 1, 3), (1, 2, 1, 2, 2), (2, 2, 1, 1, 2), (2, 1, 2, 2, 0)]
    got = panel(rows, "i j y t c", how_collapse={"c": how}).clean().collapse()
    assert ("c" in got.df.columns) == (how is not None)
    if how:
        assert got.df.where("i = 0 and t1 = 1").first().c == value


def test_quantile_groups(panel, rows_of):
    rows = [(*r[:3], 4, 3) if r[1] == 5 else r for r in F1]
    p = panel(rows, "i j y t g").drop("g", allow_optional=True).clean().cluster(measures=Moments("mean"), grouping=Quantiles(3))
    assert sorted(set(rows_of(p, "j", "g"))) == [(0, 2), (1, 0), (2, 1), (3, 0)]


def test_names_and_errors(panel, spark):
    p = panel(F1, "i j y t g")
    with pytest.raises(ValueError):
        p.add_column("c1", F.lit(1))
    with pytest.raises(ValueError):
        Panel.of(spark.createDataFrame([(1, 1, 1.0, 1)], ["i", "j", "y", "t1"]))
    with pytest.raises(ValueError):
        Panel.of(spark.createDataFrame([(1, 1, 1, 1.0)], ["i", "j", "j1", "y"]))
    with pytest.raises(NotImplementedError):
        p.clean().to_eventstudy().collapse()
    with pytest.warns(UserWarning):
        assert p.drop("y").meta.has("y")
    c = p.add_column("c", F.lit(1.0), dtype="float")
    assert c.rename({"c": "d"}).clean().to_eventstudy().meta.parts("d") == ["d1", "d2"]
    assert c.get_column_properties("c")["how_collapse"] == "first"


def test_permuted_event_study_has_all_pairs(panel):
    spells = panel(F10).clean().collapse()
    for order in ("sequential", "income"):
        got = spells.to_permutedeventstudy(order)
        assert got.df.where("m > 0").count() == 4 * 3 // 2 + 1
        assert got.df.where("m = 0").count() == 1


def test_empty_panel(panel):
    p = panel(F1, "i j y t g")
    none = p.on(p.df.limit(0))
    assert none.clean().df.count() == 0
    assert none.clean().collapse().to_eventstudy().df.count() == 0
