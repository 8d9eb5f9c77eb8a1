"""Registered queries: each operator over whole tables, with the SQL that should give the same rows.

Panels: A has orders as workers, suppliers as firms, line numbers as periods and prices as
outcomes (with quantities as weights in AW). D has users as workers, the number in an event's
props as firm and days as periods. E is D with firms kept apart for every ten users, which gives
many components. S is E with a firm for every ten days, which leaves few links. All of them are cleaned of repeated worker-periods first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.aggregates import TwoStage
from pairloom.functions.groupings import KMeans, Quantiles
from pairloom.functions.measures import CDFs, Moments
from pairloom.leave_out_sql import leave_out_firm_sql, leave_out_sql
from pairloom.operators import connect
from pairloom.operators.cluster import firm_measures
from pairloom.operators.panel import Panel
from pairloom.operators.params import ClusterParams, SimParams
from pairloom.operators.report import compare
from pairloom.operators.rows import returns_flag
from pairloom.operators.transform import aggregate_transform
from pairloom.sources.panels import event_rows, lineitem_rows
from pairloom.sources.simulate import simulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 4


def query(name: str, sql: str | None = None):
    def add(make: Callable[[SparkSession, str], Panel | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = make(spark, sf_dir)
            return rounded(got.df if isinstance(got, Panel) else got)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes))


# The same panels in both languages


def raw_a(spark: SparkSession, d: str) -> Panel:
    return Panel.of(lineitem_rows(spark, d))


def panel_a(spark: SparkSession, d: str) -> Panel:
    return raw_a(spark, d).drop_i_t_duplicates()


def panel_aw(spark: SparkSession, d: str) -> Panel:
    return Panel.of(lineitem_rows(spark, d, weight=True)).drop_i_t_duplicates()


def panel_d(spark: SparkSession, d: str) -> Panel:
    return Panel.of(event_rows(spark, d)).drop_i_t_duplicates()


def panel_e(spark: SparkSession, d: str) -> Panel:
    rows = event_rows(spark, d).withColumn("j", F.floor(F.col("i") / 10) * 1000 + F.col("j"))
    return Panel.of(rows).drop_i_t_duplicates()


def panel_s(spark: SparkSession, d: str) -> Panel:
    rows = event_rows(spark, d).withColumn("j", F.floor(F.col("i") / 10) * 10000 + F.col("j") * 10 + F.floor(F.col("t") / 10))
    return Panel.of(rows).drop_i_t_duplicates()


RAW = {
    "A": "SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_linenumber AS BIGINT) AS t FROM lineitem",
    "AW": "SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_linenumber AS BIGINT) AS t, CAST(l_quantity AS DOUBLE) AS w FROM lineitem",
    "D": "SELECT CAST(user_id AS BIGINT) AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS j, CAST(value AS DOUBLE) AS y, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t FROM events",
    "E": "SELECT CAST(user_id AS BIGINT) AS i, (user_id // 10) * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS j, CAST(value AS DOUBLE) AS y, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t FROM events",
    "S": "SELECT CAST(user_id AS BIGINT) AS i, (user_id // 10) * 10000 + CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS j, CAST(value AS DOUBLE) AS y, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t FROM events",
}
O = "(PARTITION BY i ORDER BY t, j)"
MOVES = f"COALESCE(CAST(LAG(j) OVER {O} <> j AS BIGINT), 0) + COALESCE(CAST(LEAD(j) OVER {O} <> j AS BIGINT), 0)"


def base(raw: str = "A", spells: bool = False) -> str:
    """CTEs raw, p (one row for a worker and period, with m), and if asked s (with spell)."""
    extra = ", w" if raw == "AW" else ""
    out = f"WITH RECURSIVE raw AS ({RAW[raw]}), d AS (SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, t ORDER BY y DESC, j{extra}) AS r FROM raw) WHERE r = 1), p AS (SELECT *, {MOVES} AS m FROM d)"
    if spells:
        out += f", n AS (SELECT *, CASE WHEN LAG(j) OVER {O} = j THEN 0 ELSE 1 END AS new FROM p), s AS (SELECT * EXCLUDE (new), SUM(new) OVER (PARTITION BY i ORDER BY t, j ROWS UNBOUNDED PRECEDING) AS spell FROM n)"
    return out


def r(*names: str) -> str:
    return ", ".join(f"ROUND({n}, {DIGITS}) AS {n}" for n in names)


query("gen_m", base() + f" SELECT i, j, {r('y')}, t, m FROM p")(panel_a)


@query("worker_m", base() + f" SELECT i, t, CAST(MAX(m) OVER (PARTITION BY i) > 0 AS BIGINT) AS mover FROM p")
def _(spark, d):
    p = panel_a(spark, d)
    return p.df.select("i", "t", p.get_worker_m().cast("long").alias("mover"))


@query("summary", base() + " SELECT ROUND(AVG(y), 4) AS mean_y, ROUND(MEDIAN(y), 4) AS median_y, ROUND(MIN(y), 4) AS min_y, ROUND(MAX(y), 4) AS max_y, COUNT(*) AS n_rows, COUNT(DISTINCT i) AS n_workers, COUNT(DISTINCT j) AS n_firms FROM p")
def _(spark, d):
    return panel_a(spark, d).summary().select("mean_y", "median_y", "min_y", "max_y", "n_rows", "n_workers", "n_firms")


@query("unique_ids", base() + " SELECT DISTINCT j FROM p")
def _(spark, d):
    return panel_a(spark, d).to_eventstudy().unique_ids("j")


@query("drop_na", f"WITH raw AS ({RAW['A']}) SELECT i, j, {r('y')}, t FROM raw WHERE y >= 2000")
def _(spark, d):
    rows = lineitem_rows(spark, d).withColumn("y", F.when(F.col("y") >= 2000, F.col("y")))
    return Panel.of(rows).drop_na()


for how, sql in (("max", "MAX"), ("sum", "SUM"), ("mean", "AVG"), ("min", "MIN")):
    y = "y" if how == "max" else f"{sql}(y) OVER (PARTITION BY i, t, j)"
    text = f"WITH raw AS ({RAW['A']}), v AS (SELECT i, j, t, {y} AS y FROM raw), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, t ORDER BY y DESC, j) AS r FROM v), d AS (SELECT i, j, t, y FROM k WHERE r = 1) SELECT i, j, {r('y')}, t, {MOVES} AS m FROM d"
    query(f"it_dedup_{how}", text)(lambda spark, d, how=how: raw_a(spark, d).drop_i_t_duplicates(how))


#: Root mean square in two stages: sums and numbers of squares.
RMS = TwoStage(lambda: (0.0, 0), lambda s, v: (s[0] + float((v * v).sum()), s[1] + len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: (s[0] / s[1]) ** 0.5)
for how, sql, function in (("values", "MEDIAN(y)", np.median), ("two_stage", "SQRT(AVG(y * y))", RMS)):
    text = f"WITH raw AS ({RAW['D']}), v AS (SELECT i, j, t, {sql} AS y FROM raw GROUP BY i, j, t), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, t ORDER BY y DESC, j) AS r FROM v), d AS (SELECT i, j, t, y FROM k WHERE r = 1) SELECT i, j, {r('y')}, t, {MOVES} AS m FROM d"
    query(f"it_dedup_{how}", text)(lambda spark, d, function=function: Panel.of(event_rows(spark, d)).drop_i_t_duplicates(function))


@query("drop_duplicates_without_t", f"WITH raw AS ({RAW['A']}) SELECT DISTINCT i, j, {r('y')} FROM raw")
def _(spark, d):
    return Panel.of(lineitem_rows(spark, d).drop("t")).drop_i_t_duplicates().df.select("i", "j", "y")


@query("returns_detect", base(spells=True) + " SELECT i, j, COUNT(DISTINCT spell) AS spells FROM s GROUP BY i, j HAVING COUNT(DISTINCT spell) > 1")
def _(spark, d):
    return returns_flag(panel_a(spark, d)).where("_returns").groupBy("i", "j").agg(F.count_distinct("_spell").alias("spells"))


BACK = ", b AS (SELECT *, MIN(spell) OVER (PARTITION BY i, j) AS lo, MAX(spell) OVER (PARTITION BY i, j) AS hi FROM s), f AS (SELECT *, MAX(CAST(lo < hi AS INT)) OVER (PARTITION BY i) AS any_back FROM b)"
for how, test in (("returns", "lo = hi"), ("returners", "any_back = 0"), ("keep_first_returns", "spell = lo"), ("keep_last_returns", "spell = hi")):
    text = base("D", spells=True) + BACK + f", k AS (SELECT i, j, y, t FROM f WHERE {test}) SELECT i, j, {r('y')}, t, {MOVES} AS m FROM k"
    query(f"drop_returns_{how}", text)(lambda spark, d, how=how: panel_d(spark, d).drop_returns(how))

DENSE = ", jj AS (SELECT j, ROW_NUMBER() OVER (ORDER BY MIN(place), j) - 1 AS new_j FROM (SELECT j, ROW_NUMBER() OVER (ORDER BY i, t, j) AS place FROM p) GROUP BY j), ii AS (SELECT i, ROW_NUMBER() OVER (ORDER BY i) - 1 AS new_i FROM p GROUP BY i)"


@query("contiguous_ids", base("E") + DENSE + f" SELECT i, new_j AS j, {r('y')}, t, m FROM p JOIN jj USING (j)")
def _(spark, d):
    return panel_e(spark, d).make_dense("j")


@query("original_ids", base("E") + DENSE + " SELECT new_i AS i, new_j AS j, t, j AS original_j FROM p JOIN jj USING (j) JOIN ii USING (i)")
def _(spark, d):
    p = panel_e(spark, d)
    p = p.on(p.df, p.meta.but(history={})).make_dense("j").make_dense("i")
    return p.original_ids().select("i", "j", "t", "original_j")


@query("clean_default", base("E") + DENSE + f" SELECT new_i AS i, new_j AS j, {r('y')}, t, m FROM p JOIN jj USING (j) JOIN ii USING (i)")
def _(spark, d):
    rows = event_rows(spark, d).withColumn("j", F.floor(F.col("i") / 10) * 1000 + F.col("j"))
    return Panel.of(rows).clean()


SPELLS = "SELECT i, j, spell, MIN(t) AS t1, MAX(t) AS t2, {cols} FROM s GROUP BY i, j, spell"
O1 = "(PARTITION BY i ORDER BY t1, t2, j)"
MOVES1 = f"COALESCE(CAST(LAG(j) OVER {O1} <> j AS BIGINT), 0) + COALESCE(CAST(LEAD(j) OVER {O1} <> j AS BIGINT), 0)"


def collapsed(cols: str, out: str, raw: str = "A", level: str = "i, j, spell") -> str:
    return base(raw, spells=True) + f", c AS (SELECT i, j, MIN(t) AS t1, MAX(t) AS t2, {cols} FROM s GROUP BY {level}) SELECT i, j, t1, t2, {out}, {MOVES1} AS m FROM c"


query("collapse_spell", collapsed("AVG(y) AS y, CAST(COUNT(*) AS DOUBLE) AS w", r("y", "w"), "D"))(lambda spark, d: panel_d(spark, d).collapse())
query("collapse_match", collapsed("AVG(y) AS y, CAST(COUNT(*) AS DOUBLE) AS w", r("y", "w"), "D", "i, j"))(lambda spark, d: panel_d(spark, d).collapse("match"))
query("collapse_weighted_mean", collapsed("SUM(w * y) / SUM(w) AS y, SUM(w) AS w", r("y", "w"), "AW"))(lambda spark, d: panel_aw(spark, d).collapse())

CUSTOM = {
    "first": ("ARG_MIN(c, t)", False),
    "last": ("ARG_MAX(c, t)", False),
    "sum": ("SUM(c)", False),
    "max": ("MAX(c)", False),
    "min": ("MIN(c)", False),
    "mean": ("AVG(c)", False),
    "var": ("VAR_SAMP(c)", False),
    "std": ("STDDEV_SAMP(c)", False),
    "weighted_var": ("SUM(w * (c - mu) * (c - mu)) / SUM(w)", True),
    "weighted_std": ("SQRT(SUM(w * (c - mu) * (c - mu)) / SUM(w))", True),
}


def _custom(how: str, weighted: bool):
    def run(spark, d):
        p = (panel_aw if weighted else panel_d)(spark, d)
        p = p.add_column("c", F.col("y") / 7.3, dtype="float", how_collapse=how.removeprefix("weighted_"))
        return p.collapse("match").df.select("i", "j", "t1", "t2", "c")

    return run


for how, (sql, weighted) in CUSTOM.items():
    mu = ", SUM(w * y / 7.3) OVER (PARTITION BY i, j) / SUM(w) OVER (PARTITION BY i, j) AS mu" if weighted else ""
    text = base("AW" if weighted else "D") + f", c AS (SELECT *, y / 7.3 AS c{mu} FROM p) SELECT i, j, MIN(t) AS t1, MAX(t) AS t2, ROUND({sql}, {DIGITS}) AS c FROM c GROUP BY i, j"
    query(f"collapse_custom_{how}", text)(_custom(how, weighted))

for how, sql, function in (("values", "MEDIAN(c)", np.median), ("two_stage", "SQRT(AVG(c * c))", RMS)):
    text = base("D") + f", c AS (SELECT *, y / 7.3 AS c FROM p) SELECT i, j, MIN(t) AS t1, MAX(t) AS t2, ROUND({sql}, {DIGITS}) AS c FROM c GROUP BY i, j"
    query(f"collapse_custom_{how}", text)(lambda spark, d, function=function: panel_d(spark, d).add_column("c", F.col("y") / 7.3, dtype="float", how_collapse=function).collapse("match").df.select("i", "j", "t1", "t2", "c"))

SPELL_CTE = ", c AS (SELECT i, j, MIN(t) AS t1, MAX(t) AS t2, AVG(y) AS y, CAST(COUNT(*) AS DOUBLE) AS w FROM s GROUP BY i, j, spell)"
AGAIN = ", x AS (SELECT *, CASE WHEN LAG(j) OVER {o} = j THEN 0 ELSE 1 END AS new FROM {of}), z AS (SELECT *, SUM(new) OVER (PARTITION BY i ORDER BY t1, t2, j ROWS UNBOUNDED PRECEDING) AS sp FROM x), c2 AS (SELECT i, j, MIN(t1) AS t1, MAX(t2) AS t2, SUM(w * y) / SUM(w) AS y, SUM(w) AS w FROM z GROUP BY i, j, sp)"


@query("recollapse", base("D", spells=True) + SPELL_CTE + ", k AS (SELECT * FROM c WHERE j % 10 <> 3)" + AGAIN.format(o=O1, of="k") + f" SELECT i, j, t1, t2, {r('y', 'w')}, {MOVES1} AS m FROM c2")
def _(spark, d):
    p = panel_d(spark, d).collapse()
    return p.drop_ids("j", p.df.where("j % 10 = 3").select("j"))


def lone(n: int) -> str:
    """n rounds of dropping spells that have become neighbours of one of the same firm; more than the tables need."""
    out = base("D", spells=True) + SPELL_CTE + ", k0 AS (SELECT * FROM c WHERE j % 10 <> 3)"
    for k in range(n):
        out += f", x{k} AS (SELECT *, CASE WHEN LAG(j) OVER {O1} = j THEN 0 ELSE 1 END AS new FROM k{k}), z{k} AS (SELECT * EXCLUDE (new), SUM(new) OVER (PARTITION BY i ORDER BY t1, t2, j ROWS UNBOUNDED PRECEDING) AS sp FROM x{k}), k{k + 1} AS (SELECT * EXCLUDE (sp, n) FROM (SELECT *, COUNT(*) OVER (PARTITION BY i, sp) AS n FROM z{k}) WHERE n = 1)"
    return out + f" SELECT i, j, t1, t2, {r('y', 'w')}, {MOVES1} AS m FROM k{n}"


@query("recollapse_drop", lone(5))
def _(spark, d):
    p = panel_d(spark, d).collapse()
    return p.drop_ids("j", p.df.where("j % 10 = 3").select("j"), True)


@query("uncollapse", base("D", spells=True) + SPELL_CTE + f", u AS (SELECT i, j, y, w / (t2 - t1 + 1) AS w, UNNEST(generate_series(t1, t2)) AS t FROM c) SELECT i, j, {r('y', 'w')}, t, {MOVES} AS m FROM u")
def _(spark, d):
    return panel_d(spark, d).collapse().uncollapse()


@query("fill_missing", base("D") + f", l AS (SELECT *, LEAD(t) OVER {O} AS nt FROM p), g AS (SELECT i, CAST(-1 AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS y, UNNEST(generate_series(t + 1, nt - 1)) AS t, CAST(NULL AS BIGINT) AS m FROM l WHERE nt > t + 1) SELECT i, j, {r('y')}, t, m FROM p UNION ALL SELECT * FROM g")
def _(spark, d):
    return panel_d(spark, d).fill_missing_periods()


ES = f", v AS (SELECT *, MAX(m) OVER (PARTITION BY i) > 0 AS mover, LAG(j) OVER {O} AS lj, LAG(y) OVER {O} AS ly, LAG(t) OVER {O} AS lt FROM p), es AS (SELECT i, CASE WHEN mover THEN lj ELSE j END AS j1, j AS j2, CASE WHEN mover THEN ly ELSE y END AS y1, y AS y2, CASE WHEN mover THEN lt ELSE t END AS t1, t AS t2 FROM v WHERE NOT mover OR lt IS NOT NULL), e AS (SELECT *, CAST(j1 <> j2 AS BIGINT) AS m FROM es)"
query("to_eventstudy", base() + ES + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m FROM e")(lambda spark, d: panel_a(spark, d).to_eventstudy())
query("eventstudy_to_long", base() + f" SELECT i, j, {r('y')}, t, m FROM p")(lambda spark, d: panel_a(spark, d).to_eventstudy().to_long())
query("get_cs", base() + ES + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m, CAST(1 AS BIGINT) AS cs FROM e UNION ALL SELECT i, j2, j1, ROUND(y2, {DIGITS}), ROUND(y1, {DIGITS}), t2, t1, m, CAST(0 AS BIGINT) FROM e WHERE m > 0")(lambda spark, d: panel_a(spark, d).to_eventstudy().get_cs())
ESC = f", pm AS (SELECT *, {MOVES1} AS m FROM c), v AS (SELECT *, MAX(m) OVER (PARTITION BY i) > 0 AS mover, LAG(j) OVER {O1} AS lj, LAG(y) OVER {O1} AS ly, LAG(t1) OVER {O1} AS la, LAG(t2) OVER {O1} AS lb, LAG(w) OVER {O1} AS lw FROM pm), e AS (SELECT i, CASE WHEN mover THEN lj ELSE j END AS j1, j AS j2, CASE WHEN mover THEN ly ELSE y END AS y1, y AS y2, CASE WHEN mover THEN la ELSE t1 END AS t11, CASE WHEN mover THEN lb ELSE t2 END AS t12, t1 AS t21, t2 AS t22, CASE WHEN mover THEN lw ELSE w END AS w1, w AS w2 FROM v WHERE NOT mover OR la IS NOT NULL)"
query("to_eventstudy_collapsed", base("D", spells=True) + SPELL_CTE + ESC + f" SELECT i, j1, j2, {r('y1', 'y2')}, t11, t12, t21, t22, {r('w1', 'w2')}, CAST(j1 <> j2 AS BIGINT) AS m FROM e")(lambda spark, d: panel_d(spark, d).collapse().to_eventstudy())


def ees(n: int) -> str:
    cols = ", ".join(f"LEAD({c}, {k}) OVER {O} AS {c}{k + 1}" for c in "jyt" for k in range(n))
    other = " OR ".join(f"j{k} <> j1" for k in range(2, n + 1))
    return f", v AS (SELECT i, {cols} FROM p), e AS (SELECT *, CAST({other} AS BIGINT) AS m FROM v WHERE j{n} IS NOT NULL)"


def ees_out(n: int) -> str:
    return "i, " + ", ".join(f"j{k}" for k in range(1, n + 1)) + ", " + r(*(f"y{k}" for k in range(1, n + 1))) + ", " + ", ".join(f"t{k}" for k in range(1, n + 1)) + ", m"


query("to_extendedeventstudy", base() + ees(4) + f" SELECT {ees_out(4)} FROM e")(lambda spark, d: panel_a(spark, d).to_extendedeventstudy(move_to_worker=False))
query("ees_transition", base() + ees(3) + f" SELECT {ees_out(3)} FROM e WHERE j2 <> j3")(lambda spark, d: panel_a(spark, d).to_extendedeventstudy(2, 1, transition_col="j", move_to_worker=False))
query("ees_stable", base("D") + ees(3) + f" SELECT {ees_out(3)} FROM e WHERE j1 = j2")(lambda spark, d: panel_d(spark, d).to_extendedeventstudy(2, 1, stable_pre="j", move_to_worker=False))
LONG_AGAIN = ", a AS (" + " UNION ".join(f"SELECT i, j{k} AS j, y{k} AS y, t{k} AS t FROM e" for k in (1, 2, 3)) + ")"
query("ees_to_long", base() + ees(3) + LONG_AGAIN + f" SELECT i, j, {r('y')}, t, {MOVES} AS m FROM a")(lambda spark, d: panel_a(spark, d).to_extendedeventstudy(2, 1, move_to_worker=False).to_long())


@query("ees_by_row", base() + ees(4) + " SELECT ROW_NUMBER() OVER (ORDER BY i, t1, j1) - 1 AS i, j1, j4, t1, t4 FROM e")
def _(spark, d):
    return panel_a(spark, d).to_extendedeventstudy().df.select("i", "j1", "j4", "t1", "t4")


MATCHES = ", c AS (SELECT i, j, MIN(t) AS t1, MAX(t) AS t2, AVG(y) AS y FROM p GROUP BY i, j), cm AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY t1, t2, j) AS k, COUNT(*) OVER (PARTITION BY i) AS n FROM c)"


@query("permuted_sequential", base() + MATCHES + f" SELECT a.i, a.j AS j1, b.j AS j2, ROUND(a.y, {DIGITS}) AS y1, ROUND(b.y, {DIGITS}) AS y2, CAST(a.j <> b.j AS BIGINT) AS m FROM cm a JOIN cm b ON a.i = b.i AND (a.k < b.k OR (a.n = 1 AND a.k = b.k))")
def _(spark, d):
    return panel_a(spark, d).collapse("match").to_permutedeventstudy().df.select("i", "j1", "j2", "y1", "y2", "m")


INCOME = MATCHES.replace("AVG(y) AS y", "AVG(y) AS y, CAST(COUNT(*) AS DOUBLE) AS w") + f""", inc AS (SELECT *, SUM(w * y) OVER (PARTITION BY i) / SUM(w) OVER (PARTITION BY i) AS income FROM cm),
pr AS (SELECT a.i, a.income, LEAST(a.j, b.j) AS lo, GREATEST(a.j, b.j) AS hi, CASE WHEN a.j < b.j THEN a.y ELSE b.y END AS ylo, CASE WHEN a.j < b.j THEN b.y ELSE a.y END AS yhi FROM inc a JOIN inc b ON a.i = b.i AND a.k < b.k),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lo, hi ORDER BY income, i) AS rk, COUNT(*) OVER (PARTITION BY lo, hi) AS n FROM pr),
h AS (SELECT *, rk <= n // 2 + CASE WHEN n % 2 = 1 AND substr(md5(lo || '|' || hi || '|0'), 1, 1) < '8' THEN 1 ELSE 0 END AS turned FROM rk)
SELECT i, CASE WHEN turned THEN hi ELSE lo END AS j1, CASE WHEN turned THEN lo ELSE hi END AS j2, ROUND(CASE WHEN turned THEN yhi ELSE ylo END, {DIGITS}) AS y1, ROUND(CASE WHEN turned THEN ylo ELSE yhi END, {DIGITS}) AS y2, CAST(1 AS BIGINT) AS m FROM h
UNION ALL SELECT i, j, j, ROUND(y, {DIGITS}), ROUND(y, {DIGITS}), CAST(0 AS BIGINT) FROM cm WHERE n = 1"""


@query("permuted_income", base() + INCOME)
def _(spark, d):
    return panel_a(spark, d).collapse("match").to_permutedeventstudy("income").df.select("i", "j1", "j2", "y1", "y2", "m")


AGAIN_M = f"SELECT i, j, {r('y')}, t, {MOVES} AS m FROM k"
query("keep_ids", base() + f", k AS (SELECT i, j, y, t FROM p WHERE j % 3 = 1) {AGAIN_M}")(lambda spark, d: (p := panel_a(spark, d)).keep_ids("j", p.df.where("j % 3 = 1").select("j")))
query("drop_ids", base() + f", k AS (SELECT i, j, y, t FROM p WHERE j % 3 <> 1) {AGAIN_M}")(lambda spark, d: (p := panel_a(spark, d)).drop_ids("j", p.df.where("j % 3 = 1").select("j")))
PLACES = ", o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY i, t, j) - 1 AS place FROM p)"
query("keep_rows", base() + PLACES + f", k AS (SELECT i, j, y, t FROM o WHERE place IN (0, 2, 3, 50, 51, 57, 100)) {AGAIN_M}")(lambda spark, d: panel_a(spark, d).keep_rows([0, 2, 3, 50, 51, 57, 100]))
query("drop_rows", base() + PLACES + f", k AS (SELECT i, j, y, t FROM o WHERE place NOT IN (0, 2, 3, 50, 51, 57, 100)) {AGAIN_M}")(lambda spark, d: panel_a(spark, d).drop_rows([0, 2, 3, 50, 51, 57, 100]))
query("min_obs_ids", base() + " SELECT j FROM p GROUP BY j HAVING COUNT(*) >= 450")(lambda spark, d: panel_a(spark, d).min_obs_ids(450))
query("min_obs_frame", base() + f", k AS (SELECT i, j, y, t FROM p WHERE j IN (SELECT j FROM p GROUP BY j HAVING COUNT(*) >= 450)) {AGAIN_M}")(lambda spark, d: panel_a(spark, d).min_obs_frame(450))
query("min_obs_frame_eventstudy", base() + ", k AS (SELECT i, j, y, t FROM p WHERE j IN (SELECT j FROM p GROUP BY j HAVING COUNT(*) >= 450)), p2 AS (SELECT *, " + MOVES + " AS m FROM k)" + ES.replace("FROM p)", "FROM p2)") + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m FROM e")(lambda spark, d: panel_a(spark, d).to_eventstudy().min_obs_frame(450))
query("min_workers_firms", base() + " SELECT j FROM p GROUP BY j HAVING COUNT(DISTINCT i) >= 450")(lambda spark, d: panel_a(spark, d).min_workers_firms(450))
query("min_workers_frame", base() + f", k AS (SELECT i, j, y, t FROM p WHERE j IN (SELECT j FROM p GROUP BY j HAVING COUNT(DISTINCT i) >= 450)) {AGAIN_M}")(lambda spark, d: panel_a(spark, d).min_workers_frame(450))
query("min_moves_firms", base() + " SELECT j FROM p WHERE m > 0 GROUP BY j HAVING COUNT(*) >= 430")(lambda spark, d: panel_a(spark, d).min_moves_firms(430))
query("min_movers_firms", base() + " SELECT j FROM p WHERE m > 0 GROUP BY j HAVING COUNT(DISTINCT i) >= 430")(lambda spark, d: panel_a(spark, d).min_movers_firms(430))


def rounds(count: str, threshold: int, n: int, raw: str = "E") -> str:
    """n rounds of dropping firms with too few moves; more rounds than the tables need."""
    out = base(raw)
    last = "p"
    for k in range(n):
        out += f", k{k} AS (SELECT i, j, y, t FROM {last} WHERE j IN (SELECT j FROM {last} WHERE m > 0 GROUP BY j HAVING {count} >= {threshold})), q{k} AS (SELECT *, {MOVES} AS m FROM k{k})"
        last = f"q{k}"
    return out + f" SELECT i, j, {r('y')}, t, m FROM {last}"


query("min_moves_frame", rounds("COUNT(*)", 3, 8))(lambda spark, d: panel_e(spark, d).min_moves_frame(3))
query("min_movers_frame", rounds("COUNT(DISTINCT i)", 3, 8))(lambda spark, d: panel_e(spark, d).min_movers_frame(3))


def joint(n: int) -> str:
    out, last = base("E"), "p"
    for k in range(n):
        out += f", a{k} AS (SELECT i, j, y, t FROM {last} WHERE j IN (SELECT j FROM {last} GROUP BY j HAVING COUNT(*) >= 3)), b{k} AS (SELECT * FROM a{k} WHERE i IN (SELECT i FROM a{k} GROUP BY i HAVING COUNT(*) >= 12))"
        last = f"b{k}"
    return out + f" SELECT i, j, {r('y')}, t, {MOVES} AS m FROM {last}"


query("min_joint_obs_frame", joint(8))(lambda spark, d: panel_e(spark, d).min_joint_obs_frame(3, 12))

LINK = f", mv AS (SELECT i, j, t, LEAD(j) OVER {O} AS j1, LEAD(j, 2) OVER {O} AS j2 FROM p WHERE m > 0)"
query("firm_links", base() + LINK + " SELECT DISTINCT j AS src, j1 AS dst FROM mv WHERE j1 IS NOT NULL")(lambda spark, d: connect.firm_links(panel_a(spark, d)))
query("firm_double_links", base() + LINK + " SELECT j AS src, j1 AS dst FROM mv WHERE j1 IS NOT NULL UNION SELECT j, j2 FROM mv WHERE j2 IS NOT NULL")(lambda spark, d: connect.firm_links(panel_a(spark, d), 2))
query("worker_links", base("D", spells=True) + ", mv AS (SELECT *, MAX(m) OVER (PARTITION BY i) AS mm FROM s) SELECT -1 - i AS src, j AS dst, COUNT(*) AS rows, COUNT(DISTINCT spell) AS spells FROM mv WHERE mm > 0 GROUP BY i, j")(lambda spark, d: connect.worker_links(panel_d(spark, d)))

REACH = LINK + ", ed AS (SELECT DISTINCT j AS a, j1 AS b FROM mv WHERE j1 IS NOT NULL), both_ AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach AS (SELECT DISTINCT j AS a, j AS b FROM p UNION SELECT reach.a, x.b FROM reach JOIN {edges} x ON reach.b = x.a)"
WEAK = REACH.format(edges="both_") + ", comp AS (SELECT a AS j, MIN(b) AS c, COUNT(*) AS n FROM reach GROUP BY a)"
STRONG = REACH.format(edges="ed") + ", comp AS (SELECT f.a AS j, MIN(f.b) AS c, COUNT(*) AS n FROM reach f JOIN reach g ON f.a = g.b AND f.b = g.a GROUP BY f.a)"
query("components", base("E") + WEAK + " SELECT j, c AS component, n AS vertices FROM comp")(lambda spark, d: connect.firm_parts(p := panel_e(spark, d), connect.firm_links(p)))
query("strong_components", base("E") + STRONG + " SELECT j, c AS component, n AS vertices FROM comp")(lambda spark, d: connect.firm_parts(p := panel_e(spark, d), connect.firm_links(p), True))
query("strong_components_giant", base("D") + STRONG + " SELECT j, c AS component, n AS vertices FROM comp")(lambda spark, d: connect.firm_parts(p := panel_d(spark, d), connect.firm_links(p), True))
TWO_ENDS = ", lk AS MATERIALIZED (SELECT i, j FROM (SELECT *, MAX(m) OVER (PARTITION BY i) AS mm FROM p) WHERE mm > 0 GROUP BY i, j), ve AS MATERIALIZED (SELECT j AS u, -1 - i AS v FROM lk UNION ALL SELECT -1 - i, j FROM lk)"


def without(kind: str) -> str:
    """What is still reached from a pair's firm, or from a worker's least firm, when the pair or the worker is taken out."""
    if kind == "worker":
        return TWO_ENDS + ", wk AS (SELECT i, MIN(j) AS z FROM lk GROUP BY i UNION SELECT w.i, e.v FROM wk w JOIN ve e ON w.z = e.u WHERE e.v <> -1 - w.i)"
    return TWO_ENDS + ", wk AS (SELECT i, j, j AS z FROM lk UNION SELECT w.i, w.j, e.v FROM wk w JOIN ve e ON w.z = e.u WHERE NOT (e.u = w.j AND e.v = -1 - w.i) AND NOT (e.v = w.j AND e.u = -1 - w.i))"


query("articulation_matches", base("S") + without("match") + " SELECT i, j FROM lk EXCEPT SELECT i, j FROM wk WHERE z = -1 - i")(lambda spark, d: connect.articulation_rows(panel_s(spark, d), "match"))
query("articulation_workers", base("S") + without("worker") + " SELECT DISTINCT lk.i FROM lk LEFT JOIN wk ON lk.i = wk.i AND lk.j = wk.z WHERE wk.z IS NULL")(lambda spark, d: connect.articulation_rows(panel_s(spark, d), "worker"))
BEST = ", best AS (SELECT c FROM comp GROUP BY c ORDER BY COUNT(*) DESC, MAX(n) DESC, MIN(j) LIMIT 1), k AS (SELECT i, j, y, t FROM p WHERE j IN (SELECT j FROM comp WHERE c = (SELECT c FROM best))) "
query("connected", base("E") + WEAK + BEST + AGAIN_M)(lambda spark, d: panel_e(spark, d).connected("connected"))
query("strongly_connected", base("E") + STRONG + BEST + AGAIN_M)(lambda spark, d: panel_e(spark, d).connected("strongly_connected"))
BY_MOVES = ", best AS (SELECT c FROM p JOIN comp USING (j) GROUP BY c ORDER BY COUNT(CASE WHEN m > 0 THEN 1 END) DESC, MAX(n) DESC, MIN(j) LIMIT 1), k AS (SELECT i, j, y, t FROM p WHERE j IN (SELECT j FROM comp WHERE c = (SELECT c FROM best))) "
query("connected_by_moves", base("E") + WEAK + BY_MOVES + AGAIN_M)(lambda spark, d: panel_e(spark, d).connected("connected", size="moves"))

for group in ("observation", "spell", "match", "worker"):
    for strong in (False, True):
        measure = "strongly_" * strong + f"leave_out_{group}"
        query(measure, leave_out_sql(base("E"), group, strong))(lambda spark, d, measure=measure: panel_e(spark, d).connected(measure))
query("strongly_leave_out_worker_sparse", leave_out_sql(base("S"), "worker", True))(lambda spark, d: panel_s(spark, d).connected("strongly_leave_out_worker"))
query("leave_out_firm", leave_out_firm_sql(base("E")) + AGAIN_M)(lambda spark, d: panel_e(spark, d).connected("leave_out_firm"))
query("connected_drop_single_stayers", base("E") + WEAK + BEST + f", k2 AS (SELECT *, {MOVES} AS m FROM k), k3 AS (SELECT *, MAX(m) OVER (PARTITION BY i) AS mm, COUNT(*) OVER (PARTITION BY i) AS nn FROM k2) SELECT i, j, {r('y')}, t, m FROM k3 WHERE mm > 0 OR nn > 1")(lambda spark, d: panel_e(spark, d).connected("connected", drop_single_stayers=True))


def measured(m, **options):
    def run(spark, d):
        firms, names = firm_measures(panel_aw(spark, d), ClusterParams(measures=m, **options))
        return firms.select("j", *(F.col(n).alias(n.partition("_")[2]) for n in names))

    return run


query("moments", base("AW") + f", v AS (SELECT *, SUM(w * y) OVER (PARTITION BY j) / SUM(w) OVER (PARTITION BY j) AS mu FROM p) SELECT j, ROUND(SUM(w * y) / SUM(w), {DIGITS}) AS mean, ROUND(SQRT(SUM(w * (y - mu) * (y - mu)) / SUM(w)), 2) AS sd, ROUND(MAX(y), {DIGITS}) AS max, ROUND(MIN(y), {DIGITS}) AS min FROM v GROUP BY j")(lambda spark, d: measured(Moments(["mean", "var", "max", "min"]))(spark, d).select("j", "mean", F.round(F.sqrt("var"), 2).alias("sd"), "max", "min"))
CUTS = 4
SUMS = ", g AS (SELECT y, SUM(w) AS w FROM p GROUP BY y), cw AS (SELECT y, SUM(w) OVER (ORDER BY y ROWS UNBOUNDED PRECEDING) AS c, SUM(w) OVER () AS total FROM g)"
QS = ", q AS (SELECT " + ", ".join(f"(MIN(CASE WHEN c >= {k / CUTS} * total - 1e-9 * total THEN y END) + COALESCE(MIN(CASE WHEN c > {k / CUTS} * total + 1e-9 * total THEN y END), MAX(y))) / 2 AS q{k}" for k in range(1, CUTS + 1)) + " FROM cw)"
query("cdf_all", base("AW") + SUMS + QS + " SELECT j, " + ", ".join(f"ROUND(SUM(CASE WHEN y <= q{k} THEN w ELSE 0 END) / SUM(w), {DIGITS}) AS cdf_{k - 1}" for k in range(1, CUTS + 1)) + " FROM p CROSS JOIN q GROUP BY j")(measured(CDFs(CUTS)))
FIRM = ", v AS (SELECT *, SUM(w) OVER (PARTITION BY j ORDER BY y ROWS UNBOUNDED PRECEDING) / SUM(w) OVER (PARTITION BY j) AS s FROM p)"
query("cdf_firm", base("AW") + FIRM + " SELECT j, " + ", ".join(f"ROUND(COALESCE(MIN(CASE WHEN s > {k / CUTS} THEN y END), MAX(y)), {DIGITS}) AS cdf_{k - 1}" for k in range(1, CUTS + 1)) + " FROM v GROUP BY j")(measured(CDFs(CUTS, "quantile_firm")))
QG = ", f AS (SELECT j, SUM(w * y) / SUM(w) AS x FROM p GROUP BY j), cut AS (SELECT QUANTILE_CONT(x, 0.25) AS a, QUANTILE_CONT(x, 0.5) AS b, QUANTILE_CONT(x, 0.75) AS c FROM f), gg AS (SELECT j, CAST(x > a AS BIGINT) + CAST(x > b AS BIGINT) + CAST(x > c AS BIGINT) AS g FROM f CROSS JOIN cut)"


@query("quantile_groups", base("AW") + QG + f" SELECT i, j, {r('y')}, t, g, {r('w')}, m FROM p JOIN gg USING (j)")
def _(spark, d):
    return panel_aw(spark, d).cluster(measures=Moments("mean"), grouping=Quantiles(4))


@query("kmeans")
def _(spark, d):
    return panel_aw(spark, d).cluster(measures=CDFs(5), grouping=KMeans(5, seed=1))


GROUPED = ", z AS (SELECT j, g, x FROM f JOIN gg USING (j)), dd AS (SELECT a.j, a.g, b.g AS h, SUM(SQRT((a.x - b.x) * (a.x - b.x))) AS total, COUNT(*) AS n FROM z a CROSS JOIN z b GROUP BY a.j, a.g, b.g), ab AS (SELECT j, g, MAX(CASE WHEN g = h AND n > 1 THEN total / (n - 1) END) AS a, MIN(CASE WHEN g <> h THEN total / n END) AS b FROM dd GROUP BY j, g)"


@query("silhouette", base("AW") + QG + GROUPED + " SELECT j, g, ROUND(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / GREATEST(a, b) END, 4) AS silhouette FROM ab")
def _(spark, d):
    return panel_aw(spark, d).cluster(measures=Moments("mean"), grouping=Quantiles(4), silhouette=True)[1]


@query("rename_and_drop", base("AW") + f" SELECT i, j, {r('y')}, t, ROUND(y / 7.3, {DIGITS}) AS v, m FROM p")
def _(spark, d):
    return panel_aw(spark, d).add_column("c", F.col("y") / 7.3, dtype="float").rename({"c": "v"}).drop("w", allow_optional=True)


@query("merge_left", base() + f", o AS (SELECT o_orderkey AS i, ROUND(o_totalprice, {DIGITS}) AS total FROM orders) SELECT i, j, {r('y')}, t, m, total FROM p LEFT JOIN o USING (i)")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("i"), F.col("o_totalprice").cast("double").alias("total"))
    return panel_a(spark, d).merge(orders, "i")


@query("artificial_time", base() + ", n AS (SELECT DISTINCT i, j, y FROM p) SELECT i, j, ROUND(y, 4) AS y, ROW_NUMBER() OVER (ORDER BY i, j, y) - 1 AS t FROM n")
def _(spark, d):
    rows = panel_a(spark, d).df.select("i", "j", "y").distinct()
    return Panel.of(rows).construct_artificial_time()


@query("artificial_time_per_worker", base() + ", n AS (SELECT DISTINCT i, j, y FROM p) SELECT i, j, ROUND(y, 4) AS y, ROW_NUMBER() OVER (PARTITION BY i ORDER BY j, y) - 1 AS t FROM n")
def _(spark, d):
    rows = panel_a(spark, d).df.select("i", "j", "y").distinct()
    return Panel.of(rows).construct_artificial_time(True)


@query("eventstudy_clean", base("E") + DENSE + f", p2 AS (SELECT new_i AS i, new_j AS j, y, t, m FROM p JOIN jj USING (j) JOIN ii USING (i))" + ES.replace("FROM p)", "FROM p2)") + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m FROM e")
def _(spark, d):
    return panel_e(spark, d).to_eventstudy().clean()


@query("compare_sizes", base("E") + " SELECT CAST(COUNT(*) >= 0 AS BIGINT) AS larger, CAST(COUNT(DISTINCT j) AS BIGINT) AS firms, CAST(COUNT(DISTINCT i) AS BIGINT) AS workers, COUNT(DISTINCT CASE WHEN m > 0 THEN i END) AS movers, COUNT(CASE WHEN m = 0 THEN 1 END) AS stays FROM p")
def _(spark, d):
    p = panel_e(spark, d)
    sizes = p.df.withColumn("_mover", p.get_worker_m()).agg(*(connect.measure(n).alias(n) for n in ("firms", "workers", "movers", "stays")))
    return sizes.select(F.lit(int(compare(p, p, "len", "geq"))).cast("long").alias("larger"), "*")


MU = ", v AS (SELECT *, SUM(w * y) OVER (PARTITION BY j) / SUM(w) OVER (PARTITION BY j) AS mu FROM p)"
query("aggregate_transform_var", base("AW") + MU + f" SELECT i, j, t, ROUND(SQRT(SUM(w * (y - mu) * (y - mu)) OVER (PARTITION BY j) / SUM(w) OVER (PARTITION BY j)), 2) AS sd FROM v")(
    lambda spark, d: aggregate_transform(panel_aw(spark, d).df, "j", "y", "var", weights="w").select("i", "j", "t", F.round(F.sqrt("var"), 2).alias("sd"))
)
query("aggregate_transform_n_unique", base() + " SELECT i, j, t, k AS n_unique FROM p JOIN (SELECT j, COUNT(DISTINCT i) AS k FROM p GROUP BY j) USING (j)")(lambda spark, d: aggregate_transform(panel_a(spark, d).df, "j", "i", "n_unique").select("i", "j", "t", "n_unique"))
query("aggregate_transform_sum", base("AW") + f" SELECT j, ROUND(SUM(y * w), 2) AS total FROM p GROUP BY j")(lambda spark, d: aggregate_transform(panel_aw(spark, d).df, "j", "y", "sum", weights="w", name="total", merge=False).select("j", F.round("total", 2).alias("total")))
query("aggregate_transform_function", base() + f" SELECT j, ROUND(MEDIAN(y), {DIGITS}) AS mm FROM p GROUP BY j")(lambda spark, d: aggregate_transform(panel_a(spark, d).df, "j", "y", np.median, merge=False))

query("aggregate_transform_two_stage", base() + f" SELECT j, ROUND(SQRT(AVG(y * y)), 2) AS rms FROM p GROUP BY j")(lambda spark, d: aggregate_transform(panel_a(spark, d).df, "j", "y", RMS, name="rms", merge=False).select("j", F.round("rms", 2).alias("rms")))

KEPT = f", k AS (SELECT i, j, y, t FROM p WHERE j % 3 {{test}} 1), p2 AS (SELECT *, {MOVES} AS m FROM k)" + ES.replace("FROM p)", "FROM p2)") + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m FROM e"
query("keep_ids_eventstudy", base() + KEPT.format(test="="))(lambda spark, d: (p := panel_a(spark, d)).to_eventstudy().keep_ids("j", p.df.where("j % 3 = 1").select("j")))
query("drop_ids_eventstudy", base() + KEPT.format(test="<>"))(lambda spark, d: (p := panel_a(spark, d)).to_eventstudy().drop_ids("j", p.df.where("j % 3 = 1").select("j")))
BY_ROW = "ROW_NUMBER() OVER (ORDER BY i, t1, j1) - 1 AS i, " + ees_out(3).removeprefix("i, ")
EES_KEPT = base() + ees(3) + LONG_AGAIN + f", p2 AS (SELECT *, {MOVES} AS m FROM a WHERE j % 3 {{test}} 1)" + ees(3).replace("FROM p)", "FROM p2)").replace(" v AS", " v2 AS").replace("FROM v ", "FROM v2 ").replace(" e AS", " e2 AS") + f" SELECT {BY_ROW} FROM e2"
for name, test in (("keep_ids", "="), ("drop_ids", "<>")):
    query(f"{name}_extendedeventstudy", EES_KEPT.format(test=test))(lambda spark, d, name=name: getattr((p := panel_a(spark, d)).to_extendedeventstudy(2, 1, move_to_worker=False), name)("j", p.df.where("j % 3 = 1").select("j")))
query("gen_m_extendedeventstudy", base() + ees(3) + f" SELECT {ees_out(3)} FROM e")(lambda spark, d: panel_a(spark, d).to_extendedeventstudy(2, 1, move_to_worker=False).gen_m(force=True))
WIDE_PLACES = ES + ", o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY i, t1, t2) - 1 AS place FROM e)"
for name, test in (("keep_rows", "IN"), ("drop_rows", "NOT IN")):
    query(f"{name}_eventstudy", base() + WIDE_PLACES + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m FROM o WHERE place {test} (0, 2, 3, 50, 51, 57, 100)")(lambda spark, d, name=name: getattr(panel_a(spark, d).to_eventstudy(), name)([0, 2, 3, 50, 51, 57, 100]))


@query("collapse_at_leave_out_match", leave_out_sql(base("E") + ", merged AS (SELECT i, j, MIN(t) AS t, AVG(y) AS y FROM p GROUP BY i, j)" + f", whole_p AS (SELECT i, j, y, t, {MOVES} AS m FROM merged)", "observation", False, table="whole_p"))
def _(spark, d):
    p = panel_e(spark, d)
    return p.collapse("match").connected("leave_out_observation").df.select("i", "j", "y", F.col("t1").alias("t"), "m")


query("gen_m_eventstudy", base() + ES + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m FROM e")(lambda spark, d: panel_a(spark, d).to_eventstudy().gen_m(force=True))
query("connected_eventstudy", base("E") + WEAK + BEST + f", p2 AS (SELECT *, {MOVES} AS m FROM k)" + ES.replace("FROM p)", "FROM p2)") + f" SELECT i, j1, j2, {r('y1', 'y2')}, t1, t2, m FROM e")(lambda spark, d: panel_e(spark, d).to_eventstudy().connected("connected"))


query("diagnostic")(lambda spark, d: panel_e(spark, d).diagnostic())
query("simulate")(lambda spark, d: simulate(spark, SimParams()))


def firm_report(spark: SparkSession, d: str) -> DataFrame:
    """Spells of all firms: how many, how long, and the mean outcome."""
    return panel_a(spark, d).collapse().df.groupBy("j").agg(F.count("*").alias("spells"), F.sum("w").alias("periods"), F.avg("y").alias("mean_y"))


query("firm_report", base(spells=True) + SPELL_CTE + " SELECT j, COUNT(*) AS spells, ROUND(SUM(w), 4) AS periods, ROUND(AVG(y), 4) AS mean_y FROM c GROUP BY j")(firm_report)
