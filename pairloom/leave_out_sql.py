"""SQL for the leave-out sets of a panel, by taking out each pair or worker and looking what is still reached.

The text unrolls a number of levels and of rounds of dropping firms with few moves; both must be
enough for the tables at hand. Vertices are firms (j) and workers (-1 - i). b is a branch (its
least firm), path its place in the order in which branches are tried.
"""

from __future__ import annotations

ORDER = "(PARTITION BY b, i ORDER BY t, j)"
MOVES = f"COALESCE(CAST(LAG(j) OVER {ORDER} <> j AS BIGINT), 0) + COALESCE(CAST(LEAD(j) OVER {ORDER} <> j AS BIGINT), 0)"


def links(name: str, rows: str) -> str:
    """Pairs of movers and firms with their rows and spells, and the edges they make, in both directions."""
    return f""",
{name}_l AS MATERIALIZED (SELECT b, i, j, COUNT(*) AS n, SUM(new) AS spells FROM (SELECT *, MAX(m) OVER (PARTITION BY b, i) AS mover, CASE WHEN LAG(j) OVER {ORDER} = j THEN 0 ELSE 1 END AS new FROM {rows}) WHERE mover > 0 GROUP BY b, i, j),
{name}_e AS MATERIALIZED (SELECT b, j AS u, -1 - i AS v FROM {name}_l UNION ALL SELECT b, -1 - i, j FROM {name}_l)"""


def parts(name: str, rows: str, strong: bool) -> str:
    """name(b, j, c, n): each firm's part, named by its least firm, and the number of its vertices."""
    reach = f"{name}_r AS (SELECT DISTINCT b, j AS a, j AS z FROM {rows} UNION SELECT r.b, r.a, e.v FROM {name}_r r JOIN {name}_e e ON r.b = e.b AND r.z = e.u)"
    if strong:
        return f""",
{name}_e AS MATERIALIZED (SELECT DISTINCT b, u, v FROM (SELECT b, j AS u, LEAD(j) OVER {ORDER} AS v FROM {rows} WHERE m > 0) WHERE v IS NOT NULL),
{reach},
{name} AS MATERIALIZED (SELECT f.b, f.a AS j, MIN(f.z) AS c, COUNT(*) AS n FROM {name}_r f JOIN {name}_r g ON f.b = g.b AND f.a = g.z AND f.z = g.a GROUP BY f.b, f.a)"""
    return f"""{links(name, rows)},
{reach},
{name} AS MATERIALIZED (SELECT b, a AS j, MIN(CASE WHEN z >= 0 THEN z END) AS c, COUNT(*) AS n FROM {name}_r GROUP BY b, a)"""


def loose(name: str, rows: str, group: str) -> str:
    """name(b, i, j): pairs whose rows hold their branch together; of a worker all of its pairs."""
    if group == "worker":
        walk = f"SELECT b, i, MIN(j) AS z FROM {name}_l GROUP BY b, i UNION SELECT w.b, w.i, e.v FROM {name}_w w JOIN {name}_e e ON w.b = e.b AND w.z = e.u WHERE e.v <> -1 - w.i"
        found = f"SELECT b, i, j FROM {name}_l WHERE (b, i) IN (SELECT (l.b, l.i) FROM {name}_l l LEFT JOIN {name}_w w ON l.b = w.b AND l.i = w.i AND l.j = w.z WHERE w.z IS NULL)"
    else:
        walk = f"SELECT b, i, j, j AS z FROM {name}_l UNION SELECT w.b, w.i, w.j, e.v FROM {name}_w w JOIN {name}_e e ON w.b = e.b AND w.z = e.u WHERE NOT (e.u = w.j AND e.v = -1 - w.i) AND NOT (e.v = w.j AND e.u = -1 - w.i)"
        single = {"match": "", "observation": " AND l.n = 1", "spell": " AND l.spells = 1"}[group]
        found = f"SELECT l.b, l.i, l.j FROM {name}_l l LEFT JOIN {name}_w w ON l.b = w.b AND l.i = w.i AND l.j = w.j AND w.z = -1 - l.i WHERE w.z IS NULL{single}"
    return f"""{links(name, rows)},
{name}_w AS ({walk}),
{name} AS MATERIALIZED ({found})"""


def leave_out_sql(base: str, group: str, strong: bool, levels: int = 4, rounds: int = 5, table: str = "p") -> str:
    """Rows of the largest leave-out set by firms; base ends with a table of i, j, y, t and m."""
    sql = base + f", whole AS (SELECT 0 AS b, i, j, y, t, m FROM {table})" + parts("start", "whole", strong)
    sql += f", f0 AS MATERIALIZED (SELECT j, least AS b, [-n, least] AS path FROM (SELECT *, MIN(j) OVER (PARTITION BY c) AS least FROM start)), r0 AS (SELECT i, j, y, t FROM {table})"
    for k in range(levels):
        sql += f", q{k}_0 AS MATERIALIZED (SELECT *, {MOVES} AS m FROM (SELECT b, path, i, j, y, t FROM r{k} JOIN f{k} USING (j)))"
        for x in range(rounds):
            sql += f", q{k}_{x + 1} AS MATERIALIZED (SELECT *, {MOVES} AS m FROM (SELECT b, path, i, j, y, t FROM q{k}_{x} WHERE j IN (SELECT j FROM q{k}_{x} WHERE m > 0 GROUP BY j HAVING COUNT(*) >= 2)))"
        rows = f"q{k}_{rounds}"
        again = "SELECT 0 AS b, 0 AS j, 0 AS c, 0 AS n WHERE FALSE"
        if strong:
            sql += f", x{k} AS MATERIALIZED (SELECT * FROM {rows} WHERE b IN (SELECT b FROM (SELECT b, COUNT(*) AS n FROM q{k}_0 GROUP BY b) JOIN (SELECT b, COUNT(*) AS n2 FROM {rows} GROUP BY b) USING (b) WHERE n <> n2))" + parts(f"xd{k}", f"x{k}", True)
            again = f"SELECT b, j, c, n FROM xd{k} WHERE b IN (SELECT b FROM xd{k} GROUP BY b HAVING COUNT(DISTINCT c) > 1)"
        sql += f", again{k} AS MATERIALIZED ({again}), p{k} AS MATERIALIZED (SELECT * FROM {rows} WHERE b NOT IN (SELECT b FROM again{k}))" + loose(f"o{k}", f"p{k}", group)
        sql += f", u{k} AS MATERIALIZED (SELECT *, {MOVES} AS m FROM (SELECT p.b, p.i, p.j, p.y, p.t FROM p{k} p WHERE p.b IN (SELECT b FROM o{k}) AND (p.b, p.i, p.j) NOT IN (SELECT (b, i, j) FROM o{k})))" + parts(f"d{k}", f"u{k}", strong)
        sql += f""",
apart{k} AS MATERIALIZED (SELECT b, j, c, n FROM d{k} WHERE b IN (SELECT b FROM d{k} GROUP BY b HAVING COUNT(DISTINCT c) > 1) UNION ALL SELECT * FROM again{k}),
leaf{k} AS MATERIALIZED (SELECT {k} AS level, b, path, COUNT(DISTINCT j) AS size FROM p{k} WHERE b NOT IN (SELECT b FROM apart{k}) GROUP BY b, path),
f{k + 1} AS MATERIALIZED (SELECT j, least AS b, path || [-n, least] AS path FROM (SELECT *, MIN(j) OVER (PARTITION BY b, c) AS least FROM apart{k}) JOIN (SELECT DISTINCT b, path FROM {rows}) USING (b)),
r{k + 1} AS (SELECT i, j, y, t FROM {rows} WHERE b IN (SELECT b FROM apart{k}))"""
    every = " UNION ALL ".join(f"SELECT * FROM leaf{k}" for k in range(levels))
    kept = " UNION ALL ".join(f"SELECT {k} AS level, b, i, j, y, t, m FROM p{k}" for k in range(levels))
    return sql + f", best AS (SELECT level, b FROM ({every}) ORDER BY size DESC, path LIMIT 1) SELECT i, j, ROUND(y, 4) AS y, t, m FROM ({kept}) JOIN best USING (level, b)"


def leave_out_firm_sql(base: str) -> str:
    """Rows of the largest block of firms; links are those of firms one and two moves apart. Two links of a firm belong together if their other ends are joined without it."""
    return base + f""", mv AS (SELECT i, j, LEAD(j) OVER (PARTITION BY i ORDER BY t, j) AS j1, LEAD(j, 2) OVER (PARTITION BY i ORDER BY t, j) AS j2 FROM p WHERE m > 0),
pairs AS MATERIALIZED (SELECT DISTINCT LEAST(a, b) AS a, GREATEST(a, b) AS b FROM (SELECT j AS a, j1 AS b FROM mv UNION ALL SELECT j, j2 FROM mv) WHERE a <> b),
e AS MATERIALIZED (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
w AS (SELECT u AS gone, v AS start, v AS z FROM e UNION SELECT w.gone, w.start, e.v FROM w JOIN e ON w.z = e.u WHERE e.v <> w.gone),
near AS MATERIALIZED (SELECT LEAST(gone, start) AS a, GREATEST(gone, start) AS b, LEAST(gone, z) AS c, GREATEST(gone, z) AS d FROM w JOIN e ON w.gone = e.u AND w.z = e.v),
same AS (SELECT a, b, a AS c, b AS d FROM pairs UNION SELECT s.a, s.b, n.c, n.d FROM same s JOIN near n ON s.c = n.a AND s.d = n.b),
block AS (SELECT a, b, MIN([c, d]) AS id FROM same GROUP BY a, b),
ends AS MATERIALIZED (SELECT id, a AS j FROM block UNION SELECT id, b FROM block),
best AS (SELECT id FROM ends GROUP BY id ORDER BY COUNT(*) DESC, MIN(j) LIMIT 1),
k AS (SELECT i, j, y, t FROM p WHERE j IN (SELECT j FROM ends WHERE id = (SELECT id FROM best)))
"""
