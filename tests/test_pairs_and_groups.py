"""Silhouettes, and pairs ordered by income, against plain versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from pairloom.operators.cluster import silhouettes


@pytest.mark.parametrize("block", [7, 1000])
def test_silhouettes(spark, block):
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(60, 2)), 1)
    x[:9] = x[0]  # copies, at distance zero
    g = r.integers(0, 3, 60)
    g[:9], g[59] = 0, 7
    rows = [(f"f{k}", 1.0, *map(float, v)) for k, v in enumerate(x)]
    firms, groups = spark.createDataFrame(rows, "j string, w double, a double, b double"), spark.createDataFrame([(f"f{k}", int(c)) for k, c in enumerate(g)], "j string, g long")
    got = {s.j: (s.g, s.silhouette) for s in silhouettes(firms, ["a", "b"], groups, block).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for k in range(60):
        own = g == g[k]
        a = d[k][own].sum() / max(1, own.sum() - 1)
        b = min(d[k][g == h].mean() for h in set(g.tolist()) - {g[k]})
        want = 0 if own.sum() == 1 else (b - a) / max(a, b)
        assert got[f"f{k}"][0] == g[k] and got[f"f{k}"][1] == pytest.approx(want, abs=1e-9)


def test_silhouettes_of_odd_tables(spark):
    firms = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, None), (3, 1.0, 1.0)], "j long, w double, a double")
    one = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "j long, g long")
    assert [s.silhouette for s in silhouettes(firms, ["a"], one).collect()] == [None] * 3
    assert silhouettes(firms.limit(0), ["a"], one).count() == 0
    two = spark.createDataFrame([(1, 0), (3, 1)], "j long, g long")
    assert {s.j: s.silhouette for s in silhouettes(firms, ["a"], two).collect()} == {1: 0.0, 3: 0.0}


@pytest.mark.parametrize("seed", [0, 4])
def test_income_order_with_one_crowded_pair(panel, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(301):  # two firms share all workers but a few
        for t, j in enumerate(r.permutation([0, 1] if i % 10 else [0, 1, 2])):
            rows.append((i, int(j), float(r.integers(0, 4)), t))
    got = panel(rows).gen_m().collapse("match").to_permutedeventstudy("income", seed=seed).df.collect()
    income, firms = {}, defaultdict(list)
    for i in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == i]
        income[i] = sum(x[2] for x in own) / len(own)
        js = sorted(x[1] for x in own)
        for a in range(len(js)):
            for b in js[a + 1 :]:
                firms[js[a], b].append(i)
    want = set()
    for (lo, hi), who in firms.items():
        who.sort(key=lambda i: (income[i], i))
        coin = hashlib.md5(f"{lo}|{hi}|{seed}".encode()).hexdigest()[0] < "8"
        half = len(who) // 2 + (coin if len(who) % 2 else 0)
        want |= {(i, hi, lo) if k < half else (i, lo, hi) for k, i in enumerate(who)}
    assert {(x.i, x.j1, x.j2) for x in got} == want and len(got) == len(want)
