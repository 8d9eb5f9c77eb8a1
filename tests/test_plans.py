"""Graph algorithms, numbering and quantiles against plain versions."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions.measures import weighted_quantiles
from pairloom.plans.components import connected_components
from pairloom.plans.graph import blocks, bridges, cut_vertices, strong_components
from pairloom.plans.numbering import number_rows
from pairloom.plans.scratch import CLEAN_UP, drop_scratch, materialise
from tests.plain_graph import search, strong

GRAPHS = st.integers(1, 9).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=16)))


def pieces(n, edges, without=None):
    left = [v for v in range(n) if v != without]
    of = {v: v for v in left}
    for _ in left:
        for a, b in edges:
            if without not in (a, b):
                of[a] = of[b] = min(of[a], of[b])
    return len(set(of.values()))


@given(GRAPHS)
@settings(max_examples=150, deadline=None)
def test_bridges_and_cut_vertices(graph):
    n, pairs = graph
    edges = sorted({(min(e), max(e)) for e in pairs if e[0] != e[1]})
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    bridge, block, cut = search(a, b, n)
    for k, e in enumerate(edges):
        assert bridge[k] == (pieces(n, [x for x in edges if x != e]) > pieces(n, edges))
    for v in range(n):
        alone = not any(v in e for e in edges)
        assert cut[v] == (pieces(n, edges, v) > pieces(n, edges) - alone)
    assert (block >= 0).all()


@given(GRAPHS)
@settings(max_examples=150, deadline=None)
def test_strong_components(graph):
    n, edges = graph
    reach = np.eye(n, dtype=bool)
    for a, b in edges:
        reach[a, b] = True
    for k in range(n):
        reach |= reach[:, [k]] & reach[[k], :]
    of = strong(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64), n)
    both = reach & reach.T
    assert all((of[a] == of[b]) == both[a, b] for a in range(n) for b in range(n))


def many_graphs():
    """Random graphs, a path, a wheel with a tail and a large dense one, all in one table of edges."""
    r = random.Random(3)
    graphs = [[(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(2 * n + 1))] for n in (r.randint(1, 12) for _ in range(150))]
    graphs.append([(k, k + 1) for k in range(9)] + [(9, 4)])
    graphs.append([(0, k) for k in range(1, 40)] + [(k, k % 39 + 1) for k in range(1, 40)] + [(39, 40), (40, 41)])
    graphs.append([(r.randrange(90), r.randrange(90)) for _ in range(400)])
    return [[(1000 * g + a, 1000 * g + b) for a, b in e] for g, e in enumerate(graphs)]


def local(edges):
    names = sorted({v for e in edges for v in e})
    at = {v: k for k, v in enumerate(names)}
    return names, *(np.array([at[e[k]] for e in edges], np.int64) for k in (0, 1))


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([e for g in many_graphs() for e in g] + [(None, 1), (5, None)], "src long, dst long")


def test_strong_components_of_many_graphs(edges):
    got = {x.node: x.component for x in strong_components(edges).collect()}
    want = {}
    for graph in many_graphs():
        names, a, b = local([e for e in graph if e[0] != e[1]])
        least = {}
        for v, c in zip(names, strong(a, b, len(names)).tolist(), strict=True):
            want[v] = least.setdefault(c, v)
    assert got == want


def test_blocks_of_many_graphs(edges):
    got = {(x.src, x.dst): (x.block, x.bridge) for x in blocks(edges).collect()}
    cut, pairs, names_of = set(), set(), {}
    for graph in many_graphs():
        own = sorted({(min(e), max(e)) for e in graph if e[0] != e[1]})
        names, a, b = local(own)
        bridge, block, cuts = search(a, b, len(names))
        cut |= {names[k] for k in np.flatnonzero(cuts)}
        pairs |= {e for e, x in zip(own, bridge, strict=True) if x}
        for e, c in zip(own, block.tolist(), strict=True):
            names_of.setdefault((own[0], c), set()).add(got[e][0])
    assert all(len(x) == 1 for x in names_of.values()) and len(names_of) == len({b for b, _ in got.values()})
    assert {e for e, (_, x) in got.items() if x} == pairs
    assert {(x.src, x.dst) for x in bridges(edges).collect()} == pairs
    assert {x.node for x in cut_vertices(edges).collect()} == cut


def test_graphs_without_edges(edges):
    none = edges.limit(0)
    assert [f(none).count() for f in (strong_components, blocks, bridges, cut_vertices)] == [0] * 4
    loops = none.sparkSession.createDataFrame([(1, 1)], "src long, dst long")
    assert strong_components(loops).count() == 0 and blocks(loops).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    r = random.Random(5)
    n = 60
    edges = {"path": [(k, k + 1) for k in range(n)], "star": [(0, k) for k in range(1, n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(45)], "empty": []}[shape]
    of = {v: v for e in edges for v in e}
    for _ in range(n + 1):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "src long, dst long"))
    assert {x.node: x.component for x in got.collect()} == of


def test_numbers_follow_the_order(spark):
    values = [(v,) for v in random.Random(1).sample(range(10_000), 500)]
    got = number_rows(spark.createDataFrame(values, "v long").repartition(7), [F.col("v").desc()], "n").collect()
    assert [x.v for x in sorted(got, key=lambda x: x.n)] == sorted((v for v, in values), reverse=True)
    assert number_rows(spark.createDataFrame([], "v long"), [F.col("v")], "n").count() == 0


def test_weighted_quantiles(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (4.0, 4.0)], "y double, w double")
    assert weighted_quantiles(rows, [0.125, 0.2, 0.5, 1.0]) == [1.5, 2.0, 3.5, 4.0]


def test_simulation(spark):
    from pairloom.operators.params import SimParams
    from pairloom.sources.simulate import simulate

    p = SimParams(n_workers=3000, p_move=0.3)
    df = simulate(spark, p, seed=3)
    assert df.count() == 15_000
    assert df.where("abs(y) > 12").count() == 0
    by = defaultdict(set)
    for x in df.select("i", "l").distinct().collect():
        by[x.l].add(x.i)
    assert len(by) == p.nl
    assert df.select("j", "k").distinct().groupBy("j").count().where("count > 1").count() == 0
    again = simulate(spark, p, seed=3)
    assert df.exceptAll(again).count() == 0


def test_scratch_tables_leave_no_shuffle_files(spark):
    blocks_of = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks_of.getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, old = shuffles(), spark.conf.get(CLEAN_UP, None)
    written = materialise(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).count(), "counted")
    for _ in range(50):  # they are removed in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and written.count() == 7_000 and spark.conf.get(CLEAN_UP, None) == old
    drop_scratch(written)
