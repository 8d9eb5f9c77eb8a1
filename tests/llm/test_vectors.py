"""Vector codes and hard negatives against brute force in plain whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from pairloom.llm.hard_negatives import Scan, Space, mine, route, scores
from pairloom.llm.vector_codes import LEVELS, Codebook, compress, features

SCHEMA = "vec_id long, embedding array<double>, label int, q string, code string, v long"
CLASH = ("clash", "clash", 7)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks of rows (vec_id, vector), one comparison after another."""
    rows = sorted(rows, key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    whole = [[math.floor(1024 * x) for x in v] for _, v in rows]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assigned():
        out = []
        for c in cut:
            near = [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(near)
        return out

    for _ in range(rounds):
        near = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return {r[0]: ("".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)) for r, near in zip(rows, assigned(), strict=True)}, hashlib.sha256(text.encode()).hexdigest()


def test_bounds_are_never_above():
    r = np.random.default_rng(0)
    x, y = (r.integers(-900, 900, (60, 16)) for _ in range(2))
    exact = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    for n in LEVELS:
        a, b = features(x, n), features(y, n)
        assert (((a[:, None] - b[None]) ** 2).sum(axis=2) <= exact + 1e-6).all()
    code, least = Codebook(y).nearest(np.concatenate([x, y]))
    full = np.concatenate([exact, ((y[:, None] - y[None]) ** 2).sum(axis=2)])
    assert code.tolist() == full.argmin(axis=1).tolist() and least.tolist() == full.min(axis=1).tolist()


def test_ties_go_to_the_lower_index():
    book = Codebook(np.array([[4, 0, 0, 0], [-4, 0, 0, 0], [-4, 0, 0, 0], [0, 4, 0, 0]]))
    assert book.nearest(np.zeros((3, 4), np.int64))[0].tolist() == [0, 0, 0]
    assert book.nearest(np.array([[-4, 0, 0, 0]]))[0].tolist() == [1]


@pytest.mark.parametrize("n", [5, 400])
def test_codes(spark, n):
    r = np.random.default_rng(n)
    good = [(k * 3, (r.integers(-3, 4, 8) / 1024 + r.normal(size=8) * (k % 3 == 0)).tolist(), None if k % 4 == 0 else k % 3) for k in range(n)]
    bad = [(1, None, 0), (2, [0.0] * 7 + [None], 1), (4, [math.nan] * 8, 1), (5, [math.inf] + [0.0] * 7, None)]
    docs = spark.createDataFrame([(*x, *CLASH) for x in good + bad], SCHEMA).repartition(3)
    want, sha = plain_codes([(k, v) for k, v, _ in good])
    by_label = {}
    for k, _, label in good:
        by_label[label] = by_label.get(label, 0) + want[k][1]
    got = {x.vec_id: x for x in compress(docs).collect()}
    assert {k: (x.code, x.error) for k, x in got.items()} == want
    assert all(x.codebooks_sha256 == sha for x in got.values())
    assert all(got[k].label_error == by_label[label] for k, _, label in good)


def test_codes_of_odd_rows(spark):
    rows = [(7, [0.5, -0.25]), (7, [0.5, -0.25]), (None, [1e300, -1e300, 3.0]), (3, []), (9, None)]
    got = compress(spark.createDataFrame([(k, v, None, *CLASH) for k, v in rows], SCHEMA)).collect()
    assert sorted((x.vec_id is None, x.vec_id or 0, x.code, x.error) for x in got) == [(False, 3, "00000000", 0), (False, 7, "01010000", 0), (False, 7, "01010000", 0), (True, 0, "03030300", 0)]
    assert compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compress(spark.createDataFrame([(9, None, 1, *CLASH)], SCHEMA)).count() == 0


def plain_mine(rows, anchor, positives=5, negatives=10):
    """Results of rows (vec_id, vector, label), each anchor against each row."""
    rows = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows]
    out = []
    for k, q, label in rows:
        if not anchor(k):
            continue
        near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), n, m != label) for n, v, m in rows if n != k or m != label)
        for p, (minus, name, _) in [(p, x) for p, x in enumerate(x for x in near if not x[2])][:positives]:
            fit = [(n, -s) for s, n, other in near if other and -30 * minus <= -100 * s <= -90 * minus][:negatives]
            out += [(k, name, r + 1, n, -minus, s) for r, (n, s) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["ties", "groups"])
def test_hard_negatives(spark, kind, monkeypatch):
    from pairloom.llm import hard_negatives

    monkeypatch.setattr(hard_negatives, "PAGE_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "STREAM_PAGES", 3)
    r = np.random.default_rng(5)
    x = {"ties": r.integers(-1, 2, (600, 4)).astype(float), "groups": r.normal(size=(6, 8))[r.integers(0, 6, 600)] + r.normal(size=(600, 8)) / 9}[kind]
    if kind == "ties":
        x[::3] = x[0]  # a third of all rows are copies
    good = [(k, v.tolist(), k % 4 if k % 2 else 1) for k, v in enumerate(x)]
    bad = [(None, [1.0] * x.shape[1], 1), (1000, None, 1), (1020, [math.inf] * x.shape[1], 1), (1040, [0.5, None], 1), (1060, [1.0] * x.shape[1], None)]
    rows = spark.createDataFrame([(k, v, label, *CLASH) for k, v, label in good + bad], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in mine(rows, "vec_id % 20 = 0").collect())
    assert got == plain_mine(good, lambda k: k % 20 == 0) and got


def test_hard_negatives_of_odd_rows(spark):
    near = [0.9, 0.1]
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, near, 1), (6, [0.6], 2), (6, [0.6], 2), (7, [0.0, 0.0], 2), (8, [1e300, 0.0], 2)]
    got = sorted(tuple(r) for r in mine(spark.createDataFrame([(k, v, m, *CLASH) for k, v, m in rows], SCHEMA)).collect())
    assert got == [(0, 5, 1, 6, 256 * 230, 256 * 153)] * 2 + [(0, 5, 2, 6, 256 * 230, 256 * 153)] * 2
    assert mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mine(spark.createDataFrame([(1, near, 1, *CLASH)], SCHEMA)).count() == 0


def test_scores_of_large_numbers():
    q = np.array([[2**29 + 1, -(2**29), 3]])
    assert scores(q, q)[0, 0] == (2**29 + 1) ** 2 + 2**58 + 9


def test_far_cells_are_not_read():
    r = np.random.default_rng(1)
    centres = r.normal(size=(16, 8)) * 900
    x = np.concatenate([c + r.normal(size=(40, 8)) * 9 for c in centres]).astype(np.int64)
    space = Space.fit(x, float((x**2).sum(axis=1).max()), 16)
    apart = space.of_rows(x)
    near, key = apart.argmin(axis=1), apart.min(axis=1)
    names = np.unique(near)
    cells = np.rec.fromarrays([names, names, [key[near == p].min() for p in names], [key[near == p].max() for p in names], np.ones(len(names), int)], names="cell,pivot,low,high,pages")
    top = np.argmax((x**2).sum(axis=1))
    block = {"q": x[top : top + 1], "id": np.array([-1]), "row": np.array([0]), "label": np.array([0]), "high": np.array([[2**62]]), "low": np.sort(x @ x[top])[-5:-4, None]}
    asked = route(space, cells, block, Scan(space, block, 5, True), first=False)
    assert len(asked) < len(names) - 4
