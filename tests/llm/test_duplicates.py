"""Near-duplicates, decontamination and neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import ann
from pairloom.llm.decontamination import Index, decontaminate, drop_contaminated
from pairloom.llm.simhash import GRIDS, cell_masks, drop_near_duplicates, fingerprint, links, near_duplicates
from pairloom.plans.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    of = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    of[a] = of[b] = min(of[a], of[b])
    return of


@pytest.mark.parametrize("text", ["", " \n", "One", "a b", "A b c d a b c d", "é\x1fü x\x0by z " * 50])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_cells_never_miss():
    r = random.Random(0)
    grids = [cell_masks(2, n) for n in GRIDS]
    for _ in range(500):
        a = r.getrandbits(64)
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        u = lambda x: (x | x >> 1) & 0x5555555555555555 | ((x & x >> 1 & 0x5555555555555555) << 1)
        assert (u(a) ^ u(b)).bit_count() <= (a ^ b).bit_count()
        assert all(any((u(a) ^ u(b)) & (m % 2**64) == 0 for m in masks) for masks in grids)


def test_links_of_crowded_cells(spark):
    r = random.Random(1)
    middle = r.getrandbits(64)
    fps = {middle ^ sum(1 << k for k in r.sample(range(64), r.randrange(3))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    fps |= {middle ^ 0b1110000, middle ^ 0b1111110000}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    found = {x.node: x.component for x in connected_components(links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    plain = plain_groups([x % 2**64 for x in signed])
    assert {s: found.get(s, s) for s in signed} == {s: signed[p] for s, p in zip(signed, plain, strict=True)}


def test_near_duplicates(spark):
    base = " ".join(random.Random(2).choice("ka lo mi ru te so".split()) + str(k) for k in range(400))
    texts = [base, base + " end", None, "", "other words here", base.upper(), base, "x " * 20_000]
    rows = [(k * 10, t, "c", 7, 8) for k, t in enumerate(texts)] + [(None, "", "c", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, _id long, c1 long")
    got = {(x.doc_id, x.fingerprint): x.component_id for x in near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    for k, (f, p) in enumerate(zip(fps, plain_groups(fps), strict=True)):
        assert got[k * 10, f"{f:016x}"] == p * 10
    assert got[None, "0" * 16] == 20
    kept = sorted(x.doc_id for x in drop_near_duplicates(docs.where("doc_id is not null")).collect())
    assert kept == sorted({p * 10 for p in plain_groups(fps)})
    assert near_duplicates(docs.limit(0)).count() == 0
    twice = docs.where("doc_id is not null").union(docs.where("doc_id = 0"))
    assert [x.doc_id for x in drop_near_duplicates(twice).collect()].count(0) == 1
    assert drop_near_duplicates(docs).columns == docs.columns


def plain_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(10, len(v))
        for a in range(len(v) - n + 1 if v else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit |= set(range(b, b + n))
                    found |= {str(name)} if name is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_decontamination(spark, block):
    r = random.Random(3)
    vocabulary = "lo mi ra Te-su é1 x".split()

    def say(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    items = [(1, say(30)), (2, say(10)), (3, "Just three words"), (4, "one"), (4, say(12)), (None, say(11)), (5, None), (6, ""), (7, "two words")]
    texts = [say(40) for _ in range(12)] + [f"{say(5)} {t} {say(4)}" for _, t in items if t] + [None, "", "ONE!", "just three, WORDS", items[0][1][:-3], "w " * 5000 + (items[1][1] + " ") * 3]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "one", 1), (0, texts[0], 1)], "doc_id long, text string, n_hit long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench, block_words=block)
    rows = {x.doc_id: x for x in got.collect()}
    for k, t in enumerate(texts):
        x = rows[k]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == plain_hits(t, items), (k, t)
        assert x.contaminated == (x.n_hit > 0)
    assert got.count() == docs.count()
    clean = drop_contaminated(docs, bench, block_words=block)
    assert sorted(x.doc_id for x in clean.where("doc_id is not null").collect()) == sorted(k for k in [*range(len(texts)), 0] if not rows[k].contaminated)
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_many_words():
    """More different words in a block than 21 bits number."""
    n = (1 << 21) + 500
    index = Index([("a", " ".join(f"w{k:x}" for k in range(n)).encode())], 10)
    index.order({k: np.zeros(len(v), np.int64) for k, v in index.shingles.items()})
    ids = index.number([f"w{k:x}".encode() for k in range(n - 12, n)])
    windows, places = index.hits(ids)
    assert sorted(places.tolist()) == [0, 1, 2] and sorted(index.start[windows].tolist()) == [n - 12, n - 11, n - 10]


def test_partial_containment(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i Z"), (2, "a b c d e q q q q q")], "doc_id long, text string")
    assert {x.doc_id: x.contaminated for x in decontaminate(docs, bench, containment=0.8).collect()} == {1: True, 2: False}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[300:420] = v[7]
    v[500:560] = v[60] + 0.01 * rng.standard_normal((60, 16))
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    odd = [(1000, None, 0), (1020, [], 0), (1040, [0.0] * 16, 0), (1060, [None] + [1.0] * 15, 0), (1080, [float("nan")] * 16, 0), (None, [1.0] * 16, 0), (1100, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = ann.search(ann.build_index(df, shard_rows=300), df.where("vec_id % 20 = 0"), block=16).toPandas()
    exact = v.astype(float) @ v.astype(float).T
    hit = total = 0
    for q in range(0, 900, 20):
        order = [k for k in np.lexsort((np.arange(900), -exact[q])) if k != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in own.vec_id.tolist()
        np.testing.assert_allclose(own.score, exact[q, own.vec_id], atol=1e-12)
        hit += len(set(order) & set(own.vec_id))
        total += 20
    assert hit / total >= 0.95
    assert set(got.query_id) == set(range(0, 900, 20))
    same = got[got.query_id == 300].sort_values("rank").vec_id.tolist()
    assert same == [7, *range(301, 320)]
    few = df.where("vec_id < 5 or vec_id = 20")
    assert ann.search(ann.build_index(few), few.where("vec_id % 20 = 0")).groupBy("query_id").count().where(F.col("count") != 5).count() == 0
    assert ann.search(ann.build_index(df.limit(0)), df.limit(0)).count() == 0
