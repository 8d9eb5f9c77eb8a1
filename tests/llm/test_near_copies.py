"""Near copies of the pipeline against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import near_copies
from pairloom.llm.near_copies import drop_near_copies, meetings, prefixes, told_apart
from pairloom.llm.simhash import embedding, fingerprint


def similarity(a, b):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {None}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def plain_kept(rows):
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if of[a] != of[b] and similarity(rows[a][1], rows[b][1]) >= 0.8:
                of = [of[b] if x == of[a] else x for x in of]
    return sorted(min(r for r, o in zip(rows, of, strict=True) if o == g) for g in set(of))


def test_near_copies_stage(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]

    def changed(words, n):
        out = list(words)
        for k in r.sample(range(len(words)), n):
            out[k] = f"new{r.randrange(10**6)}"
        return " ".join(out)

    texts = [" ".join(base)] + [changed(base, n) for n in (5, 6, 7, 20, 60)] + [changed(base, 4) for _ in range(60)]
    texts += [" ".join(f"v{r.randrange(5000)}" for _ in range(200)) for _ in range(5)] + ["", " \n", "one two", "One  two", "one three"]
    rows = [(k, t) for k, t in enumerate(texts)]
    near = [(fingerprint(texts[0].encode()) ^ fingerprint(t.encode())).bit_count() for t in texts[1:4]]
    assert min(near) > 2 and min(similarity(texts[0], t) for t in texts[1:4]) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted(tuple(x) for x in got.collect()) == plain_kept(rows)


def test_crowded_bands(spark):
    """Texts that share most of a passage, far below the similarity, and pairs of near copies among them."""
    r = random.Random(5)
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(60)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-2] + ["other", str(r.randrange(10**6))])]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(x) for x in got.collect()) == plain_kept(rows) == rows[::2]


def test_a_text_of_many_pairs_is_sent_to_several_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TOGETHER", 8)
    r = random.Random(4)
    base = [[f"{c}{r.randrange(5000)}" for _ in range(200)] for c in "ab"]
    texts = []
    for k in range(90):
        own = list(base[k % 2])
        for at in r.sample(range(200), k % 7):
            own[at] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 40)] + [(0, k) for k in range(40, 60)] + [(70, 71)], "src long, dst long")
    towards = near_copies._towards_hubs(pairs).collect()
    assert sorted((x.src, x.dst) for x in towards) == sorted([(k, 0) for k in range(1, 60)] + [(70, 71)])
    assert {x.part for x in towards if x.dst == 0} == set(range(8)) and all(x.part == 0 for x in towards if x.dst == 71)
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(x) for x in got.collect()) == plain_kept(rows)


def test_sets_of_one_hash_are_told_apart(spark):
    rows = [(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 3), (5, 7, 2), (6, 7, 4)]
    written = spark.createDataFrame(rows, "id long, `set` long, `check` long")
    got = {x.id: x["set"] for x in told_apart(written).collect()}
    assert (got[1], got[2], got[4]) == (7, 7, 8) and got[3] == got[5] and len(set(got.values())) == 4
    assert told_apart(written.where("id in (1, 2, 4)")).columns == ["id", "set"]


def test_rows_of_one_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(3, b), (7, a), (7, b), (9, a), (None, a), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted((x.doc_id or 0, x.text) for x in got.collect()) == [(0, a), (3, b), (7, a)]


def test_names_that_clash(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "x", 1, 2, 3), (2, text + " more", "y", 4, 5, 6), (2, text + " more", "y", 4, 5, 6), (3, None, None, None, None, None), (4, "", "z", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, `set` long, own long, c0 long")
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(x) for x in got.collect()) == [rows[0], rows[3]]
    assert drop_near_copies(docs.limit(0)).count() == 0
    assert sorted(x.doc_id for x in drop_near_copies(docs.where("doc_id > 1")).collect()) == [2, 3]


def test_prefixes_meet(spark):
    """Any two sets similar enough share a shingle of their prefixes."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(x if r.random() > 0.015 * (k % 4) else f"z{r.randrange(40)}" for x in base[r.randrange(5) :]) for k in range(60)]
    found = spark.createDataFrame(list(enumerate(texts)), "`set` long, text string").repartition(3)
    own = {}
    for x in prefixes(found, 0.8, 5).collect():
        own.setdefault(x["set"], set()).add(x.shingle)
    close = [(a, b) for a in range(60) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]
    assert len(close) > 100 and all(own[a] & own[b] for a, b in close)


def test_meetings_lose_no_pair(spark):
    """Texts of many sizes from one: every pair similar enough is a candidate, few others are."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        cut = base[r.randrange(12) : len(base) - r.randrange(12)]
        rate = 0.006 * (k % 6)
        texts.append(" ".join(x if r.random() > rate else f"z{r.randrange(400)}" for x in cut))
    texts += [f"a b c d e{k}" for k in range(5)] + ["a", "a b"]
    sizes = [max(1, len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})) for w in map(str.split, texts)]
    found = spark.createDataFrame(list(enumerate(texts)), "`set` long, text string").repartition(3)
    facts = spark.createDataFrame([(k, n, k // 2) for k, n in enumerate(sizes)], "`set` long, n long, c long")
    got = {tuple(x) for x in meetings(prefixes(found, 0.8, 5).join(facts, "set"), 0.8).collect()}
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if a // 2 != b // 2]
    close = {(a, b) for a, b in pairs if similarity(texts[a], texts[b]) >= 0.8}
    assert len(close) > 100 and close <= got
    assert len(got) < len(pairs) / 2
    assert meetings(prefixes(found.limit(0), 0.8, 5).join(facts, "set"), 0.8).count() == 0


def grids_of(spark, texts):
    """The sets (set, n, f, e) of texts, and each one's hashes by place."""
    sets = [near_copies.shingles(t.encode()) for t in texts]
    rows = [(k, len(s), near_copies.fingerprint(s).tolist()) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, "`set` long, n long, f array<long>").withColumn("e", F.transform("f", embedding))


def test_grids_find_near_copies(spark):
    """Cells of segment bit counts bring texts and their copies together, and few others."""
    r = random.Random(6)
    texts = []
    for _ in range(60):
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        other = list(base)
        for at in r.sample(range(300), 2):
            other[at] = f"new{r.randrange(10**6)}"
        texts += [" ".join(base), " ".join(other)]
    sizes = grids_of(spark, texts)
    met = near_copies.stars(sizes)
    got = {tuple(sorted(x)) for x in near_copies.close(met, sizes, 0.8).collect()}
    assert got == {(k, k + 1) for k in range(0, 120, 2)}
    keyed = near_copies.cells(sizes, near_copies.fineness(120)).collect()
    assert len({x.key for x in keyed}) < len(keyed) == 120 * near_copies.GRIDS
    assert met.count() < 120 * 119 / 10
    assert near_copies.cells(sizes.limit(0), 8).count() == 0 == near_copies.stars(sizes.limit(0)).count()


def test_fingerprint_distances(spark):
    """Fingerprints bit by bit; Manhattan distances of segment counts are never above Hamming distances."""
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(12)}" for _ in range(r.randint(5, 400))) for _ in range(20)]
    sizes = grids_of(spark, texts)
    of = {x.set: x for x in sizes.collect()}

    def counts(x):
        bits = [w >> j & 1 for w in x.f for j in range(64)]
        return [a + b for a, b in zip(bits[::2], bits[1::2], strict=True)]

    a, b = (sizes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("set", "f", "e"))) for x in ("src", "dst"))
    for x in a.crossJoin(b).select("set_src", "set_dst", near_copies.distance("f_src", "f_dst").alias("h"), near_copies.distance("e_src", "e_dst").alias("m")).collect():
        p, q = of[x.set_src], of[x.set_dst]
        assert x.h == sum(((u ^ v) & (1 << 64) - 1).bit_count() for u, v in zip(p.f, q.f, strict=True))
        assert x.m == sum(abs(u - v) for u, v in zip(counts(p), counts(q), strict=True)) <= x.h
    hashes = near_copies.shingles(texts[3].encode())
    twice = near_copies.fingerprint(np.concatenate([hashes] * 200))
    assert (twice == near_copies.fingerprint(hashes)).all()
    k = near_copies.fineness
    assert k(1) == 8 and k(10**6) > k(10**5) and k(10**15) == 34
