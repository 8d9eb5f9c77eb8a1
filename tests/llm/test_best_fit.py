"""Best-fit packing: the search against plain rules, and whole results against the library."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import best_fit as bf

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, ids long, piece string, sequence_id string"


def fills(lengths, of):
    return sorted(x for x in np.bincount(of, weights=lengths).astype(int).tolist() if x)


def fewest(lengths, capacity):
    """Of all ways to deal pieces, the least number of sequences."""
    for n in range(1, len(lengths) + 1):
        for of in itertools.product(range(n), repeat=len(lengths)):
            if max(np.bincount(of, weights=lengths)) <= capacity:
                return n
    return 0


@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
@settings(deadline=None)
def test_any_lengths(lengths):
    sizes = np.array(lengths)
    start = bf.best_fit(sizes, 20)
    plain, room = [], []
    for p in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        fit = [(room[s], s) for s in range(len(room)) if room[s] >= lengths[p]]
        if not fit:
            room.append(20)
        s = min(fit)[1] if fit else len(room) - 1
        room[s] -= lengths[p]
        plain.append(s)
    assert fills(sizes, start) == sorted(20 - x for x in room)
    of = bf.trade(sizes, start, 20)
    a, b = fills(sizes, start), fills(sizes, of)
    assert b[-1] <= 20 and len(b) <= len(a) and sum(x * x for x in b) >= sum(x * x for x in a)
    seq, offset, fill = bf.pack_group(lengths, 20)
    for s in range(seq.max() + 1):
        own = sorted((int(offset[p]), lengths[p]) for p in np.flatnonzero(seq == s))
        assert [x for x, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]]
        assert set(fill[seq == s].tolist()) == {sum(n for _, n in own)}


def test_trades():
    r = np.random.default_rng(0)
    for _ in range(20):
        sizes = r.integers(2, 9, 6)
        start = bf.best_fit(sizes, 12)
        a, b = len(fills(sizes, start)), len(fills(sizes, bf.trade(sizes, start, 12)))
        assert fewest(sizes.tolist(), 12) <= b <= a
    for sizes, of, capacity, want in (([6, 4, 1, 5], [0, 1, 1, 1], 11, [5, 11]), ([2, 2, 3, 8], [0, 0, 1, 1], 12, [3, 12]), ([3, 8, 8], [0, 1, 2], 11, [8, 11]), ([9, 9], [0, 1], 12, None)):
        sizes, of = np.array(sizes), np.array(of)
        fill = np.bincount(of, weights=sizes).astype(np.int64)
        gave = bf._give(sizes, of, fill, 0, np.flatnonzero(of != 0), np.unique(of[of != 0]), capacity)
        assert gave == (want is not None) and fills(sizes, of) == (want or [9, 9]) and fill[fill > 0].tolist() == np.bincount(of, weights=sizes)[np.bincount(of) > 0].tolist()


def test_trades_empty_sequences_that_best_fit_needs():
    r = np.random.default_rng(0)
    sizes = np.where(r.random(3000) < 0.5, r.integers(600, 900, 3000), r.integers(1800, 2400, 3000))
    start = bf.best_fit(sizes, 4096)
    assert len(fills(sizes, bf.trade(sizes, start, 4096))) < len(fills(sizes, start))


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pieces_make_up_the_documents(spark, capacity):
    r = np.random.default_rng(2)
    texts = [None, "", " ", "Hello, world.", "x" + " y" * 9000] + [" ".join(["word", "other", "naïve", "text."][k] for k in r.integers(0, 4, n)) for n in r.integers(1, 25, 200)]
    rows = [(k, t, "clash", -1, "clash", "clash") for k, t in enumerate(texts)] + [(3, "Hello, world.", None, 0, None, None), (None, "no id", None, 0, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = bf.pack_best_fit(docs, WORD, capacity=capacity, group_pieces=40 if capacity == 16 else 10_000, with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    want = defaultdict(list)
    for k, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            want[k].append((n, start, np.array(ids[start : start + capacity], "<u4").tobytes()))
    found, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        assert x.length * 4 == len(x.ids) and x.ids_crc32 == zlib.crc32(x.ids)
        found[x.doc_id].append((x.piece, x.start, bytes(x.ids)))
        sequences[x.sequence_id].append((x.offset, x.length, x.sequence_length))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    for own in sequences.values():
        own.sort()
        ends = np.cumsum([n for _, n, _ in own]).tolist()
        assert [x for x, _, _ in own] == [0, *ends[:-1]] and ends[-1] <= capacity and {x for _, _, x in own} == {ends[-1]}
    tokens = sum(len(b) // 4 for v in want.values() for _, _, b in v)
    assert len(sequences) <= -(-tokens // capacity) + (0 if capacity == 4096 else 4)


def test_empty_table(spark):
    assert bf.pack_best_fit(spark.createDataFrame([], SCHEMA), WORD).count() == 0
