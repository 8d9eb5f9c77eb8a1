"""Token counts, packing and token output against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm.encoding import WordEncoder
from pairloom.llm.packing import pack, pack_documents
from pairloom.llm.token_counts import RankMerger, count_tokens
from pairloom.llm.token_output import EliasFano, Shard, read_token_index, write_shard, write_token_shards

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello, world.", "a  b\n\n  c\t d", "<|endoftext|> x<|endoftext|>", "İstanbul ΣΑΣ é, €. don't I'M ½", "aaaa" * 300, "x" + " y" * 400, "<|ENDOFTEXT|> 'S foo\x1cbar", "naïve. café, 日本語テキスト。", "a\n \nb \n c\u3000 d\t \te"]
SCHEMA = "doc_id long, text string, start string, ids long"


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", -1) for k, t in enumerate(TEXTS)] + [(3, "Hello, world.", "clash", -1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from("ab eHT.,'\n\t  é<|>st1½İ"), max_size=60), max_size=5))
@settings(max_examples=80, deadline=None)
def test_any_text(libraries, texts):
    assert merger.count([t.encode() for t in texts]) == [len(library_ids(libraries[0], t)) for t in texts]
    texts = [*texts, "İ. İx, ŉ."]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == [library_ids(libraries[1], t) for t in texts]


merger, encoder = RankMerger(BYTE), WordEncoder(WORD)


def test_counts(docs, libraries):
    got = {(x.doc_id, x.n_bytes): (x.n_tokens, x.over_limit) for x in count_tokens(docs, BYTE).collect()}
    for k, t in enumerate(TEXTS):
        n = len(library_ids(libraries[0], t))
        assert got[k, len((t or "").encode())] == (n, n > 1024)
    assert count_tokens(docs, BYTE).count() == docs.count()
    assert count_tokens(docs.limit(0), BYTE).count() == 0


@given(st.lists(st.integers(0, 40), max_size=60))
@settings(deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(steps) if steps else np.zeros(0, np.int64)
    coded = EliasFano.encode(values)
    assert coded.select(0, len(values)).tolist() == values.tolist()
    assert [coded.select(k).tolist() for k in range(len(values))] == [[v] for v in values.tolist()]
    assert coded.before.dtype == np.uint32


def test_select_over_many_blocks():
    values = np.cumsum(np.random.default_rng(0).integers(0, 900, 60_000))
    coded = EliasFano.encode(values)
    for first, n in ((0, 60_000), (0, 1), (511, 2), (59_999, 1), (30_000, 4097), (60_000, 0)):
        assert (coded.select(first, n) == values[first : first + n]).all()
    with pytest.raises(IndexError):
        coded.select(60_000)


def test_shard_round_trip():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 70_000, 1)]
    for width in (2, 4):
        data = ids if width == 4 else [x[: 4 * 60_000] for x in ids]
        shard = Shard(write_shard([5, None, 7, -9], data, width))
        assert shard.doc_ids == [5, None, 7, -9]
        assert [shard.ids(k).tobytes() for k in range(4)] == data
    assert shard.ends.n_bytes() < 5 * 8


def test_token_output(docs, libraries):
    got = read_token_index(write_token_shards(docs, WORD, shard_ids=64, parts=3)).collect()
    want = []
    for x in docs.collect():
        ids = np.array([*library_ids(libraries[1], x.text), 2], "<u4")
        want.append((x.doc_id if x.doc_id is not None else -1, len(ids), zlib.crc32(ids.tobytes())))
    have = sorted(got, key=lambda x: x.start)
    assert [(x.doc_id if x.doc_id is not None else -1, x.n_tokens, x.ids_crc32) for x in have] == sorted(want)
    assert [x.start for x in have] == np.cumsum([0] + [x.n_tokens for x in have])[:-1].tolist()
    assert read_token_index(write_token_shards(docs.limit(0), WORD)).count() == 0


@given(st.lists(st.integers(1, 70), max_size=40))
@settings(deadline=None)
def test_packing_is_whole(lengths):
    pieces, rooms = pack(lengths, 16)
    assert sum(rooms) == sum(lengths) and all(r == 16 or r & (r - 1) == 0 for r in rooms)
    filled = [0] * len(rooms)
    cover = [set() for _ in lengths]
    for doc, start, n, seq, offset in pieces:
        assert offset == filled[seq] and n > 0
        filled[seq] += n
        span = set(range(start, start + n))
        assert not span & cover[doc]
        cover[doc] |= span
    assert filled == rooms and [len(c) for c in cover] == lengths


def test_costs_are_balanced():
    pieces, rooms = pack([1000] * 4 + [50] * 80, 4000, 1.0, 1.0)
    cost = [0] * len(rooms)
    for _, _, n, seq, _ in pieces:
        cost[seq] += n + n * n
    assert max(cost) - min(cost) < 10_000


def test_packed_documents(docs, libraries):
    got = pack_documents(docs, WORD, capacity=64, group_tokens=256, with_ids=True).collect()
    by = {}
    for x in got:
        ids = np.frombuffer(x.ids, "<u4")
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(ids) == x.length
        by.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, ids.tolist()))
    for k in (4, 7, 8):
        want = [*library_ids(libraries[1], TEXTS[k]), 2]
        assert sum((ids for _, ids in sorted(by[k, len(want)])), []) == want
    assert pack_documents(docs.limit(0), WORD).count() == 0
