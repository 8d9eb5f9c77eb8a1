"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the distinct ones of a batch become one ragged numpy array of
symbols. In each round every sequence finds its pair of lowest rank, and all sequences apply
theirs at the same time; a sequence without a ranked pair is finished, and what is left of it
are its tokens. No sequence waits for another, so a batch takes as many rounds as its sequence
with the most different merges.

Results for special input: a null or empty text has 0 bytes and 0 tokens; a null or repeated
doc_id gives a row each; strings of special tokens inside a text count as one token, as the
library does by default; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pairloom.llm.common import map_batches, slices, utf8
from pairloom.llm.encoding import _shown_bytes

#: Distinct strings whose counts a worker remembers; beyond it the memory is emptied. Changes the speed only.
REMEMBERED = 500_000
#: Symbols merged together at most, if no single pre-token is longer.
BATCH_SYMBOLS = 1 << 19
#: Fixed value: how byte-level vocabularies of this kind cut a text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int32).max


#: A space behind white space, in UTF-8.
SPACED = re.compile(rb"(?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80) ")


class PairRanks:
    """Rank and result of each mergeable pair, found by two open hash tables without probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, result: np.ndarray):
        self.keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.result = np.append(result, 0).astype(np.int32)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        rest, odd = np.arange(len(self.keys)), 0x9E3779B97F4A7C15
        while len(rest):
            mult = np.uint64(odd)
            at = self._slot(self.keys[rest], mult)
            table = np.full(1 << 20, -1, np.int32)
            table[at[::-1]] = rest[::-1]
            self.tables.append((mult, table))
            rest = rest[table[at] != rest]
            odd = (odd * 6364136223846793005 + 1442695040888963407) % 2**64 | 1

    @staticmethod
    def _slot(keys: np.ndarray, mult: np.uint64) -> np.ndarray:
        return ((keys * mult) >> np.uint64(44)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        for mult, table in self.tables:
            got = table[self._slot(keys, mult)]
            hit = (got >= 0) & (self.keys[got] == keys)
            out[hit] = got[hit]
        return out


class RankMerger:
    """Symbols that survive merging, for byte-level vocabularies without end-of-word marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, pre = parts["model"], parts["pre_tokenizer"]
        if parts["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("end_of_word_suffix"):
            raise ValueError("only byte-level vocabularies with the usual pre-tokens are counted here")
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairRanks(*(np.array([vocab[x] for x in column]) for column in (*zip(*merges, strict=True), [a + b for a, b in merges])))
        shown = _shown_bytes()
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = [x["content"] for x in parts["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[bytes, int] = {}
        self.tokens: dict[str, int] = {}

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (in bytes) once nothing can be merged."""
        out = np.zeros(len(words), np.int64)
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size == 0 or size + len(words[end]) <= BATCH_SYMBOLS):
                size += len(words[end])
                end += 1
            out[at:end] = self._merge(words[at:end])
            at = end
        return out

    def _merge(self, words: list[bytes]) -> np.ndarray:
        counts = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        same = owner[:-1] == owner[1:]
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair that begins at the symbol
        rank[:-1][same] = self.pairs.ranks(symbols[:-1][same], symbols[1:][same])
        best = np.empty(len(words), np.int32)
        while len(symbols):
            best.fill(NONE)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best[owner[first]] = np.minimum.reduceat(rank, first)
            live = best[owner] != NONE
            if not live.all():  # finished sequences leave the array; counts has what is left of them
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best[owner])
            # Of overlapping pairs (a a a), every second one from the left, inside each run.
            new_run = np.diff(hit, prepend=-2) != 1
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbols[hit] = self.pairs.result[rank[hit]]
            np.subtract.at(counts, owner[hit], 1)
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay)[hit] - 1
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            last = again == len(symbols) - 1
            rank[again[last]] = NONE
            again = again[~last]
            inside = owner[again] == owner[again + 1]
            rank[again[~inside]] = NONE
            again = again[inside]
            rank[again] = self.pairs.ranks(symbols[again], symbols[again + 1])
        return counts

    def _pieces(self, text: bytes) -> tuple[list[bytes], int]:
        """Parts of the text whose counts add up to the text's, and the special tokens between them.

        A pre-token takes a space only at its front, so a text can be cut in front of any space
        that follows a non-space. Where a space follows white space, the pattern looks ahead;
        texts in which one does are cut by the pattern itself.
        """
        special = 0
        if self.cut and any(s.encode() in text for s in self.special):
            found = self.cut.split(text.decode("utf-8"))
            special = len(found) - 1
            out: list[bytes] = []
            for part in found:
                out += self._pieces_plain(part.encode("utf-8"))
            return out, special
        return self._pieces_plain(text), 0

    def _pieces_plain(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        if SPACED.search(text):
            return [x.encode("utf-8") for x in self.pattern.findall(text.decode("utf-8"))]
        head, *rest = text.split(b" ")
        return ([head] if head else []) + [b" " + x for x in rest]

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each UTF-8 text."""
        cut = [self._pieces(t) for t in texts]
        known = self.known
        every = {p for pieces, _ in cut for p in pieces}
        if new := every.difference(known):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = every
            self._learn(new)
        return [sum(map(known.__getitem__, pieces)) + special for pieces, special in cut]

    def _learn(self, pieces: set[bytes]) -> None:
        listed = list(pieces)
        parts = [self.pattern.findall(p.decode("utf-8")) for p in listed]
        new = list({w for ws in parts for w in ws}.difference(self.tokens))
        if len(self.tokens) + len(new) > REMEMBERED:
            self.tokens.clear()
            new = list({w for ws in parts for w in ws})
        self.tokens |= zip(new, self.surviving([w.encode("utf-8") for w in new]).tolist(), strict=True)
        got = self.tokens.__getitem__
        self.known |= {p: sum(map(got, ws)) for p, ws in zip(listed, parts, strict=True)}


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """This worker's merger of the file, kept from task to task."""
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 512):
                texts = utf8(part.column(1))
                n = np.array(merge.count(texts), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs, [id_column, text_column], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", run)
