"""Batched token ids from a public tokenizer file, one library call for each distinct word.

The library's result for a text is the concatenation of its results for the text's
white-space-separated words if the normaliser and the pre-tokenizer never look across
white space and drop it. WordEncoder checks the file for this and, where it does not
hold, encodes whole texts instead. Either way the ids are the library's.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata

import numpy as np

#: Distinct words a worker remembers; beyond it the memory is emptied. Changes the speed only.
REMEMBERED = 1_000_000


def _shown_bytes() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a character: itself where it is printable, else the next one from U+0100."""
    shown = {b: chr(b) for span in ((33, 127), (161, 173), (174, 256)) for b in range(*span)}
    hidden = [b for b in range(256) if b not in shown]
    return shown | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids (without special tokens) as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_word = self._splits_at_space(parts)
        self.model = self.library.model
        self.shown = _shown_bytes()
        self.ends = dict(zip((b",", b"."), self._encode([b",", b"."]), strict=True))
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _splits_at_space(parts: dict) -> bool:
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norm = {x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])}
        drops = any(x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and r"[^\s" in x["pattern"].get("Regex", "") for x in steps)
        local = not any(x.get("lstrip") or x.get("rstrip") or " " in x["content"] for x in parts["added_tokens"])
        return drops and local and norm == {"NFC", "Replace", "Lowercase"} and all("<" in x["content"] for x in parts["added_tokens"])

    def _encode(self, words: list[bytes]) -> list[bytes]:
        got = self.library.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in got]

    def _model_ids(self, word: bytes) -> bytes | None:
        """A composed, case-folded word of letters is one pre-token, which goes straight to the library's model; None for others."""
        text = word.decode("utf-8")
        if not text.isalpha():
            return None
        if not text.isascii():
            if text.lower() != text or not unicodedata.is_normalized("NFC", text):
                return None
            text = "".join([self.shown[b] for b in word])
        ids = [x.id for x in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[bytes]) -> None:
        """Add the words; a comma or full stop after a letter (that stays one in lower case) is a token run of its own, so it is split off first."""
        known = self.known
        if len(known) + 2 * len(words) > REMEMBERED:
            known.clear()
        rest: list[bytes] = []
        for w in words:
            if b"<" in w:  # may hold a special token, which is matched before the text is folded
                rest.append(w)
                continue
            key = end = w.lower()
            if key[-1] in b",." and len(key) > 1 and (key[-2:-1].isalpha() or key[-2] >= 0x80 and key[:-1].decode("utf-8")[-1].lower()[-1].isalpha()):
                key, end = key[:-1], key[-1:]
            if (ids := known.get(key)) is None:
                if (ids := self._model_ids(key)) is None:
                    rest.append(w)
                    continue
                known[key] = ids
            known[w] = ids if key is end else ids + self.ends[end]
        for w, ids in zip(rest, self._encode(rest), strict=True):
            known[w] = ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text."""
        if not self.by_word:
            return self._encode(texts)
        out = []
        for text in texts:
            words = text.split()
            if missing := set(words).difference(self.known):
                self._learn(missing if len(self.known) + 2 * len(missing) <= REMEMBERED else set(words))
            out.append(b"".join(map(self.known.__getitem__, words)))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of the file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
