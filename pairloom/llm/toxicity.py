"""Toxicity: a learned lexicon, matched with typing errors, and scores of what stands around it.

Lexicon. From half of a labelled sample come the words of any length, and word beginnings of 3 to
8 letters, that stand almost only in toxic documents; of a chain of beginnings the longest that still has
most of the documents is kept. They form a trie.

Matching. The trie is intersected with the Levenshtein automaton of each word looked up: a
state is a set of (trie node, errors so far), one step for a character follows the matching
child, or with one more error another child (substitution), the same node (insertion) or a
grandchild (deletion). States are made when first met and kept with their steps, so the
intersection becomes a deterministic automaton that leaves most words after a few characters.
Entries of at least FUZZY_LENGTH characters may have one error. Inexact forms that the sample's
clean documents contain are ordinary words and don't count.

Context. Each occurrence is looked at in a window of its text: marks of quotation and words of
reporting make it a mention, others an attack. Numbers of exact and inexact attacks and
mentions go to a logistic regression, fitted on the sample's other half.

Results for special input: a null or empty text has no match and the score of such a text; a
null or repeated doc_id gives a row each; without labels of both kinds every score is 0; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import keep_rows, slices
from pairloom.llm.labelled import SAMPLE_ROWS, adam, held_out, labelled_sample, sigmoid
from pairloom.plans.scratch import materialise

WORD = re.compile(r"\w+")
END = "$"
#: Letters of the shortest term and of the longest beginning.
SHORTEST, LONGEST = 3, 8
FUZZY_LENGTH = 5
#: Characters on each side of a match that its context covers.
AROUND = 48
#: Words whose match a worker remembers; beyond it the memory is emptied. Changes the speed only.
REMEMBERED = 200_000
QUOTES = re.compile("[\"“”„«»‘‹›]")
#: Verbs and nouns of reporting in the languages of the documents.
REPORTING = re.compile(r"\b(?:said|says|quote[ds]?|wrote|called|term|word|slur|sagte|schrieb|zitat|zitiert|wort|dit|cite|citation|mot|dijo|cita|palabra)\b")
N_FEATURES = 7


class Lexicon:
    """Entries (beginnings, or whole words ending in END) with weights, and the automaton of words near them."""

    def __init__(self, entries: dict[str, float], benign: frozenset[str] = frozenset()):
        self.entries, self.benign = entries, benign
        self.child: list[dict[str, int]] = [{}]
        self.beginning: dict[int, tuple[float, bool]] = {}  # node: weight, whether it may have an error
        self.whole: dict[int, tuple[float, bool]] = {}
        for entry, weight in entries.items():
            node, text = 0, entry.rstrip(END)
            for c in text:
                if c not in self.child[node]:
                    self.child.append({})
                    self.child[node][c] = len(self.child) - 1
                node = self.child[node][c]
            (self.whole if entry.endswith(END) else self.beginning)[node] = (weight, len(text) >= FUZZY_LENGTH)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, float, float, float]] = []
        self.start = self._state({(0, 0)})
        self.known: dict[str, tuple[int, float]] = {}

    def _state(self, raw: set[tuple[int, int]]) -> int:
        closed = set(raw)
        for node, errors in raw:  # a character of the entry left out
            if not errors:
                closed.update((n, 1) for n in self.child[node].values())
        key = frozenset(closed)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            best = [-1.0] * 4  # beginning exact, beginning with an error, whole exact, whole with an error
            for node, errors in key:
                for at, table in ((0, self.beginning), (2, self.whole)):
                    weight, fuzzy = table.get(node, (-1.0, False))
                    if not errors or fuzzy:
                        best[at + errors] = max(best[at + errors], weight)
            self.ends.append(tuple(best))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, errors in self.sets[state]:
            if (n := self.child[node].get(c)) is not None:
                out.add((n, errors))
            if not errors:
                out.add((node, 1))
                out.update((n, 1) for n in self.child[node].values())
        to = self._state(out) if out else -1
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, float]:
        """(0, 0) for no match, else (1 exact or 2 inexact, weight of the best entry)."""
        if (got := self.known.get(word)) is not None:
            return got
        exact = fuzzy = -1.0
        state = self.start
        for c in word:
            state = self.steps[state].get(c, -2) if self.steps[state].get(c, -2) != -2 else self._step(state, c)
            if state < 0:
                break
            ends = self.ends[state]
            exact, fuzzy = max(exact, ends[0]), max(fuzzy, ends[1])
        if state >= 0:
            ends = self.ends[state]
            exact, fuzzy = max(exact, ends[2]), max(fuzzy, ends[3])
        got = (1, exact) if exact >= 0 else (2, fuzzy) if fuzzy >= 0 and word not in self.benign else (0, 0.0)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = got
        return got


def terms(text: str) -> set[str]:
    """Whole words and beginnings of a text."""
    words = set(WORD.findall(text.lower()))
    out = {w + END for w in words if len(w) >= SHORTEST}
    for k in range(SHORTEST, LONGEST + 1):
        out |= {w[:k] for w in words if len(w) >= k}
    return out


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries from the numbers of toxic and clean documents that hold each term."""
    least = max(4, round(0.004 * toxic))

    def weight(p: int, n: int) -> float:
        return log((p + 0.5) / (toxic + 1)) - log((n + 0.5) / (clean + 1))

    def pure(p: int, n: int) -> bool:
        return p >= least and p >= 15 * n

    kept: dict[str, float] = {}
    best_below: dict[str, int] = Counter()
    for t, (p, n) in counts.items():
        if pure(p, n) and len(t) > SHORTEST:
            best_below[t[:-1]] = max(best_below[t[:-1]], p)
    done: set[str] = set()
    for t in sorted((t for t, c in counts.items() if pure(*c)), key=lambda t: (len(t), t)):
        if any(t[:k] in done for k in range(SHORTEST, len(t))):
            continue
        p, n = counts[t]
        if best_below[t] >= 0.95 * p and not t.endswith(END):
            continue  # a longer beginning says the same
        kept[t] = weight(p, n)
        done.add(t)
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Numbers of exact and inexact attacks and mentions of a whole text, and the weight of the strongest."""
    low = text.lower()
    words = WORD.findall(low)
    found = {w: m for w in set(words) if (m := lexicon.match(w))[0]}
    out = [0.0] * N_FEATURES
    if not found:
        return out
    kinds = [0, 0, 0, 0]
    strongest = 0.0
    for m in WORD.finditer(low):
        if (got := found.get(m[0])) is None:
            continue
        before, after = low[max(0, m.start() - AROUND) : m.start()], low[m.end() : m.end() + AROUND]
        quoted = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None
        mention = quoted or REPORTING.search(before) is not None
        kinds[2 * mention + got[0] - 1] += 1
        strongest = max(strongest, got[1] if got[0] == 1 else got[1] / 2)
    for k, n in enumerate(kinds):
        out[k] = log(1 + n)
    out[4] = float(kinds[0] > 0)
    out[5] = strongest
    out[6] = 100.0 * (kinds[0] + kinds[1]) / len(words)
    return out


class Toxicity:
    """A lexicon and the weights of its features; the last weight is the constant."""

    def __init__(self, entries: dict[str, float], benign: frozenset[str], weights: np.ndarray, scale: np.ndarray):
        self.entries, self.benign, self.weights, self.scale = entries, benign, weights, scale
        self.lexicon: Lexicon | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lexicon": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.entries, self.benign)
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, N_FEATURES) / self.scale
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _term_counts(sample: DataFrame, half: int) -> tuple[dict[str, tuple[int, int]], int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes: Counter[str] = Counter()
        no: Counter[str] = Counter()
        docs = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (yes if y else no).update(terms(text or ""))
                docs[y] += 1
        names = [*yes, *(no.keys() & yes.keys()), ""]
        p = [yes[t] for t in yes] + [0] * (len(names) - len(yes) - 1) + [docs[1]]
        n = [0] * len(yes) + [no[t] for t in names[len(yes) : -1]] + [docs[0]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(p, pa.int64()), pa.array(n, pa.int64())], ["term", "p", "n"])
        rest = [t for t in no if t not in yes]
        for at in range(0, len(rest), 100_000):
            part = rest[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64()), pa.array([no[t] for t in part], pa.int64())], ["term", "p", "n"])

    own = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == half)
    got = own.select("text", "y").mapInArrow(run, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = got.where("term = ''").first()
    rows = got.where("p >= 4 AND p >= 15 * n AND term <> ''").collect()  # terms of a bounded sample
    return {r.term: (r.p, r.n) for r in rows}, total.p if total else 0, total.n if total else 0


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> Toxicity:
    """Fit lexicon and weights on a bounded sample of labelled rows."""
    sample = materialise(labelled_sample(docs, labels, label, rows=rows, id_column=id_column, text_column=text_column).select("doc_id", "text", "y"), "labelled")
    counts, toxic, clean = _term_counts(sample, 0)
    entries = choose(counts, toxic, clean)

    def benign_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        found: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found |= {w for w in set(WORD.findall((text or "").lower())) if lexicon.match(w)[0] == 2}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    first, second = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == half for half in (0, 1))
    forms = sample.where(first & (F.col("y") == 0)).select("text").mapInArrow(benign_forms, "word string").distinct().collect() if entries else []
    benign = frozenset(r.word for r in forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries, benign)
        for batch in batches:
            x = [features(t or "", lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sample.where(second).mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(got.x.tolist(), float).reshape(len(got), N_FEATURES), got.y.to_numpy(float)
    scale = np.maximum(x.max(axis=0, initial=0), 1e-9)
    if not len(y) or y.min() == y.max():
        return Toxicity(entries, benign, np.array([0.0] * N_FEATURES + [-500.0]), scale)
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    ridge = np.array([1e-4] * N_FEATURES + [0.0])
    weights = adam(lambda _, w: z.T @ (sigmoid(z @ w) - y) / len(y) + ridge * w, N_FEATURES + 1, 1500, 0.05)
    return Toxicity(entries, benign, weights, scale)


def score_toxicity(docs: DataFrame, model: Toxicity, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_column), F.col(text_column), held_out(id_column).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Toxicity, *, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    return keep_rows(docs, text_column, lambda texts: (model.score([t.decode("utf-8") for t in texts]) < threshold).tolist())
