"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Words are mapped to classes: the most frequent words are classes of their own, the text end is
one, and all other words, known or not, share the rare classes by their last three bytes. The
numbers of both follow the square root of the training vocabulary (`shape`), so what the model
tells apart grows with the corpus. A word's class is predicted from the classes of the two
words before it (the end, at the front):

    q(h) = A1 r(h1) + A2 r(h2),   s(c, h) = q(h) . v(c) + b(c),   t(k, h) = q(h) . u(k) + g(k)

with representations r, v, u, a full matrix for each place of the context, and biases. Classes
lie in bands by frequency, the k-th of k + 1 classes. P(c | h) is the softmax of t over all
bands at c's band times the softmax of s over the classes of that band. Both are normalised
exactly by batched matrix products, whose cost for a token grows with the square root of the
number of classes. Within a rare class a word has its share of the class's smoothed training
count, and the unknown words of a class together have the share of one word never seen, so the
probabilities of all words add up to one.

Training passes over every token of every training document in numpy: each task starts from the
same parameters and takes steps of noise-contrastive estimation over its documents, with noise
drawn from the classes' and the bands' frequencies, one set for a batch, so a step is a few
matrix products. There are ROUNDS rounds over disjoint, growing shares of the documents; after
each, every parameter row becomes the mean of the tasks' rows weighted by how often each used it.
A corpus of fewer than LEAST tokens is passed over several times.

What reaches the driver: the words at hand and the parameters, both bounded by MOST classes, and
one number for each grade of frequency and each rare class. Word counts stay distributed. Counts
of words outside the `lookup` most frequent are joined by word, so no vocabulary is broadcast.

Results for special input: a null or empty text is one end token; a null doc_id counts as the
empty text in the split and is held out; a null or repeated doc_id gives a row each; without
training documents no word is known and classes have the model's first, random parameters; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import give_back, slices_of_bytes
from pairloom.llm.labelled import held_out
from pairloom.plans.scratch import materialise

#: Words with classes of their own for each square root of a distinct word, the bound of their number (reached at 10^9
#: distinct words), rare classes as a share of them, and words whose counts every task has at hand at least.
PER_ROOT, MOST, RARE_SHARE, LOOKUP = 8, 1 << 18, 1 / 16, 1 << 18
DIM, ROUNDS, BATCH, NOISE, BAND_NOISE = 32, 4, 2048, 128, 32
#: Tokens that training visits at least, tokens a training task has at least (so that fewer parameters are merged), and tokens shuffled at once.
LEAST, PART_TOKENS, SHUFFLED = 6_000_000, 4_000_000, 1 << 18
#: Parameter rows that are merged as one, and distinct tokens scored at once.
MERGED, TOGETHER = 1024, 1 << 20
#: Rows of a matrix product in scoring, few enough to stay in a core's cache; bands whose exponentials are at hand at once, and the largest of these.
BLOCK, COLUMNS, RANGE = 1024, 64, 40
#: Bytes of the texts that are cut into words at once, and in scoring, where more tokens are equal in longer parts.
TEXT_BYTES, SCORED_BYTES = 2 << 20, 4 << 20
#: Words and their counts that a task holds before it sums them and passes them on.
COUNTED = 600_000
SMOOTH = 0.1
LN10 = float(np.log(10.0))


def shape(distinct: int) -> tuple[int, int]:
    """Numbers of words with classes of their own and of rare classes for a vocabulary of that size."""
    head = int(min(MOST, max(256, PER_ROOT * distinct**0.5)))
    return head, max(16, int(head * RARE_SHARE))


def rare_class(word: bytes, head: int, rare: int) -> int:
    return head + zlib.crc32(word[-3:]) % rare


def band_of(classes: np.ndarray) -> np.ndarray:
    """The band of each class: band k begins at class k (k + 1) / 2."""
    return ((np.sqrt(8.0 * classes + 1) - 1) / 2).astype(np.int64)


def band_starts(n: int) -> np.ndarray:
    """First class of each band of n classes, and n."""
    bands = int(band_of(np.array([n - 1]))[0]) + 1
    k = np.arange(bands)
    return np.append(k * (k + 1) // 2, n)


@dataclass(frozen=True)
class Vocabulary:
    """Training counts of the words at hand (the first `head` have classes of their own; b'' is the text's end) and totals."""

    words: list[bytes]
    counts: np.ndarray
    head: int
    rare: int
    tokens: int
    distinct: int
    rare_mass: np.ndarray

    @property
    def classes(self) -> int:
        return self.head + self.rare

    def tables(self) -> tuple[pa.Array, np.ndarray]:
        """The words at hand in order, and the class of each; the last class entry is for places of -1."""
        words = pa.array(self.words, pa.binary())
        return words.cast(pa.string()), np.concatenate([np.arange(self.head), self.by_ending(words[self.head :]), [-1]]).astype(np.int64)

    def by_ending(self, words: pa.Array) -> np.ndarray:
        """The rare classes of some words; each different ending is looked at once."""
        endings = pc.binary_slice(words, -3).dictionary_encode()
        of = np.array([rare_class(x, self.head, self.rare) for x in endings.dictionary.to_pylist()], np.int64)
        return of[endings.indices.to_numpy()]

    def of_classes(self) -> Vocabulary:
        """What training needs: only the words with classes of their own are looked up, all others go by their last bytes anyway."""
        return replace(self, words=self.words[: self.head], counts=self.counts[: self.head])

    def class_mass(self) -> np.ndarray:
        """Smoothed training count of each class."""
        return np.concatenate([self.counts[: self.head] + SMOOTH, self.rare_mass])


@dataclass(frozen=True)
class LogBilinear:
    """r: representations of context classes; v, b: of predicted classes; u, g: of bands; a: the two context matrices."""

    r: np.ndarray
    v: np.ndarray
    b: np.ndarray
    u: np.ndarray
    g: np.ndarray
    a: np.ndarray

    @classmethod
    def start(cls, mass: np.ndarray, dim: int = DIM, seed: int = 0) -> LogBilinear:
        rng = np.random.default_rng(seed)
        n = len(mass)
        share = mass / mass.sum()
        starts = band_starts(n)
        bands = np.add.reduceat(share, starts[:-1])
        draw = lambda k: (0.1 * rng.standard_normal((k, dim))).astype(np.float32)
        a = np.stack([np.eye(dim), 0.5 * np.eye(dim)]).astype(np.float32)
        return cls(draw(n), draw(n), np.log(share).astype(np.float32), draw(len(bands)), np.log(bands).astype(np.float32), a)

    def log_prob(self, second: np.ndarray, first: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Natural log of P(now | the class before, the class before that), by batched matrix products.

        Equal triples are worked out once, and the softmax over bands once for each different context.
        """
        n = len(self.b)
        triples, back = np.unique((second * n + first) * n + now, return_inverse=True)
        out = np.empty(len(triples))
        last = lambda x, y: np.hstack([x, np.full((len(x), 1), y, np.float32)])
        r1, r2 = last(self.r @ self.a[0], 0), last(self.r @ self.a[1], 1)  # their sum is q and a one for the biases
        u, v = np.hstack([self.u, self.g[:, None]]).T.copy(), np.hstack([self.v, self.b[:, None]])
        starts = band_starts(n).tolist()
        for x in range(0, len(triples), TOGETHER):
            pairs, c = np.divmod(triples[x : x + TOGETHER], n)
            h2, h1 = np.divmod(pairs, n)
            begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            own = -np.repeat(_log_sums(r1, r2, h1[begin], h2[begin], u), np.diff(begin, append=len(pairs)))
            band = band_of(c)
            by = np.argsort(band.astype(np.uint16), kind="stable")
            bounds = np.searchsorted(band[by], np.arange(u.shape[1] + 1)).tolist()
            for k, (low, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for y in range(low, end, BLOCK):
                    at = by[y : min(end, y + BLOCK)]
                    q = r1.take(h1[at], axis=0)
                    q += r2.take(h2[at], axis=0)
                    got = q @ u[:, k]
                    if k:
                        s = q @ v[starts[k] : starts[k + 1]].T
                        got += s[np.arange(len(s)), c[at] - starts[k]]
                        got -= _log_sum(s)
                    own[at] += got
            out[x : x + TOGETHER] = own
        return out[back]

    def rows(self) -> np.ndarray:
        """All parameters as rows of dim + 1 numbers."""
        pad = lambda x, y=None: np.hstack([x, np.zeros((len(x), 1), np.float32) if y is None else y[:, None]])
        return np.vstack([pad(self.r), pad(self.v, self.b), pad(self.u, self.g), pad(self.a.reshape(-1, self.a.shape[2]))])

    def of_rows(self, x: np.ndarray) -> LogBilinear:
        n, k, d = len(self.r), len(self.u), self.r.shape[1]
        r, v, u, a = np.split(x.astype(np.float32), [n, 2 * n, 2 * n + k])
        return LogBilinear(r[:, :d], v[:, :d], v[:, d], u[:, :d], u[:, d], a[:, :d].reshape(2, d, d))


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exp over each row, in place; by one shift for all rows, unless the rows lie too far apart."""
    ones = np.ones(x.shape[1], x.dtype)
    top = x.max()
    if top - x.min() < 50:
        x -= top
        return top + np.log(np.exp(x, out=x) @ ones)
    top = x.max(axis=1)
    x -= top[:, None]
    return top + np.log(np.exp(x, out=x) @ ones)


def _log_sums(r1: np.ndarray, r2: np.ndarray, h1: np.ndarray, h2: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Log of the sum over the columns of u of exp((r1[h1] + r2[h2]) @ u) for each pair of h1 and h2.

    exp(x + y) = exp(x) exp(y), so exponentials are taken for each row of r1 and r2 that occurs and not
    for each pair, unless they are so large or small that products could leave the range of the numbers.
    """
    (own1, at1), (own2, at2) = _places(h1, len(r1)), _places(h2, len(r2))
    x1, x2 = r1.take(own1, axis=0), r2.take(own2, axis=0)
    total = np.zeros(len(h1), np.float32)
    for k in range(0, u.shape[1], COLUMNS):
        both = x1 @ u[:, k : k + COLUMNS], x2 @ u[:, k : k + COLUMNS]
        if any(np.abs(t).max(initial=0) > RANGE for t in both):
            break
        e1, e2 = (np.exp(t, out=t) for t in both)
        for x in range(0, len(h1), BLOCK):
            total[x : x + BLOCK] += np.einsum("nk,nk->n", e1.take(at1[x : x + BLOCK], axis=0), e2.take(at2[x : x + BLOCK], axis=0))
    else:
        return np.log(total)
    for x in range(0, len(h1), BLOCK):
        total[x : x + BLOCK] = _log_sum((r1.take(h1[x : x + BLOCK], axis=0) + r2.take(h2[x : x + BLOCK], axis=0)) @ u)
    return total


def _places(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of some numbers below n in order, and the place of each among them."""
    there = np.zeros(n, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _order(classes: np.ndarray, n: int) -> np.ndarray:
    """The order of some of n classes; two bytes each, if they fit, are sorted by radix."""
    return np.argsort(classes.astype(np.uint16) if n <= 1 << 16 else classes, kind="stable")


def _sums(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of first to the next; two numbers at a time, if their number is even."""
    if g.shape[1] % 2:
        return np.add.reduceat(g, first, axis=0)
    return np.add.reduceat(g.view(np.complex64), first, axis=0).view(np.float32)


class Trainer:
    """Steps of noise-contrastive estimation on a copy of a model, with per-parameter step sizes; used counts the visits of each parameter row."""

    def __init__(self, model: LogBilinear, mass: np.ndarray, seed: int, rate: float = 0.1):
        self.rng, self.rate = np.random.default_rng(seed), rate
        self.dim = model.r.shape[1]
        self.r = model.r.copy()
        self.v = np.hstack([model.v, model.b[:, None]])
        self.u = np.hstack([model.u, model.g[:, None]])
        self.a = model.a.reshape(-1, self.dim).copy()
        self.seen = [np.full_like(x, 0.1) for x in (self.r, self.v, self.u, self.a)]
        self.used = [np.zeros(len(x)) for x in (self.r, self.v, self.u)]
        share = mass / mass.sum()
        bands = np.add.reduceat(share, band_starts(len(mass))[:-1])
        self.noise = [(np.cumsum(p), np.log(p * k).astype(np.float32), k) for p, k in ((share, NOISE), (bands, BAND_NOISE))]
        self.band = band_of(np.arange(len(mass)))
        self.steps = 0

    def _descend(self, place: int, x: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
        """Sum the gradients of the same row (at is in order), and move each row by them."""
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        first = np.flatnonzero(new)
        own = at[first]
        g = (_sums(g, first) if len(own) < len(at) else g)[:, : x.shape[1]]  # g may have a column more than x
        s = self.seen[place].take(own, axis=0)
        s += g * g
        self.seen[place][own] = s
        g /= np.sqrt(s, out=s)
        g *= self.rate
        x[own] = x.take(own, axis=0) + g

    def _contrast(self, q: np.ndarray, table: np.ndarray, place: int, now: np.ndarray) -> np.ndarray:
        """Update one set of outputs; the gradient for q, which ends in a column of ones. now is in order."""
        cumulative, log_noise, n = self.noise[place - 1]
        k, drawn = np.unique(np.minimum(np.searchsorted(cumulative, self.rng.random(n)), len(cumulative) - 1), return_counts=True)
        drawn = drawn.astype(np.float32)[:, None]  # equal draws are worked out once
        self.used[place][k] += drawn[:, 0]
        w, x = table.take(now, axis=0), table.take(k, axis=0)
        up = _sigmoid(log_noise.take(now) - np.einsum("nd,nd->n", q, w))[:, None]  # 1 - P(data)
        lower = -x
        lower[:, -1] += log_noise.take(k)  # q ends in ones
        down = q @ lower.T
        np.exp(down, out=down)
        down += 1
        np.divide(1, down, out=down)  # P(data) of noise
        width = q.shape[1]
        g = np.empty((len(now), width + width % 2), np.float32)
        np.multiply(up, q, out=g[:, :width])
        g[:, width:] = 0
        w *= up
        w -= down @ (drawn * x)
        self._descend(place, table, now, g)
        self._descend(place, table, k, (down.T @ q) * -drawn)
        return w

    def step(self, second: np.ndarray, first: np.ndarray, now: np.ndarray) -> None:
        n, by = len(now), _order(now, len(self.v))
        now, context = now[by], np.stack([first[by], second[by]], axis=1)
        r = self.r.take(context, axis=0).reshape(n, 2 * self.dim)
        q = np.ones((n, self.dim + 1), np.float32)
        q[:, :-1] = r @ self.a
        gq = self._contrast(q, self.v, 1, now)
        gq += self._contrast(q, self.u, 2, self.band.take(now))
        gq = gq[:, :-1]
        at, g = context.ravel(), (gq @ self.a.T).reshape(2 * n, self.dim)
        by = _order(at, len(self.r))
        self._descend(0, self.r, at[by], g.take(by, axis=0))
        g = r.T @ gq
        self.seen[3] += g * g
        self.a += 0.05 * self.rate * g / np.sqrt(self.seen[3])
        self.steps += 1

    def learn(self, second: np.ndarray, first: np.ndarray, now: np.ndarray) -> None:
        """Steps over all the tokens, in a random order."""
        order = self.rng.permutation(len(now))
        with np.errstate(over="ignore"):
            for part in np.array_split(order, -(-len(order) // BATCH)) if len(order) else []:
                self.step(second[part], first[part], now[part])
        for place, at in ((0, first), (0, second), (1, now), (2, self.band[now])):
            self.used[place] += np.bincount(at, minlength=len(self.used[place]))

    def model(self) -> LogBilinear:
        return LogBilinear(self.r, self.v[:, :-1], self.v[:, -1], self.u[:, :-1], self.u[:, -1], self.a.reshape(2, self.dim, self.dim))

    def weighted_rows(self) -> np.ndarray:
        """Parameter rows times how often each was used, and that number as the last column."""
        n = np.concatenate([*self.used, np.full(2 * self.dim, float(self.steps))]).astype(np.float32)[:, None]
        return np.hstack([self.model().rows() * n, n])


def _training(docs: DataFrame, id_column: str, text_column: str, folds: int) -> DataFrame:
    return docs.where(~held_out(id_column, folds)).select(text_column)


@dataclass(frozen=True)
class Words:
    """The words of some texts: the distinct ones, and each text's as places among them."""

    distinct: pa.Array
    codes: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Lower-case (A-Z) runs of anything but ASCII white space."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        coded = lists.flatten().dictionary_encode()
        codes, sizes = coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        empty = pc.index(coded.dictionary, "").as_py()  # beside white space at a text's ends
        if empty >= 0:
            there = codes != empty
            sizes = np.diff(np.append(0, np.cumsum(there))[np.append(0, np.cumsum(sizes))])
            codes = codes[there]
        return cls(coded.dictionary, codes, sizes)

    def counts(self) -> pa.Table:
        n = np.bincount(self.codes, minlength=len(self.distinct))
        return pa.table({"word": self.distinct, "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0))


def word_counts(docs: DataFrame, text_column: str) -> DataFrame:
    """word and n over all rows; the empty word is the text end. Tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = waiting = 0

        def summed() -> pa.Table:
            total = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return total.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for part in slices_of_bytes(batch, 0, TEXT_BYTES):
                ends += part.num_rows
                held.append(Words.of(part.column(0)).counts())
                waiting += held[-1].num_rows
                if waiting > COUNTED:
                    held, waiting = [summed()], 0
                    if held[0].num_rows > COUNTED:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held = []
        if held:
            yield from summed().to_batches(max_chunksize=1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends], pa.int64())], ["word", "n"])
        held.clear()
        give_back()

    counted = docs.select(text_column).mapInArrow(run, "word string, n long").repartition("word")  # no use in grouping a task's words again before
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def vocabulary(counts: DataFrame, head: int | None = None, rare: int | None = None, lookup: int = LOOKUP) -> Vocabulary:
    """Totals, the most frequent words (whole grades of frequency, `lookup` words or the number of classes at most), and the mass of each rare class."""
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    by_size = shape(total.distinct or 0)
    head, rare = head or by_size[0], rare or by_size[1]
    lookup = max(lookup, head)
    end = counts.where("word = ''").first()
    counts = counts.where("word <> ''")
    grade = F.floor(F.log2("n") * 256)  # grades of frequency, so few that they are counted in one place
    sizes = sorted((tuple(x) for x in counts.groupBy(grade).count().collect()), reverse=True)
    fits = [g for (g, _), upto in zip(sizes, accumulate(n for _, n in sizes), strict=True) if upto < lookup]
    top = counts.where(grade >= F.lit(fits[-1])).collect() if fits else []
    top.sort(key=lambda x: (-x.n, x.word))
    words = [b"", *(x.word.encode() for x in top)]  # the end is class 0, with its own count
    number = np.array([end.n if end else 0, *(x.n for x in top)], np.float64)
    head = min(head, len(words))
    own = [(x.word,) for x in top[: head - 1]]
    if own:
        counts = counts.join(F.broadcast(counts.sparkSession.createDataFrame(own, "word string")), "word", "left_anti")
    ending = F.expr("CASE WHEN octet_length(word) < 3 THEN CAST(word AS BINARY) ELSE substring(CAST(word AS BINARY), -3, 3) END")
    got = counts.groupBy((F.crc32(ending) % rare).alias("c")).agg(F.sum(F.col("n") + F.lit(SMOOTH)).alias("m")).collect()
    mass = np.full(rare, SMOOTH)
    for x in got:
        mass[x.c] += x.m
    return Vocabulary(words, number, head, rare, int(total.tokens or 0), int(total.distinct or 0), mass)


class Sequences:
    """The classes of some texts' words, one text after another, each with its end behind its words."""

    def __init__(self, texts: pa.Array, vocab: Vocabulary, tables: tuple[pa.Array, np.ndarray]):
        at_hand, of = tables
        self.words = Words.of(texts)
        self.place = pc.fill_null(pc.index_in(self.words.distinct, value_set=at_hand), -1).to_numpy().astype(np.int64)  # -1: not at hand
        classes = of[self.place]
        away = np.flatnonzero(self.place < 0)
        classes[away] = vocab.by_ending(self.words.distinct.take(pa.array(away)).cast(pa.binary()))
        sizes, codes = self.words.sizes, self.words.codes
        ends = np.cumsum(sizes + 1)
        self.starts = np.append(0, ends[:-1])
        self.is_word = np.ones(len(codes) + len(sizes), bool)
        self.is_word[ends - 1] = False
        self.classes = classes
        self.now = np.zeros(len(self.is_word), np.int64)
        self.now[self.is_word] = classes[codes]

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word and end: the class before the one before, the class before, and the class; ends stand at the front."""
        first, second = np.zeros_like(self.now), np.zeros_like(self.now)
        first[1:], second[2:] = self.now[:-1], self.now[:-2]  # before a text stands the end of another
        second[self.starts] = 0
        return second, first, self.now

    def sums(self, of_word: np.ndarray, of_end: float) -> np.ndarray:
        """A number for each distinct word, summed over each text and its end."""
        each = np.full(len(self.now), of_end, of_word.dtype)
        each[self.is_word] = of_word[self.words.codes]
        return np.add.reduceat(each, self.starts)

    def far(self) -> tuple[pa.Array, np.ndarray]:
        """For each text its words that are not at hand with how often each occurs, and how many they are."""
        n, rows = len(self.place), len(self.words.sizes)
        away = self.place[self.words.codes] < 0
        row = np.repeat(np.arange(rows), self.words.sizes)[away]
        key, count = np.unique(row * n + self.words.codes[away], return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(rows + 1) * n), pa.int32())
        words = pa.StructArray.from_arrays([self.words.distinct.take(pa.array(key % max(1, n))), pa.array(count, pa.int64())], ["word", "k"])
        return pa.ListArray.from_arrays(ends, words), np.bincount(row, minlength=rows)


def _train_task(shared, passes: int, turn: int):
    """What a task does with its documents in one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        vocab, model, rate = shared.value
        tables = vocab.tables()
        trainer = Trainer(model, vocab.class_mass(), 10_000 * turn + TaskContext.get().partitionId(), rate)
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def learn() -> None:
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            for _ in range(passes):
                trainer.learn(*arrays)
            held.clear()

        for batch in batches:
            for part in slices_of_bytes(batch, 0, TEXT_BYTES):
                context = Sequences(part.column(0), vocab, tables).contexts()
                for at in range(0, len(context[0]), SHUFFLED):
                    held.append(tuple(x[at : at + SHUFFLED] for x in context))
                    waiting += len(held[-1][0])
                    if waiting >= SHUFFLED:
                        learn()
                        waiting = 0
        if held:
            learn()
        if trainer.steps:
            rows = trainer.weighted_rows()
            parts = [rows[at : at + MERGED].astype("<f4").tobytes() for at in range(0, len(rows), MERGED)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["slice", "sums"])

    return run


def _merge_task(width: int):
    """Sum the tasks' weighted rows, one batch after another; the weighted means and the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(blob.as_buffer(), "<f4").reshape(-1, width).astype(np.float64)
                total[k] = total[k] + own if k in total else own
        for k, x in total.items():
            mean = np.hstack([x[:, :-1] / np.maximum(x[:, -1:], 1e-30), x[:, -1:]]).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["slice", "rows"])

    return run


def train(training: DataFrame, text_column: str, vocab: Vocabulary, *, rounds: int = ROUNDS, least: int = LEAST, rate: float = 0.1) -> LogBilinear:
    """Train over all tokens of all the rows; round t has 2 ** t shares of the documents, chosen by a hash of their text."""
    sc = training.sparkSession.sparkContext
    vocab = vocab.of_classes()
    model = LogBilinear.start(vocab.class_mass())
    passes = max(1, -(-least // max(1, vocab.tokens)))
    whole = (1 << rounds) - 1
    share = F.pmod(F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))), F.lit(whole))
    for turn in range(rounds):
        shared = sc.broadcast((vocab, model, rate * 0.7**turn))
        own = training.where((share >= (1 << turn) - 1) & (share < (2 << turn) - 1)).select(text_column)
        tasks = max(8, vocab.tokens * passes * (1 << turn) // whole // PART_TOKENS)
        width = model.r.shape[1] + 2
        parts = own.coalesce(tasks).mapInArrow(_train_task(shared, passes, turn), "slice int, sums binary")
        slices_ = -(-len(model.rows()) // MERGED)
        got = parts.repartition(slices_, "slice").mapInArrow(_merge_task(width), "slice int, rows binary").collect()
        shared.unpersist()
        rows = model.rows()
        for x in got:
            new = np.frombuffer(x.rows, "<f4").reshape(-1, width)
            used = new[:, -1] > 0
            rows[x.slice * MERGED : x.slice * MERGED + len(new)][used] = new[used, :-1]
        model = model.of_rows(rows)
    return model


def score_texts(docs: DataFrame, *, folds: int = 10, id_column: str = "doc_id", text_column: str = "text", head: int | None = None, rare: int | None = None, lookup: int = LOOKUP, rounds: int = ROUNDS, least: int = LEAST) -> DataFrame:
    """Train on the rows that are not held out and score every row. head, rare: numbers of classes, by the vocabulary's size if not given."""
    sc = docs.sparkSession.sparkContext
    training = _training(docs, id_column, text_column, folds)
    counts = materialise(word_counts(training, text_column), "words")
    vocab = vocabulary(counts, head, rare, lookup)
    model = train(training, text_column, vocab, rounds=rounds, least=least)
    shared = sc.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        vocab, model = shared.value
        tables = vocab.tables()
        log_count = np.log10(vocab.counts + SMOOTH)
        within = log_count.copy()  # a word's share of its class; 0 for words that are a class
        within[: vocab.head] = 0
        within[vocab.head :] -= np.log10(vocab.rare_mass)[tables[1][vocab.head : -1] - vocab.head]
        log_mass = np.log10(vocab.rare_mass)
        known = (vocab.counts > 0).astype(np.int64)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices_of_bytes(batch, 1, SCORED_BYTES):
                seq = Sequences(part.column(1), vocab, tables)
                near = seq.place >= 0
                inside = np.where(near, within[seq.place], -log_mass[np.where(near, 0, seq.classes - vocab.head)])
                lp = np.add.reduceat(model.log_prob(*seq.contexts()), seq.starts) / LN10 + seq.sums(inside, within[0])
                counts = (seq.words.sizes + 1, seq.sums(np.where(near, known[seq.place], 0), known[0]), seq.sums(np.where(near, log_count[seq.place], 0.0), log_count[0]), lp)
                far, n_far = seq.far()
                rows = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), *map(pa.array, (rows, *counts, n_far)), far], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "lp", "n_far", "far"])

    schema = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, lp double, n_far long, far array<struct<word: string, k: long>>"
    rows = materialise(docs.select(F.col(id_column), F.col(text_column), held_out(id_column, folds).alias("held_out")).mapInArrow(run, schema), "scored")
    far = rows.where("n_far > 0").select("row", F.inline("far"))
    met = far.join(counts.where("n > 0").withColumnRenamed("n", "c"), "word")  # a word that was never seen meets nothing, however common it is
    gain = F.log10(F.col("c") + F.lit(SMOOTH)) - F.lit(float(np.log10(SMOOTH)))
    sums = met.groupBy("row").agg(F.sum("k").alias("far_known"), F.sum(F.col("k") * gain).alias("far_gain"))
    all_words = float(np.log10(vocab.tokens + SMOOTH * (vocab.distinct + 1)))
    extra = F.col("unseen") + F.coalesce("far_gain", F.lit(0.0))
    own = rows.withColumn("unseen", F.col("n_far") * F.lit(float(np.log10(SMOOTH)))).drop("far", "n_far")
    return own.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(all_words)).alias("base_score"),
        (F.col("lp") + extra).alias("score"),
    )
