"""Quality by pairwise ranking: a Bradley-Terry model over document features.

Preference pairs are drawn from a labelled sample, a document of label 1 over one of label 0.
P(a over b) = sigmoid(w . (x_a - x_b)), fitted by logistic loss on feature differences. The
features are shares and ratios of the whole text, each spread over quantile bins of the sample,
so that the ranking need not be monotone in any of them. The cut between the classes is the
quantile of the sample's scores that parts its labels best (mean of both classes' accuracy).
A score is the logistic function of the distance to that cut, moved so that the cut lies at
`threshold`.

Results for special input: a null or empty text has its own feature value, and a score; a null
or repeated doc_id gives a row each; without labels of both kinds every score is the threshold
(predicted 1), since nothing can be told apart; an empty table gives no row; other columns are
not read. Equal texts have equal scores; a value on a bin's edge belongs to the bin below, and a
score of exactly the threshold is predicted 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import keep_rows, slices, utf8
from pairloom.llm.labelled import SAMPLE_ROWS, adam, held_out, labelled_sample, sigmoid

MARKS = b".,;:!?|%#$&*@/\\<>{}[]()=+-_~^\"'"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
BINS = 10


def features(text: bytes) -> list[float]:
    """Numbers about a whole text, none of which grows with its length but the first two."""
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences = text.split(b". ")
    marks = len(text.translate(None, MARKS))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lengths = list(map(len, words))
    short = sum(x <= 3 for x in lengths)
    out = [
        log(1 + n),
        log(1 + k),
        n / k,
        len(counts) / k,
        max(counts.values()) / k,
        sum(c * c for c in counts.values()) / (k * k),
        pairs / max(1, k - 1),
        sum(map(bytes.__eq__, words, words[1:])) / k,
        (n - len(text.translate(None, _UPPER))) / n,
        (n - len(text.translate(None, _DIGITS))) / n,
        (n - marks) / n,
        (n - marks) / k,
        len(text.translate(None, bytes(range(128)))) / n,
        short / k,
        sum(x >= 12 for x in lengths) / k,
        max(lengths) / n,
        sum(map(bytes.isupper, words)) / k,
        sum(map(bytes.istitle, words)) / k,
        sum(map(bytes.isalpha, words)) / k,
        len(set(lines)) / max(1, len(lines)),
        len(lines) / k,
        len(set(sentences)) / len(sentences),
        len(sentences) / k,
    ]
    return out + [text.count(m) / k for m in SINGLE]


SINGLE = [MARKS[i : i + 1] for i in range(len(MARKS))]
N_FEATURES = 23 + len(SINGLE)


@dataclass(frozen=True)
class Ranking:
    """Bin edges (features x edges), weights by feature and bin, and the cut."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(x.shape[1]), bins(x, self.edges)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x) - self.cut + log(self.threshold / (1 - self.threshold)))


def bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return (x[:, :, None] > edges[None]).sum(axis=2)


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.3, pairs: int = 1024, steps: int = 600, seed: int = 0) -> Ranking:
    """Learn weights from preference pairs and choose the cut."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((N_FEATURES, BINS - 1))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(edges, np.zeros((x.shape[1], BINS)), 0.0, threshold)
    b = bins(x, edges) + np.arange(x.shape[1]) * BINS
    rng = np.random.default_rng(seed)

    def gradient(_: int, w: np.ndarray) -> np.ndarray:
        over, under = b[rng.choice(good, pairs)], b[rng.choice(bad, pairs)]
        miss = sigmoid(w[under].sum(axis=1) - w[over].sum(axis=1))[:, None] / pairs
        push = np.bincount(under.ravel(), np.broadcast_to(miss, under.shape).ravel(), len(w)) - np.bincount(over.ravel(), np.broadcast_to(miss, over.shape).ravel(), len(w))
        return push + 1e-4 * w

    w = adam(gradient, x.shape[1] * BINS, steps)
    raw = w[b].sum(axis=1)
    cuts = np.quantile(raw, np.linspace(0.005, 0.995, 199))
    right = [((raw[good] >= c).mean() + (raw[bad] < c).mean(), -abs(c)) for c in cuts]
    at = int(np.argmax([r[0] for r in right]))
    best = np.flatnonzero(np.isclose([r[0] for r in right], right[at][0]))
    return Ranking(edges, w.reshape(-1, BINS), float(cuts[best[len(best) // 2]]), threshold)


def learn(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> Ranking:
    """Fit on a bounded sample of labelled rows; the driver gets their features, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, label, rows=rows, id_column=id_column, text_column=text_column).select("doc_id", "text", "y")
    got = sample.mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(got.x.tolist(), float).reshape(len(got), N_FEATURES), got.y.to_numpy(), threshold)


def score_quality(docs: DataFrame, ranking: Ranking, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = ranking.score(np.array([features(t) for t in utf8(part.column(1))], float).reshape(-1, N_FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(score), pa.array((score >= ranking.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_column), F.col(text_column), held_out(id_column).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranking: Ranking, *, text_column: str = "text") -> DataFrame:
    """The rows that reach the threshold, with all their columns."""
    return keep_rows(docs, text_column, lambda texts: (ranking.score(np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)) >= ranking.threshold).tolist())
