"""Simulated panels: workers of several types move between firms of several classes.

The small arrays of effects and transition probabilities are worked out on the driver; workers
are simulated in blocks, each from the seed and its own number, so a block made again is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.params import SimParams

BLOCK = 4096


def effects(p: SimParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Effects of firm classes and worker types, transitions [type, from, to], and stationary shares [type, class]."""

    def grid(n: int, scale: float) -> np.ndarray:
        return np.array([NormalDist().inv_cdf((k + 1) / (n + 1)) for k in range(n)]) * scale

    psi, alpha = grid(p.nk, p.psi_sig), grid(p.nl, p.alpha_sig)
    gap = (psi[None, None, :] - p.c_netw * psi[None, :, None] - p.c_sort * alpha[:, None, None]) / p.c_sig
    moves = np.exp(-0.5 * gap * gap)
    moves /= moves.sum(axis=2, keepdims=True)
    shares = np.full((p.nl, p.nk), 1 / p.nk)
    for _ in range(10_000):
        after = np.einsum("lk,lkm->lm", shares, moves)
        if np.abs(after - shares).max() < 1e-14:
            break
        shares = after
    return psi, alpha, moves, shares / shares.sum(axis=1, keepdims=True)


def _spells(p: SimParams, first: int, last: int, seed: int, moves: np.ndarray, shares: np.ndarray) -> dict[str, np.ndarray]:
    """Class and spell of each worker and period of a block; a move draws a class, which may be the same."""
    rng = np.random.default_rng([seed, first])
    n = last - first
    kind = np.arange(first, last) % p.nl
    pick = lambda probs: np.minimum((probs.cumsum(axis=1) < rng.random((n, 1))).sum(axis=1), p.nk - 1)
    klass, spell = np.empty((n, p.n_time), np.int64), np.zeros((n, p.n_time), np.int64)
    klass[:, 0] = pick(shares[kind])
    for t in range(1, p.n_time):
        moved = rng.random(n) < p.p_move
        klass[:, t] = np.where(moved, pick(moves[kind, klass[:, t - 1]]), klass[:, t - 1])
        spell[:, t] = spell[:, t - 1] + moved
    rows = np.repeat(np.arange(first, last), p.n_time)
    return {"i": rows, "t": np.tile(np.arange(1, p.n_time + 1), n), "l": rows % p.nl, "k": klass.ravel(), "spell": spell.ravel(), "noise": rng.standard_normal(n * p.n_time), "draw": np.repeat(rng.random(n), p.n_time)}


def firm_weights(p: SimParams, rows_by_class: dict[int, int]) -> dict[int, list[float]]:
    """Cumulative shares of each class's firms: max(1, rows / (periods * firm size)) of them."""
    out = {}
    for k, rows in sorted(rows_by_class.items()):
        n = max(1, round(rows / (p.n_time * p.firm_size)))
        u = (np.arange(n) + 0.5) / n
        if p.firm_size_distn == "pareto":
            a = p.exp_distn_exponent
            size = (1 - u * (1 - p.max_firm_size**-a)) ** (-1 / a)
        elif p.firm_size_distn == "exponential":
            size = -np.log1p(-u) / p.exp_distn_exponent
        else:
            size = np.ones(n)
        out[k] = (size.cumsum() / size.sum()).tolist()
    return out


def simulate(spark: SparkSession, params: SimParams | None = None, seed: int = 0) -> DataFrame:
    """Columns i, j, y, t, l (worker type), k (firm class), alpha and psi; y = alpha + psi + noise."""
    p = params or SimParams()
    psi, alpha, moves, shares = effects(p)
    blocks = -(-p.n_workers // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                got = _spells(p, b * BLOCK, min(p.n_workers, (b + 1) * BLOCK), seed, moves, shares)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in got.values()], list(got))

    walks = spark.range(0, blocks, 1, blocks).mapInArrow(run, "i long, t long, l long, k long, spell long, noise double, draw double")
    counts = {r.k: r["count"] for r in walks.groupBy("k").count().collect()}
    weights = firm_weights(p, counts)
    starts = dict(zip(weights, np.cumsum([0, *map(len, weights.values())]).tolist(), strict=False))

    def firms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t, l, k, spell, noise, _ = (batch.column(x).to_numpy() for x in range(7))
            mix = (i.astype(np.uint64) * np.uint64(1_000_003) + spell.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
            mix ^= mix >> np.uint64(29)
            mix *= np.uint64(0xBF58476D1CE4E5B9)
            mix ^= mix >> np.uint64(32)
            u = mix.astype(np.float64) / 2**64
            j = np.empty(len(i), np.int64)
            for c in np.unique(k).tolist():
                own = k == c
                j[own] = starts[c] + np.minimum(np.searchsorted(weights[c], u[own]), len(weights[c]) - 1)
            y = alpha[l] + psi[k] + p.w_sig * noise
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, y, t, l, k, alpha[l], psi[k])], ["i", "j", "y", "t", "l", "k", "alpha", "psi"])

    return walks.mapInArrow(firms, "i long, j long, y double, t long, l long, k long, alpha double, psi double").withColumn("t", F.col("t").cast("long"))
