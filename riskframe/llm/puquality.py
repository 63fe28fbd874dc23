"""Quality classifier from trusted positives and unlabelled text.

Positive-unlabelled learning: a small network g minimises the non-negative
risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with the sigmoid loss; the bracket estimates the risk on the unseen negatives,
which cannot be below zero. The class prior is estimated first: over the
scores of a plain positive-against-unlabelled network, the share of unlabelled
texts above a threshold is at least prior times the share of positives above
it, so the least ratio over all thresholds (with a margin for its noise)
bounds the prior. That step counts all training rows.

Texts are reduced to ``WIDTH`` numbers where they are, once, and written. The
network is fitted on a sample of at most about ``max_positive`` trusted and
``max_unlabelled`` unlabelled rows, drawn by a hash of id and features; the
prior's counts and the scores cover all rows.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written
from riskframe.llm.quality import STOP_WORDS

#: Expected size of the samples that the network is fitted on, by default.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
SHAPES, HASHED = 18, 32
WIDTH = SHAPES + HASHED
HIDDEN = 24
EPOCHS, RANKER_EPOCHS, BATCH, RATE = 60, 15, 512, 0.004
SEED = 17
#: Score bins of the prior's estimate, and its confidence.
BINS, DELTA = 1000, 0.1

_STOPS = frozenset(w.encode() for w in STOP_WORDS)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(b"#*$%&|<>")
_POINT = _table(b".,;:'\"()-?")
_ENDS = (b".", b"!", b"?")


def features(text: str | None) -> np.ndarray:
    """Shape of a text: word lengths, repetition, function words, character
    classes, and hashed byte pairs. All zero for an empty or null text."""
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return out
    size = np.fromiter(map(len, words), np.float64, n)
    code = np.fromiter(map(hash, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[0] = math.log1p(n)
    out[1] = min(size.mean(), 30)
    out[2] = min(size.std(), 30)
    out[3] = (size <= 3).mean()
    out[4] = (size >= 10).mean()
    out[5] = len(set(words)) / n * min(1.0, n**0.5 / 20) + max(0.0, 1 - n**0.5 / 20)
    if n > 1:
        out[6] = sum(map(operator.eq, words, words[1:])) / (n - 1)
    if n > 2:
        three = code[:-2] * 3 + code[1:-1] * 5 + code[2:] * 7
        out[7] = 1 - len(np.unique(three)) / len(three)
    out[8] = sum(map(_STOPS.__contains__, words)) / n
    out[9] = sum(w.endswith(_ENDS) for w in words) / n
    out[10] = 1 - len(set(lines)) / len(lines)
    out[11] = min(1.0, len(lines) / n)
    b = np.frombuffer(raw, np.uint8)
    count = np.bincount(b, minlength=256)
    total = len(b)
    letters = count[_UPPER].sum() + count[_LOWER].sum()
    out[12] = count[_UPPER].sum() / max(1, letters)
    out[13] = count[_DIGIT].sum() / total
    out[14] = min(4.0, count[_SYMBOL].sum() / n)
    out[15] = min(2.0, count[33] / n)
    out[16] = count[128:].sum() / total
    out[17] = min(2.0, count[_POINT].sum() / n)
    if total > 1:
        pair = (b[:-1].astype(np.uint32) * np.uint32(257) + b[1:]) * np.uint32(2654435761) >> np.uint32(27)
        out[SHAPES:] = np.sqrt(np.bincount(pair, minlength=HASHED) / (total - 1))
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        x = [features(t.as_py()).tobytes() for t in rows.column(0)]
        yield pa.RecordBatch.from_arrays(
            [*rows.columns[1:], pa.array(x, pa.binary())], names=[*rows.schema.names[1:], "x"]
        )


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -50, 50)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = EPOCHS) -> Network:
    """``prior`` None: positives against unlabelled, both halves weighted
    alike (logistic). Else the non-negative risk."""
    rng = np.random.default_rng(SEED)
    if not len(pos) or not len(unl):
        pos = unl = np.zeros((1, WIDTH), np.float32)
    mean, scale = unl.mean(axis=0), np.maximum(unl.std(axis=0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (pos, unl))
    par = [rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(q) for q in par], [np.zeros_like(q) for q in par]
    steps = max(1, math.ceil(len(u) / BATCH))
    t = 0
    for epoch in range(epochs):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(steps):
            xp = p[np.take(pi, range(k * len(p) // steps, max(k * len(p) // steps + 1, (k + 1) * len(p) // steps)), mode="wrap")]
            xu = u[ui[k * len(u) // steps : max(k * len(u) // steps + 1, (k + 1) * len(u) // steps)]]
            x = np.concatenate([xp, xu])
            hidden = np.tanh(x @ par[0] + par[1])
            s = 1 / (1 + np.exp(-np.clip(hidden @ par[2] + par[3][0], -50, 50)))
            sp, su = s[: len(xp)], s[len(xp) :]
            if prior is None:
                slope = np.concatenate([(sp - 1) / len(xp), su / len(xu)])
            else:
                # the sigmoid loss: 1 - s on positives, s on negatives
                dp, du = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
                if su.mean() - prior * sp.mean() >= 0:
                    slope = np.concatenate([-2 * prior * dp, du])
                else:  # step back from fitting the unlabelled too well
                    slope = np.concatenate([prior * dp, -du])
            back = np.outer(slope, par[2]) * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * par[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * par[2], np.array([slope.sum()])]
            t += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                par[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, par[0], par[1], par[2], float(par[3][0]))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """From counts of positives and unlabelled rows by score bin, ascending:
    the ratio of the shares above the best threshold."""
    n_p, n_u = pos.sum(), unl.sum()
    if not n_p or not n_u:
        return 0.5
    above_p = np.cumsum(pos[::-1]) / n_p
    above_u = np.cumsum(unl[::-1]) / n_u
    margin = math.sqrt(math.log(4 / DELTA) / (2 * n_p)) + math.sqrt(math.log(4 / DELTA) / (2 * n_u))
    some = above_p > 0.01
    bound = (above_u[some] + 1.01 * margin) / above_p[some]
    at = int(bound.argmin())
    return float(np.clip(above_u[some][at] / above_p[some][at], 0.02, 0.98))


def _scored(rows: DataFrame, net: Network) -> DataFrame:
    """``rows`` with ``x`` replaced by ``score``."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(b.column("x").to_pylist())
            x = np.frombuffer(raw, np.float32).reshape(-1, WIDTH).astype(np.float64)
            got = shared.value.score(np.clip(x, shared.value.mean - 8 * shared.value.scale, shared.value.mean + 8 * shared.value.scale))
            keep = [n for n in b.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(got)], names=[*keep, "score"])

    kept = [f for f in rows.schema.fields if f.name != "x"]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return rows.mapInArrow(score, ", ".join([*types, "score double"]))


def _sample(rows: DataFrame, most: int, salt: int) -> np.ndarray:
    """About ``most`` rows' features, by a hash of the row; all if fewer."""
    n = rows.count()
    share = min(1.0, most / max(1, n))
    cut = F.pmod(F.xxhash64("id", "x", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))
    got = (rows if share == 1.0 else rows.where(cut)).select("x").collect()
    flat = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, WIDTH)
    # one order, whatever the partitions
    return flat[np.lexsort(flat.T[::-1])] if len(flat) else flat


def pu_scores(
    docs: DataFrame,
    positive_ids: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, score``; the score is
    0 to 1, higher for better text.

    Learns from rows where ``train`` (over ``docs``; null: false) holds:
    those whose id is in the first column of ``positive_ids`` are the trusted
    positives, and all of them, labels unseen, the unlabelled ones. The network
    is fitted on about ``max_positive`` and ``max_unlabelled`` of them, on all
    where there are no more; kinds of text too rare to be among these are not
    seen in fitting. Each row takes some 200 bytes of the driver. Only the
    text is scored. Null and empty texts have all features zero and get the
    score of such a text. Repeated rows, null ids (never positive) and extra
    columns are fine. Without positives, or without rows to learn from, every
    score is 0.5; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{id_col}`").alias("id"),
        (~F.coalesce(train, F.lit(False))).alias("held_out"),
    )
    fields = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, x binary"
    rows = written(rows.mapInArrow(_featurise, fields), "features")
    known = positive_ids.select(F.col(positive_ids.columns[0]).alias("id")).distinct()
    taught = rows.where(~F.col("held_out"))
    trusted = written(taught.join(known, "id", "left_semi"), "trusted")
    pos, unl = _sample(trusted, max_positive, 1), _sample(taught, max_unlabelled, 2)
    if not len(pos) or not len(unl):
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit(0.5).alias("score"))
    # the ranker learns from one half of the texts and is counted on the other
    half = F.pmod(F.xxhash64("x", F.lit(3)), F.lit(2))
    ranker = _fit(
        _sample(trusted.where(half == 0), max_positive, 1),
        _sample(taught.where(half == 0), max_unlabelled, 2),
        None,
        RANKER_EPOCHS,
    )
    prior = estimate_prior(
        _counts(trusted.where(half == 1), ranker), _counts(taught.where(half == 1), ranker)
    )
    net = _fit(pos, unl, prior)
    return _scored(rows, net).select(F.col("id").alias(id_col), "held_out", "score")


def _counts(rows: DataFrame, net: Network) -> np.ndarray:
    """Rows by score bin, over all rows."""
    at = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("at")
    out = np.zeros(BINS)
    for r in _scored(rows.select("x"), net).groupBy(at).count().collect():
        out[int(r["at"])] = r["count"]
    return out
