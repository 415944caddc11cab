"""Positive-unlabelled quality classifier.

Trusted positives (label 1), unlabelled web text and an estimated class prior train a
linear model by the non-negative unbiased risk with logistic loss: the risk of the
unlabelled as negatives, less the prior's share of the positives as negatives, is
kept from falling below zero.  Features are shares and shapes of a text's
characters, words and lines; labels, language, source and id are never features.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import shards
from sieveline.llm.rolling import mix

#: Rows of either kind that training sees at most, those with the smallest id hashes.
SAMPLE_ROWS = 12_000
FOLDS, THRESHOLD = 5, 0.3
SHAPES = 96
_PLAIN = 16
SIZE = 2 * _PLAIN + SHAPES
RESULT = "doc_id long, held_out boolean, score double, predicted int"

# byte classes: 0 space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 beyond ASCII
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[128:] = 6


def features(texts: list) -> np.ndarray:
    """A row of features for each text; null and empty texts have zeros."""
    bodies = [(t or "").encode() for t in texts]
    lengths = np.array([len(b) for b in bodies], np.int64)
    n = len(bodies)
    out = np.zeros((n, SIZE), np.float32)
    if not lengths.sum():
        return out
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(n), lengths)
    kind = _CLASS[data]
    inside = kind > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = (ends - lengths)[lengths > 0]
    begins[first] = inside[first]
    chars = np.maximum(lengths, 1).astype(float)
    shares = np.bincount(doc * 8 + kind, minlength=n * 8).reshape(n, 8) / chars[:, None]
    lines = np.bincount(doc[data == 10], minlength=n) + 1
    plain = np.zeros((n, _PLAIN))
    plain[:, :7] = shares[:, :7]
    starts = np.flatnonzero(begins)
    if len(starts):
        owner = doc[starts]
        # a word's hash, from a few sums over its bytes
        which = np.cumsum(begins) - 1
        at = np.arange(len(data)) - starts[np.maximum(which, 0)]
        with np.errstate(over="ignore"):
            weights = mix(np.minimum(at, 63).astype(np.uint64), 3) | np.uint64(1)
            word = mix(np.add.reduceat(np.where(inside, weights * (data.astype(np.uint64) + np.uint64(1)), np.uint64(0)), starts))
            # its shape: the classes of its characters, runs of one class counted once
            turn = inside.copy()
            turn[1:] &= (kind[1:] != kind[:-1]) | begins[1:]
            nth = np.cumsum(turn) - np.cumsum(turn)[starts][np.maximum(which, 0)]
            order = mix(np.minimum(np.maximum(nth, 0), 15).astype(np.uint64), 5) | np.uint64(1)
            shape = mix(np.add.reduceat(np.where(turn, order * (kind.astype(np.uint64) + np.uint64(1)), np.uint64(0)), starts))
        words = np.bincount(owner, minlength=n)
        some = np.maximum(words, 1).astype(float)
        same = np.zeros(len(starts), bool)
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        sort = np.lexsort((word, owner))
        new = np.ones(len(sort), bool)
        new[1:] = (word[sort][1:] != word[sort][:-1]) | (owner[sort][1:] != owner[sort][:-1])
        upper = np.bincount(which[inside], kind[inside] == 2, len(starts)) > 0
        lower = np.bincount(which[inside], (kind[inside] == 1) | (kind[inside] == 6), len(starts)) > 0
        marks = np.bincount(which[inside], kind[inside] == 5, len(starts)) > 0
        size = np.bincount(which[inside], minlength=len(starts))
        plain[:, 7] = np.log1p(words)
        plain[:, 8] = np.bincount(owner, same, n) / some
        plain[:, 9] = np.bincount(owner[sort], new, n) / some
        plain[:, 10] = np.bincount(owner, upper & ~lower, n) / some
        plain[:, 11] = np.bincount(owner, marks, n) / some
        plain[:, 12] = np.bincount(owner, size, n) / some / 10
        plain[:, 13] = np.log1p(words / lines)
        plain[:, 14] = np.bincount(owner, size == 1, n) / some
        plain[:, 15] = np.log1p(chars / some)
        hashed = (shape % np.uint64(SHAPES)).astype(np.int64)
        out[:, 2 * _PLAIN :] = np.sqrt(np.bincount(owner * SHAPES + hashed, minlength=n * SHAPES).reshape(n, SHAPES) / some[:, None])
    out[:, :_PLAIN] = plain
    out[:, _PLAIN : 2 * _PLAIN] = np.sqrt(plain)
    return out


class Model(NamedTuple):
    """Weights and bias of the score, and the prior that they were trained with (None: untrained)."""

    weights: np.ndarray
    bias: float
    prior: float | None


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, rounds: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _affine(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def nonnegative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, decay: float = 1e-4):
    """Weights and bias that minimise the non-negative positive-unlabelled risk (logistic loss).

    Where the negatives' part of the risk would fall below zero, a step is taken
    to raise it again, as the estimator's authors propose.
    """
    p, u = _affine(positive), _affine(unlabelled)
    shrink = np.append(np.full(positive.shape[1], decay), 0)

    def gradient(w):
        zp, zu = p @ w, u @ w
        negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = _sigmoid(zp) / len(zp) * prior, _sigmoid(zu) / len(zu)
        dp, du = (-(1 - _sigmoid(zp)) / len(zp) * prior - gp, gu) if negatives >= 0 else (gp, -gu)
        return p.T @ dp + u.T @ du + shrink * w

    w = _descend(gradient, p.shape[1], rounds)
    return w[:-1], w[-1]


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, half_p: np.ndarray, half_u: np.ndarray, rounds: int = 100, decay: float = 1e-2) -> float:
    """Share of positives among the unlabelled, from scores of positives against unlabelled.

    Each half is scored by a model of the other one.  Above any score, the share of
    the unlabelled over the share of the positives is the prior or more; the least of
    these ratios counts, where half of the positives or more are above, each less one
    standard error: too high a prior costs far more than one that is a little low.
    """
    scores = [np.zeros(len(positive)), np.zeros(len(unlabelled))]
    p, u = _affine(positive), _affine(unlabelled)
    for h in (0, 1):
        x, y = p[half_p != h], u[half_u != h]
        if not len(x) or not len(y):
            continue
        w = _descend(lambda w: y.T @ _sigmoid(y @ w) / len(y) - x.T @ (1 - _sigmoid(x @ w)) / len(x) + decay * w, p.shape[1], rounds)  # noqa: B023
        scores[0][half_p == h], scores[1][half_u == h] = p[half_p == h] @ w, u[half_u == h] @ w
    cuts = np.quantile(scores[0], np.linspace(0, 0.5, 51))
    above_p, above_u = ((s[None, :] >= cuts[:, None]).mean(1) for s in scores)
    return float(np.clip(((above_u - np.sqrt(above_u * (1 - above_u) / len(unlabelled))) / above_p).min(), 0.05, 0.999))


def fold(doc_id):
    """crc32 of the id as text, modulo the number of folds (null: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model, learnt from the training folds alone.

    The prior is estimated from the unlabelled training texts against the trusted
    positives; no label 0 is read.  Without positives or text the model is zero:
    every score is 0.5.  Null labels and ids are left out; an id counts as positive
    if any of its labels is.
    """
    known = labels.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    first = lambda frame: frame.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = first(known.where("quality = 1").select("doc_id")).withColumn("kind", F.lit(1)).unionByName(
        first(docs.where(fold(F.col("doc_id")) != 0).select("doc_id")).withColumn("kind", F.lit(0))
    )

    def described(tables):
        for table in (part for t in tables for part in shards.slices(t)):
            values = features(table.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([table.column("kind"), table.column("half"), pa.array([v.tobytes() for v in values], pa.binary())], ["kind", "half", "values"])

    # at most 2 * sample_rows ids are broadcast, and as many rows return
    half = (F.crc32(F.concat(F.lit("half "), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int").alias("half")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("kind", half, "text").mapInArrow(described, "kind int, half int, values binary").collect()
    rows = sorted((r.kind, r.half, bytes(r["values"])) for r in rows)  # whatever order they came in
    x = {k: np.array([np.frombuffer(v, np.float32) for kind, _, v in rows if kind == k], np.float64) for k in (0, 1)}
    halves = {k: np.array([h for kind, h, _ in rows if kind == k]) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return Model(np.zeros(SIZE), 0.0, None)
    mean, spread = x[0].mean(0), x[0].std(0)
    spread[spread < 1e-6] = 1
    unlabelled, positive = (x[0] - mean) / spread, (x[1] - mean) / spread
    prior = estimated_prior(positive, unlabelled, halves[1], halves[0])
    w, b = nonnegative_risk(positive, unlabelled, prior)
    return Model(w / spread, float(b - (mean / spread) @ w), prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row; a null id is in no held-out fold."""
    w, b, _ = model

    def scored(tables):
        for table in (part for t in tables for part in shards.slices(t)):
            z = features(table.column("text").to_pylist()) @ w + b
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id"), table.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(scored, RESULT)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more."""
    w, b, _ = model

    def chosen(tables):
        for t in (part for table in tables for part in shards.slices(table)):
            z = features(t.column("text").to_pylist()) @ w + b
            yield t.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold))

    return docs.mapInArrow(chosen, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every whole text; one row per input row.

    Null and empty texts are scored from features of zero.  Extra columns are not read.
    """
    return score(docs, fit(docs, labels, sample_rows), threshold)
