"""Hashed n-gram features and logistic regression that learns in shards of a bounded sample."""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tillflow.llm.shared import share_of

BITS = 18
DIM = 1 << BITS  # buckets per family
FAMILIES = ("words", "word pairs", "3 characters", "4 characters")
SCALES = (3.0, 1.0, 1.0, 1.0)
TEXT_DIM = DIM * len(FAMILIES)
SHORT = 16  # n-grams that a text counts as having besides its own: a few words are little evidence
DAMPING = 0.3  # how much a single n-gram loses in a longer text
RARE = 1.0  # log ratios nearer to 0 than this carry no weight
_SLICE = 1 << 20
_MIX = np.uint32(0x9E3779B1)  # spreads sums over the upper bits
_ODD = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def _sorted_distinct(ids: np.ndarray) -> np.ndarray:
    if not len(ids):
        return ids
    ids.sort()
    first = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=first[1:])
    return ids[first]


def _distinct(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Distinct buckets of the n-grams whose i-th symbols are in column i."""
    n = min(len(c) for c in columns)
    parts = []
    for at in range(0, n, _SLICE):
        total = np.zeros(min(n - at, _SLICE), np.uint32)
        for c, odd in zip(columns, _ODD, strict=False):
            total = total + c[at : at + len(total)] * odd
        parts.append(_sorted_distinct((total * _MIX) >> np.uint32(32 - BITS)))
    if len(parts) > 1:
        return _sorted_distinct(np.concatenate(parts))
    return parts[0] if parts else np.zeros(0, np.uint32)


def hashed_ngrams(text: str | None) -> list[np.ndarray]:
    """Distinct buckets of a text's word and character n-grams, one array per family; empty ones for no text.

    Family i's buckets start at i * DIM. The arrays are no longer than DIM, however long the text is.
    """
    raw = text or ""
    words = raw.encode().split()
    w = np.fromiter(map(crc32, words), np.uint32, len(words))
    c = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
    grams = [[w], [w[:-1], w[1:]], [c[:-2], c[1:-1], c[2:]], [c[:-3], c[1:-2], c[2:-1], c[3:]]]
    return [_distinct(columns).astype(np.int32) + np.int32(i * DIM) for i, columns in enumerate(grams)]


def sparse_row(groups: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text; all n-grams of a family have the same value."""
    values = [np.full(len(g), s / (len(g) + SHORT) ** DAMPING, np.float32) for g, s in zip(groups, SCALES, strict=True)]
    return np.concatenate(groups), np.concatenate(values)


def text_margin(weights: np.ndarray, bias: float, text: str | None) -> float:
    total = bias
    for ids, scale in zip(hashed_ngrams(text), SCALES, strict=True):
        if len(ids):
            total += float(weights[ids].sum()) * scale / (len(ids) + SHORT) ** DAMPING
    return total


def fit_text(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.3,
             seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression by AdaGrad in a seeded order, both classes weighing the same.

    Features are scaled by the log ratio of their smoothed shares in the two classes (Wang and Manning 2012), those
    that hardly tell the classes apart by 0; the scale is part of the returned weights.
    """
    labels = np.asarray(labels, float)
    good, bad = np.ones(TEXT_DIM, np.float32), np.ones(TEXT_DIM, np.float32)
    for (ids, _), label in zip(rows, labels, strict=True):
        (good if label > 0.5 else bad)[ids] += 1
    n_good, n_bad = float((labels > 0.5).sum()), float((labels <= 0.5).sum())
    ratio = np.log(good / (n_good + 2)) - np.log(bad / (n_bad + 2))
    ratio[np.abs(ratio) < RARE] = 0.0
    scaled = [(ids[keep], (values[keep] * ratio[ids[keep]]).astype(np.float32)) for ids, values in rows for keep in [ratio[ids] != 0]]
    weights, seen, bias, seen_bias = np.zeros(TEXT_DIM, np.float32), np.full(TEXT_DIM, 1e-6, np.float32), 0.0, 1e-6
    weight_of = {True: min(10.0, 0.5 * len(labels) / max(1.0, n_good)), False: min(10.0, 0.5 * len(labels) / max(1.0, n_bad))}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(scaled)):
            ids, values = scaled[i]
            margin = bias + weights[ids] @ values
            error = (sigmoid(margin) - labels[i]) * weight_of[bool(labels[i] > 0.5)]
            if abs(error) < 1e-3:
                continue
            step = error * values
            seen[ids] += step * step
            weights[ids] -= rate * step / np.sqrt(seen[ids])
            seen_bias += error * error
            bias -= rate * error / seen_bias**0.5
    return weights * ratio, float(bias)


def fit_dense(rows: np.ndarray, labels: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), decay)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - labels) + ridge * w)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset on held-out margins, with his smoothed targets; (1, 0) where a class is missing."""
    margins, labels = np.asarray(margins, float), np.asarray(labels, float)
    good, bad = labels.sum(), (1 - labels).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = fit_dense(margins[:, None], target, decay=1e-3)
    return float(max(a, 1e-3)), float(b)


def bounded_labels(labels: DataFrame, id_column: str, good: Column, bound: int, seed: int) -> DataFrame:
    """(id, label) of about ``bound`` labelled ids, taken by a hash of the id; all, if there are no more.

    Rows without id or label do not count, and of several labels of one id the worst does.
    """
    known = (
        labels.select(F.col(f"`{id_column}`").alias("id"), good.cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull())
        .groupBy("id").agg(F.min("label").alias("label"))
    )
    return known.where(share_of(F.col("id"), seed) < min(1.0, bound / max(1, known.count())))


def take_texts(docs: DataFrame, id_column: str, chosen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the documents in ``chosen`` (id, label): one row per id, whatever repeats.

    ``chosen`` is of a documented size, so it is broadcast and no document is shuffled that is not in it.
    """
    found = docs.select(F.col(f"`{id_column}`").alias("id"), *[F.col(f"`{c}`") for c in columns])
    joined = found.join(F.broadcast(chosen), "id")
    return joined.groupBy("id", "label").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"))
