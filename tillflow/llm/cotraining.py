"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillflow.llm.linear import (
    TEXT_DIM, bounded_labels, calibrate, fit_dense, fit_text, hashed_ngrams, sigmoid, sparse_row, take_texts, text_margin,
)
from tillflow.llm.shared import add_python_columns, packed, share_of, tidy_worker, unpacked

LABELLED_ROWS = 8192  # bound of the labelled sample; a fifth of it only calibrates
UNLABELLED_ROWS = 4096  # bound of the sample that the views label for each other
SHARDS = 4
ROUNDS = 3
CONFIDENT = 0.97  # probability from which a view labels a document for the other
PER_ROUND = 0.25  # share of the unlabelled rows that a view may label in a round, the surest first
KEEP_FROM = 0.5
METADATA = ("lang", "source", "n_chars")

_CODES = 32
_LAYOUT = 8


def metadata_row(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is known of a page besides its words: language, source, stated length and layout counts.

    Language and source are one-hot in hashed codes, null having a code like any other. Of the text only counts of
    lines, words and kinds of characters are used. All numbers are within about [-1, 2].
    """
    out = np.zeros(2 * _CODES + _LAYOUT)
    for i, value in enumerate((lang, source)):
        out[i * _CODES + crc32(("\0" if value is None else str(value)).encode()) % _CODES] = 1.0
    raw = text or ""
    n = max(1, len(raw))
    data = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
    words = raw.split()
    lines = [x for x in raw.split("\n") if x.strip()]
    ascii_mark = (data > 32) & (data < 48) | (data > 57) & (data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 127)
    stated = len(raw) if n_chars is None else max(0, n_chars)
    out[2 * _CODES :] = (
        log2(1 + stated) / 10 - 1,
        float(ascii_mark.sum()) / n * 5,
        float(((data > 64) & (data < 91)).sum()) / n * 5,
        float(((data > 47) & (data < 58)).sum()) / n * 5,
        len(set(words)) / (len(words) + 10),
        log2(1 + n / (1 + len(lines))) / 8 - 1,
        len(set(lines)) / (len(lines) + 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) + 10),
    )
    return out


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


@dataclass
class TwoViews:
    """Both views with their calibration, the prior log odds, and the calibration of their combination."""

    weights: np.ndarray
    bias: float
    text_line: tuple[float, float]
    metadata: np.ndarray
    metadata_line: tuple[float, float]
    prior: float
    line: tuple[float, float]

    def views(self, text, lang, source, n_chars) -> tuple[float, float, float]:
        """Calibrated probabilities of good quality: by the text, by the metadata, and by both.

        Views that are independent given the class add their log odds; the sum is calibrated in turn.
        """
        a = self.text_line[0] * text_margin(self.weights, self.bias, text) + self.text_line[1]
        row = metadata_row(text, lang, source, n_chars)
        b = self.metadata_line[0] * float(row @ self.metadata[:-1] + self.metadata[-1]) + self.metadata_line[1]
        both = self.line[0] * (a + b - self.prior) + self.line[1]
        return float(sigmoid(a)), float(sigmoid(b)), float(sigmoid(both))


def co_train(texts: Sequence[str | None], metadata: np.ndarray, labels: Sequence[int | None], rounds: int = ROUNDS,
             confident: float = CONFIDENT, per_round: float = PER_ROUND) -> tuple[np.ndarray, float, np.ndarray]:
    """(text weights, text bias, metadata weights) after ``rounds`` of exchange; a label of None is unknown.

    In each round both views learn from all labels they have; then each labels, for the other, the unlabelled rows that
    it is surest of, as many of a class at most as the class's share among the known labels allows.
    """
    rows = [sparse_row(hashed_ngrams(t)) for t in texts]
    known = [i for i, y in enumerate(labels) if y is not None]
    truth = np.array([labels[i] for i in known], float)
    share = float(truth.mean()) if len(truth) else 0.5
    given: tuple[dict[int, float], dict[int, float]] = ({}, {})  # what the text view and the metadata view were told
    unknown = [i for i, y in enumerate(labels) if y is None]
    for turn in range(rounds + 1):
        told = [[*known, *g] for g in given]
        marks = [np.concatenate([truth, list(g.values())]) for g in given]
        weights, bias = fit_text([rows[i] for i in told[0]], marks[0])
        dense = fit_dense(metadata[told[1]], marks[1])
        if turn == rounds or not unknown:
            break
        by_text = sigmoid(np.array([bias + weights[rows[i][0]] @ rows[i][1] for i in unknown]))
        by_metadata = sigmoid(metadata[unknown] @ dense[:-1] + dense[-1])
        for teacher, taught in ((by_text, given[1]), (by_metadata, given[0])):
            for label, sure in ((1.0, teacher), (0.0, 1 - teacher)):
                most = int(per_round * len(unknown) * (share if label else 1 - share))
                for j in np.argsort(-sure, kind="stable")[:most]:
                    if sure[j] >= confident:
                        taught[unknown[j]] = label
    return weights, bias, dense


def train(docs: DataFrame, labels: DataFrame, good: Column, id_column: str = "doc_id", text: str = "text",
          metadata: Sequence[str] = METADATA, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
          shards: int = SHARDS, rounds: int = ROUNDS) -> TwoViews:
    """Co-train on bounded samples of labelled and unlabelled documents, chosen by a hash of their id.

    Each shard of the samples is co-trained in a task of its own, and the views' weights are averaged. A held-out fifth
    of the labelled sample calibrates either view and their combination. Without labels of both classes every
    document gets the share of good labels, or 1 if there are none.
    """
    lang, source, n_chars = metadata
    named = docs.select(
        F.col(f"`{id_column}`").alias("doc"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{n_chars}`").cast("long").alias("n_chars"),
    )
    columns = ["text", "lang", "source", "n_chars"]
    chosen = bounded_labels(labels, id_column, good, labelled_rows, 1001)
    n_docs = docs.count()
    others = (
        named.select(F.col("doc").alias("id")).where(F.col("id").isNotNull() & (share_of(F.col("id"), 1004) < unlabelled_rows / max(1, n_docs)))
        .distinct().join(labels.select(F.col(f"`{id_column}`").alias("id")).distinct(), "id", "left_anti")
        .select("id", F.lit(None).cast("int").alias("label"))
    )
    rows = take_texts(named, "doc", chosen.unionByName(others), columns)
    rows = rows.select(
        "id", "label", "row.*", F.coalesce((share_of(F.col("id"), 1002) < 0.2) & F.col("label").isNotNull(), F.lit(False)).alias("held_out"),
        F.floor(share_of(F.col("id"), 1003) * shards).cast("int").alias("shard"),
    )
    counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(counts) < 2:
        certain = 35.0 if not counts or 1 in counts else -35.0
        return TwoViews(np.zeros(TEXT_DIM, np.float32), 0.0, (0.0, certain), np.zeros(2 * _CODES + _LAYOUT + 1), (0.0, certain), certain, (1.0, 0.0))
    share = counts[1] / (counts[0] + counts[1])

    def fit_shard(table: pa.Table) -> pa.Table:
        with tidy_worker():
            return fitted_shard(table)

    def fitted_shard(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.array([str(i) for i in table["id"].to_pylist()]), kind="stable")))
        texts = table["text"].to_pylist()
        described = zip(texts, table["lang"].to_pylist(), table["source"].to_pylist(), table["n_chars"].to_pylist(), strict=True)
        dense_rows = np.array([metadata_row(*x) for x in described]).reshape(len(texts), -1)
        weights, bias, dense = co_train(texts, dense_rows, table["label"].to_pylist(), rounds)
        used = np.flatnonzero(weights)
        return pa.table({
            "ids": pa.array([used.astype(np.int32).tobytes()], pa.binary()),
            "weights": pa.array([weights[used].astype(np.float32).tobytes()], pa.binary()),
            "dense": pa.array([dense.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64()),
            "n": pa.array([len(texts)], pa.int64()),
        })

    fitted = (
        rows.where(~F.col("held_out")).drop("held_out").groupBy("shard")
        .applyInArrow(fit_shard, "ids binary, weights binary, dense binary, bias double, n long").collect()
    )
    total = sum(r["n"] for r in fitted)
    weights, dense, bias = np.zeros(TEXT_DIM), np.zeros(2 * _CODES + _LAYOUT + 1), 0.0
    for r in fitted:
        weights[np.frombuffer(r["ids"], np.int32)] += np.frombuffer(r["weights"], np.float32) * (r["n"] / total)
        dense += np.frombuffer(r["dense"]) * (r["n"] / total)
        bias += r["bias"] * r["n"] / total
    raw = TwoViews(weights.astype(np.float32), bias, (1.0, 0.0), dense, (1.0, 0.0), 0.0, (1.0, 0.0))
    held = _scored(rows.where("held_out").select("label", *columns), raw).select("label", "text_p", "metadata_p").collect()
    marks = np.array([r["label"] for r in held], float)
    margins = [logit(np.array([r[c] for r in held], float)) for c in ("text_p", "metadata_p")]
    lines = [calibrate(m, marks) for m in margins]
    prior = log(share) - log(1 - share)
    both = sum(a * m + b for (a, b), m in zip(lines, margins, strict=True)) - prior
    return TwoViews(raw.weights, bias, lines[0], dense, lines[1], prior, calibrate(both, marks))


_FIELDS = [T.StructField(n, T.DoubleType()) for n in ("text_p", "metadata_p", "quality_p")]


def _scored(df: DataFrame, model: TwoViews) -> DataFrame:
    """Adds the probabilities by text, by metadata and by both to (.., text, lang, source, n_chars)."""
    state = df.sparkSession.sparkContext.broadcast(vars(model))

    def start():
        chosen = TwoViews(**state.value)

        def score(*columns):
            made = [chosen.views(*row) for row in zip(*[c.to_pylist() for c in columns], strict=True)]
            return list(map(list, zip(*made))) or [[], [], []]

        return score

    return add_python_columns(df, ["text", "lang", "source", "n_chars"], _FIELDS, start)


def _packed(docs: DataFrame, text: str, metadata: Sequence[str]) -> DataFrame:
    lang, source, n_chars = metadata
    return packed(
        docs, text=F.col(f"`{text}`"), lang=F.col(f"`{lang}`").cast("string"), source=F.col(f"`{source}`").cast("string"),
        n_chars=F.col(f"`{n_chars}`").cast("long"),
    )


def score_documents(docs: DataFrame, model: TwoViews, id_column: str = "doc_id", text: str = "text",
                    metadata: Sequence[str] = METADATA, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, text_p, metadata_p, quality_p and kept (quality_p at least ``keep_from``).

    Null and empty texts, and null metadata, are scored like any others; repeated rows get equal scores; texts of any length
    are read whole. Nothing is shuffled. An empty table gives no rows; other columns are not looked at, whatever their names.
    """
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in metadata])
    return _scored(_packed(chosen, text, metadata), model).select(
        F.col("_row.doc_id").alias("doc_id"), "text_p", "metadata_p", "quality_p", (F.col("quality_p") >= keep_from).alias("kept")
    )


def keep_good(docs: DataFrame, model: TwoViews, text: str = "text", metadata: Sequence[str] = METADATA,
              keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose combined probability is at least ``keep_from``, with all their columns."""
    return unpacked(_scored(_packed(docs, text, metadata), model).where(F.col("quality_p") >= keep_from), docs.columns)
