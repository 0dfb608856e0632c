"""Quality rules: a hashed n-gram classifier learned from labelled rows, beside fixed rules on the words of a text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillflow.llm.linear import TEXT_DIM, bounded_labels, calibrate, fit_text, hashed_ngrams, sigmoid, sparse_row, take_texts, text_margin
from tillflow.llm.shared import add_python_columns, packed, share_of, tidy_worker, unpacked

TRAIN_ROWS = 8192  # bound of the labelled sample; a fifth of it only calibrates
SHARDS = 4
KEEP_FROM = 0.5  # calibrated probability of good quality
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

_BLANK = " \t\n\x0b\x0c\r"


@dataclass
class TextModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, text: str | None) -> float:
        return float(sigmoid(self.slope * text_margin(self.weights, self.bias, text) + self.offset))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", good: str = "quality",
          train_rows: int = TRAIN_ROWS, shards: int = SHARDS) -> TextModel:
    """Learn from about ``train_rows`` labelled documents, chosen by a hash of their id.

    Each shard of the sample is fitted in a task of its own and the weights are averaged (Zinkevich et al. 2010). A
    held-out fifth of the sample calibrates the averaged model. Without both classes, every text gets the share of good
    labels, or 1 if there are none.
    """
    chosen = bounded_labels(labels, id_column, F.col(f"`{good}`") > 0, train_rows, 301)
    rows = take_texts(docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").alias("text")), id_column, chosen, ["text"])
    rows = rows.select(
        "id", "label", F.col("row.text").alias("text"), (share_of(F.col("id"), 302) < 0.2).alias("held_out"),
        F.floor(share_of(F.col("id"), 303) * shards).cast("int").alias("shard"),
    )
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = 1.0 if not counts or 1 in counts else 0.0
        return TextModel(np.zeros(TEXT_DIM, np.float32), 0.0, 0.0, 35.0 if share else -35.0)

    def fit_shard(table: pa.Table) -> pa.Table:
        with tidy_worker():
            return fitted_shard(table)

    def fitted_shard(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array([str(i) for i in table["id"].to_pylist()]), kind="stable")
        texts, marks = table["text"].to_pylist(), table["label"].to_pylist()
        weights, bias = fit_text([sparse_row(hashed_ngrams(texts[i])) for i in order], np.array([marks[i] for i in order]))
        used = np.flatnonzero(weights)
        return pa.table({
            "ids": pa.array([used.astype(np.int32).tobytes()], pa.binary()),
            "weights": pa.array([weights[used].astype(np.float32).tobytes()], pa.binary()),
            "bias": pa.array([bias], pa.float64()), "n": pa.array([len(texts)], pa.int64()),
        })

    fitted = (
        rows.where(~F.col("held_out")).select("id", "label", "text", "shard")
        .groupBy("shard").applyInArrow(fit_shard, "ids binary, weights binary, bias double, n long").collect()
    )
    weights, bias, total = np.zeros(TEXT_DIM), 0.0, sum(r["n"] for r in fitted)
    for r in fitted:
        weights[np.frombuffer(r["ids"], np.int32)] += np.frombuffer(r["weights"], np.float32) * (r["n"] / total)
        bias += r["bias"] * r["n"] / total
    weights = weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        return lambda texts: [[text_margin(shared.value, bias, t) for t in texts.to_pylist()]]

    held = add_python_columns(rows.where("held_out").select("label", "text"), ["text"], [T.StructField("margin", T.DoubleType())], start)
    pairs = held.select("label", "margin").collect()  # a fifth of the bounded sample
    slope, offset = calibrate([r["margin"] for r in pairs], [r["label"] for r in pairs])
    return TextModel(weights, bias, slope, offset)


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated three-word windows)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    blank = sum(map(text.count, _BLANK))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), -1
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


_FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("quality", T.DoubleType()),
]


def _judged(packed_docs: DataFrame, model: TextModel, keep_from: float) -> DataFrame:
    """Adds the statistics, ``quality``, ``base_failed`` and ``kept`` to (.., text), one Arrow batch after another."""
    context = packed_docs.sparkSession.sparkContext
    weights = context.broadcast(model.weights)
    bias, slope, offset = model.bias, model.slope, model.offset

    def start():
        chosen = TextModel(weights.value, bias, slope, offset)

        def judge(texts):
            raw = texts.to_pylist()
            columns = list(map(list, zip(*map(text_statistics, raw)))) or [[]] * 5
            return [*columns, list(map(chosen.probability, raw))]

        return judge

    judged = add_python_columns(packed_docs, ["text"], _FIELDS, start)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= keep_from))


def quality_report(docs: DataFrame, model: TextModel, id_column: str = "doc_id", text: str = "text",
                   keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: its id as doc_id, the statistics, base_failed, quality (the calibrated probability) and kept.

    Null and empty texts have no words and fail. Nothing is shuffled; equal rows have equal results, and texts of any length are
    read whole. An empty table gives no rows; other columns are not looked at, whatever their names.
    """
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _judged(narrow, model, keep_from).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def keep_good(docs: DataFrame, model: TextModel, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return unpacked(_judged(packed(docs, text=F.col(f"`{text}`")), model, keep_from).where("kept"), docs.columns)
