"""Benchmark decontamination with a broadcast set of normalised test n-grams."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import reduce
from itertools import count, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tillflow.llm.shared import add_python_columns, packed, settle, text_bytes, unpacked

WINDOW_WORDS = 10
# UTF-8 bytes of test text in one broadcast set, which takes some 200 MB at most; a larger test set is scanned in several
# such blocks.
BLOCK_BYTES = 8 << 20
# A document loses the spans it shares with the test set, and goes as a whole beyond this share of its words.
DROP_SHARE = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


class WindowSet:
    """Windows of test items as arrays: a sorted hash, the item and the place of its words for each, and all words' numbers.

    20 bytes a word of the test set, and its distinct words. A scan looks hashes up and compares the words themselves.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW_WORDS):
        number = defaultdict(count(1).__next__)
        rng = np.random.default_rng(0)
        self.powers = rng.integers(1, 1 << 63, window, dtype=np.uint64) | np.uint64(1)
        self.names = [name for name, _ in items]
        ids = [np.fromiter(map(number.__getitem__, words_of(text)), np.uint32) for _, text in items]
        self.vocabulary = dict(number)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        lengths = np.array([len(x) for x in ids], np.int64)
        begins = np.cumsum(lengths) - lengths
        self.hashes, self.owners, self.places = {}, {}, {}
        for size in np.unique(np.minimum(lengths, window)).tolist():
            if size:
                self._add(size, np.flatnonzero(np.minimum(lengths, window) == size), begins, lengths)

    def _add(self, size: int, items: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        """The windows of ``size`` words of some items, an item's equal ones once."""
        counts = lengths[items] - size + 1
        owner = np.repeat(items, counts).astype(np.int32)
        place = np.repeat(begins[items], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes = self._hash([self.ids[place + k].astype(np.uint64) for k in range(size)], size)
        order = np.lexsort((place, owner, hashes))
        hashes, owner, place = hashes[order], owner[order], place[order].astype(np.uint32)
        again = np.append(False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
        for at in np.array_split(np.flatnonzero(again), max(1, int(again.sum()) // 65536)):
            rows = np.arange(size, dtype=np.int64)
            alike = self.ids[place[at][:, None] + rows] == self.ids[place[at - 1][:, None] + rows]
            again[at] = alike.all(axis=1)
        self.hashes[size], self.owners[size], self.places[size] = hashes[~again], owner[~again], place[~again]

    @classmethod
    def of(cls, state: dict) -> WindowSet:
        """From ``vars()`` of another: only plain values are broadcast."""
        made = cls([])
        vars(made).update(state)
        return made

    def _hash(self, columns, size: int) -> np.ndarray:
        total = columns[0] * self.powers[0]
        for k in range(1, size):
            total = total + columns[k] * self.powers[k]
        return total

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges [from, to) inside occurrences, merged and ascending, and the items that occur."""
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, n)
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        found, items = [], set()
        for size, hashes in self.hashes.items():
            if n < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            keys = self._hash([ids[starts + k] for k in range(size)], size)
            low, high = np.searchsorted(hashes, keys), np.searchsorted(hashes, keys, side="right")
            for at in np.flatnonzero(high > low).tolist():
                i, of = int(starts[at]), slice(int(low[at]), int(high[at]))
                own = self.ids[self.places[size][of].astype(np.int64)[:, None] + np.arange(size)]
                owners = self.owners[size][of][(own == ids[i : i + size]).all(axis=1)]  # verified word by word
                if len(owners):
                    found.append((i, i + size))
                    items.update(self.names[k] for k in owners.tolist())
        return _merged(found), items


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The test set in parts of about ``block_bytes``; one, unless it is larger."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, ceil(size / block_bytes))
    if parts == 1:
        return [rows]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    return [rows.where(part == i) for i in range(parts)]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
_FIELDS = [
    T.StructField("words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType())),
]


_CLEAN, _CUT = T.StructField("clean", T.StringType()), T.StructField("cut", T.BooleanType())


def mark_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """(row, words, spans, items): each whole document row with its number of words, the word ranges that lie inside
    an occurrence of a test window, and the ids of the test items that occur.

    A window is ``window`` consecutive words of a test item; an item of fewer words is one window. The set is broadcast
    in blocks of a stated size and documents are scanned where they are read, without a shuffle; after each block but
    the last, what was found is written to the shared folder. Null texts and items have no words; a null item id marks
    words and is not listed; repeated items count once.
    """
    spark: SparkSession = docs.sparkSession
    out = packed(docs, text=F.col(f"`{text}`"), spans=F.array().cast(_SPAN), items=F.array().cast("array<string>"))
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    if clean and len(blocks) > 1:
        raise ValueError("Texts are cut in the same pass for a set of one block only.")
    for i, block in enumerate(blocks):
        rows = [(r["item"], (r["text"] or "").encode()) for r in block.collect()]  # of bounded size, see _blocks
        windows = spark.sparkContext.broadcast(vars(WindowSet(rows, window)))

        def start(windows=windows):
            chosen = WindowSet.of(windows.value)

            def scan(texts, spans, items):
                counts, ranges, ids, texts_left = [], [], [], []
                for t, before, known in zip(text_bytes(texts), spans.to_pylist(), items.to_pylist(), strict=True):
                    words = words_of(t)
                    found, owners = chosen.scan(words)
                    counts.append(len(words))
                    ranges.append([{"start": a, "stop": b} for a, b in _merged(found + [(s["start"], s["stop"]) for s in before])])
                    ids.append(sorted(owners.union(known) - {None}))
                    if clean:
                        texts_left.append(without_spans(t.decode(), chosen) if found else t and t.decode())
                return (counts, ranges, ids, texts_left) if clean else (counts, ranges, ids)

            return scan

        out = add_python_columns(out, ["text", "spans", "items"], [*_FIELDS, _CLEAN] if clean else _FIELDS, start)
        if i < len(blocks) - 1:
            out = settle(out, "spans").drop("words")
    return out


def _hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    n_hit counts the words inside occurrences; items_sha256 is of the sorted item ids, comma-joined (of the empty text
    if none occurs). See :func:`mark_spans`.
    """
    marked = mark_spans(docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{options.pop('text', 'text')}`").alias("text")),
                        benchmark, **options)
    return marked.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("words").alias("n_words"),
        _hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: str, windows: WindowSet) -> str:
    """``text`` without the words of occurrences and what lies between them.

    What is left is scanned again, as a cut can bring words together that are a window.
    """
    raw = text.encode()
    while True:
        at = [m.span() for m in _WORD.finditer(raw.lower())]
        found, _ = windows.scan(words_of(raw))
        if not found:
            return raw.decode()
        kept, last = [], 0
        for low, high in found:
            kept.append(raw[last : at[low][0]])
            last = at[high - 1][1]
        raw = b"".join([*kept, raw[last:]])


def _cut_all(kept: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """(_row, clean, changed) with the spans of all blocks cut from ``clean``. Each block's pass is written, so that a stage
    holds the Python workers of one pass, however many blocks there are."""
    spark = kept.sparkSession
    open_, finished = settle(kept.withColumn("open", F.col("changed")), "marked"), []
    while True:
        passed = open_.withColumn("cut", F.lit(False))
        for block in blocks:
            rows = [(r["item"], (r["text"] or "").encode()) for r in block.collect()]
            windows = spark.sparkContext.broadcast(vars(WindowSet(rows, window)))

            def start(windows=windows):
                chosen = WindowSet.of(windows.value)

                def cut(texts, scanned, before):
                    old = texts.to_pylist()
                    new = [without_spans(t, chosen) if s else t for t, s in zip(old, scanned.to_pylist(), strict=True)]
                    return new, [c or n != t for c, n, t in zip(before.to_pylist(), new, old, strict=True)]

                return cut

            passed = settle(add_python_columns(passed, ["clean", "open", "cut"], [_CLEAN, _CUT], start), "cut")
        finished.append(passed.where(~F.col("cut")))
        open_ = passed.where("cut").drop("cut")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, [f.select("_row", "clean", "changed") for f in finished])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = "n_chars",
                  drop_share: float = DROP_SHARE, **options) -> DataFrame:
    """``docs`` without what they share with the test set, all columns kept.

    Words inside occurrences are cut from the text and ``n_chars`` is counted anew. A document goes as a whole if more
    than ``drop_share`` of its words lie inside. Other rows, null and empty texts included, stay as they are. Spans are
    cut block by block, until a pass over all blocks finds nothing; a pass after the first reads only the rows that the
    one before it has cut.
    """
    names = docs.columns
    item, item_text = options.get("item", "item_id"), options.get("item_text", "text")
    blocks = _blocks(benchmark, item, item_text, options.get("block_bytes", BLOCK_BYTES))
    single = len(blocks) == 1
    marked = mark_spans(docs, benchmark, text, clean=single, **options)
    kept = marked.where(_hit() <= F.col("words") * drop_share).select(
        "_row", F.col("clean" if single else "text").alias("clean"), (F.size("spans") > 0).alias("changed")
    )
    if not single:
        kept = _cut_all(kept, blocks, options.get("window", WINDOW_WORDS))
    columns = {text: F.col("clean")}
    if n_chars in names:
        columns[n_chars] = F.when(F.col("changed"), F.char_length("clean").cast("long")).otherwise(F.col(f"_row.`{n_chars}`"))
    return unpacked(kept, names, **columns).select(*[f"`{c}`" for c in names])
