"""Language identification: known words first, shorter and shorter character n-grams for unseen ones."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillflow.llm.shared import add_python_columns, settle

LONGEST = 5  # characters of the longest n-gram
# Shares of a language's own training words, and of its own n-grams of a length, from which an entry is kept. No table
# has more than 1 / share entries for each language, whatever the corpus, so the model can be broadcast.
WORD_SHARE = 2e-6
GRAM_SHARE = 2e-6
ADDED = 0.5
UNKNOWN = "und"
_CACHED_WORDS = 1 << 18
_FLUSH = 1 << 19
_UNSEEN_AT_ONCE = 1 << 12
_WORDS_AT_ONCE = 1 << 13

_LETTER = regex.compile(r"\p{L}")
_ASCII = bytes(b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of ASCII letters and non-ASCII characters."""
    return (text or "").lower().encode().translate(_ASCII).decode().split()


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks of its start and end; one of n characters or less is one n-gram."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _counted(df: DataFrame, update: Callable[[Counter, pa.RecordBatch], None], fields: str, at_once: int = 256) -> DataFrame:
    """(lang, .., n) rows counted in each task first, ``at_once`` rows at a time with a bounded table, then over all tasks."""
    keys = [f.split()[0] for f in fields.split(",")]

    def run(batches):
        def rows(seen):
            columns = list(zip(*seen)) or [[] for _ in keys]
            arrays = [pa.array(c, pa.int32() if k == "size" else pa.string()) for c, k in zip(columns, keys, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(seen.values()), pa.int64())], names=[*keys, "n"])

        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                update(seen, batch.slice(at, at_once))
                if len(seen) > _FLUSH:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    return df.mapInArrow(run, f"{fields}, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def _count_words(seen: Counter, batch: pa.RecordBatch) -> None:
    own: defaultdict[str, Counter] = defaultdict(Counter)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        own[lang].update(words_of(text))
    for lang, words in own.items():
        for word, n in words.items():
            seen[lang, word] += n


def _count_grams(longest: int) -> Callable[[Counter, pa.RecordBatch], None]:
    def update(seen: Counter, batch: pa.RecordBatch) -> None:
        own: dict[str, list[defaultdict[str, int]]] = {}
        for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if lang not in own:
                own[lang] = [defaultdict(int) for _ in range(longest)]
            for size, grams in enumerate(own[lang], 1):
                for gram in grams_of(word, size):
                    grams[gram] += n
        for lang, sizes in own.items():
            for size, grams in enumerate(sizes, 1):
                for gram, n in grams.items():
                    seen[lang, size, gram] += n

    return update


class Languages:
    """Log frequencies of words and n-grams by language, one row of ``table`` per entry; ``names`` in ascending order."""

    def __init__(self, names: list[str]):
        self.names = names
        self.words: dict[str, int] = {}
        self.grams: dict[int, dict[str, int]] = {}
        self.table = np.zeros((0, len(names)), np.float32)

    def add(self, size: int | None, rows: list[tuple[str, str, int]], totals: dict[str, int]) -> None:
        """Entries (lang, entry, n) of words (size None) or n-grams, with the total of each language."""
        index = self.words if size is None else self.grams.setdefault(size, {})
        start = len(self.table)
        for _, entry, _ in rows:
            index.setdefault(entry, start + len(index))
        counts = np.zeros((len(index), len(self.names)))
        column = {name: i for i, name in enumerate(self.names)}
        for lang, entry, n in rows:
            counts[index[entry] - start, column[lang]] += n
        whole = np.array([totals.get(name, 0) for name in self.names], float)
        logs = np.log((counts + ADDED) / (whole + ADDED * (len(index) + 1)))
        self.table = np.vstack([self.table, logs.astype(np.float32)])

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequencies of the longest n-grams of the word that are known at all; zeros if none is."""
        for size in sorted(self.grams, reverse=True):
            known = [i for g in grams_of(word, size) if (i := self.grams[size].get(g)) is not None]
            if known:
                return self.table[known].mean(axis=0)
        return np.zeros(len(self.names), np.float32)

    def unseen_rows(self, words: list[str]) -> np.ndarray:
        """:meth:`unseen` of many words, summed together."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        tables = [(size, self.grams[size].get) for size in sorted(self.grams, reverse=True)]
        for low in range(0, len(words), _UNSEEN_AT_ONCE):
            places, starts, rows = [], [], []
            for row, word in enumerate(words[low : low + _UNSEEN_AT_ONCE], low):
                for size, get in tables:
                    known = [i for g in grams_of(word, size) if (i := get(g)) is not None]
                    if known:
                        starts.append(len(places))
                        rows.append(row)
                        places += known
                        break
            if rows:
                sizes = np.diff([*starts, len(places)]).astype(np.float32)
                out[rows] = np.add.reduceat(self.table[places], starts, axis=0) / sizes[:, None]
        return out

    def predictor(self) -> Callable[[str | None], tuple[str, float]]:
        """A function that gives a text's language and its posterior probability with equal priors."""
        known = len(self.table)
        rows = np.vstack([self.table, np.zeros((_CACHED_WORDS, len(self.names)), np.float32)])
        index, used = dict(self.words), known  # known words, and behind them unseen ones as they come

        def learn(words: list[str]) -> None:
            nonlocal index, used
            new = [w for w in dict.fromkeys(words) if w not in index]
            if used + len(new) > len(rows):
                index, used = dict(self.words), known
                new = [w for w in dict.fromkeys(words) if w not in index]
            rows[used : used + len(new)] = self.unseen_rows(new)
            index.update(zip(new, range(used, used + len(new))))
            used += len(new)

        def predict(text: str | None) -> tuple[str, float]:
            if not self.names or not has_letter(text):
                return UNKNOWN, 0.0
            total = np.zeros(len(self.names))
            words = words_of(text)
            for at in range(0, len(words), _CACHED_WORDS // 2):  # a very long text in pieces that fit the cache
                some = words[at : at + _CACHED_WORDS // 2]
                places = np.fromiter(map(index.get, some, repeat(-1)), np.int64, len(some))
                if len(places) and places.min() < 0:
                    learn(some)
                    places = np.fromiter(map(index.get, some, repeat(-1)), np.int64, len(some))
                total += rows[places].sum(axis=0, dtype=np.float64)
            likely = np.exp(total - total.max())
            best = int(likely.argmax())
            return self.names[best], float(likely[best] / likely.sum())

        return predict

    @classmethod
    def of(cls, state: dict) -> Languages:
        made = cls([])
        vars(made).update(state)
        return made


def _kept(counted: DataFrame, entry: str, totals: dict[str, int], share: float) -> list[tuple[str, str, int]]:
    """(lang, entry, n) of every language for the entries that make up ``share`` of at least one language's own total.

    There are 1 / share entries a language at most.
    """
    if not totals:
        return []
    least = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, float(max(1, share * n)))])
    frequent = counted.where(F.col("n") >= F.element_at(least, F.col("lang"))).select(entry).distinct()
    rows = counted.join(frequent, entry, "left_semi").select("lang", entry, "n").orderBy("lang", entry).toArrow()
    return list(zip(*[c.to_pylist() for c in rows.columns], strict=True))


def train(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, word_share: float = WORD_SHARE,
          gram_share: float = GRAM_SHARE) -> Languages:
    """Count words by language over all rows with a language, and n-grams over the counted words.

    N-grams are counted on distinct words weighted by their counts, so that work does not grow with repetition. An entry
    stays if it makes up the stated share of the words, or of the n-grams of its length, of any one language, however
    little text that language has; what stays has the counts of all languages, so a zero in the model is a true zero.
    """
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    words = settle(_counted(known, _count_words, "lang string, word string"), "language_words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    model = Languages(sorted(totals))
    model.add(None, _kept(words, "word", totals, word_share), totals)
    grams = settle(_counted(words.select("lang", "word", "n"), _count_grams(longest), "lang string, size int, gram string", _WORDS_AT_ONCE), "language_grams")
    of_size: dict[int, dict[str, int]] = {}
    for r in grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect():
        of_size.setdefault(r["size"], {})[r["lang"]] = r["n"]
    for size in sorted(of_size):
        model.add(size, _kept(grams.where(F.col("size") == size), "gram", of_size[size], gram_share), of_size[size])
    return model


_FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names; only the text is looked at.

    A null text and one without a letter are ``und`` with score 0, and so is every text if no language was learned. Of
    equally likely languages the first in ascending order is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def start():
        one = Languages.of(shared.value).predictor()
        return lambda texts: list(map(list, zip(*map(one, texts.to_pylist())))) or [[], []]

    return add_python_columns(docs, [text], _FIELDS, start)


def held_out(id_column: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether the CRC of the id's text falls into ``fold``; no id has an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds == fold


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred and score, learned from what is not held out.

    Repeated rows count each, in learning too. Texts of any length are read whole. Without a row to learn from every text
    is ``und``; an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    fold = held_out(F.col(f"`{id_column}`"))
    model = train(docs.where(~fold), lang, text, **options)
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), fold.alias("held_out"), F.col(f"`{text}`").alias("text"))
    return predict(narrow, model).select("doc_id", "held_out", "lang_pred", "score")
