"""Packing documents into windows by multiway differencing."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from tillflow.llm.shared import add_python_columns, settle, worker_cache

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 1000  # pieces that are differenced together; bounds a task's memory and time at any size of input
CACHED_WORDS = 1 << 18  # pieces that a worker remembers; the often used ones stay when there are more
_MARK = b"\x1e"
_LATIN_END, _DOTTED_I = "\u0250", "\u0130"  # below, characters are composed, and all but one have one lower case
_WORDS_AT_ONCE = 1024
_BYTES_AT_ONCE = 1 << 20


class TokenIds:
    """Ids of whole texts, by way of the tokenizer's ids for each distinct piece between ASCII white space.

    For a tokenizer that drops white space, never looks across it, and marks word ends in its vocabulary. Pieces of plain
    Latin characters are split as its file says, and go to a copy of it that only splits at white space: most of the
    library's time goes into normalizing and matching. Other pieces go to it as they are, and so do whole texts that hold
    one of its special strings.
    """

    def __init__(self, config: str):
        raw = json.loads(config)
        self.tokenizer = Tokenizer.from_str(config)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self._encode(_MARK)
        split, byte_level = raw["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(r"\n|" + split["pattern"]["Regex"])
        plain = raw | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        end = raw["model"]["end_of_word_suffix"]
        vocabulary = raw["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint16)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)

    def forget(self) -> None:
        """Keep the pieces that were used most since the last time, half of the limit at most."""
        names, at = list(self.place), np.fromiter(self.place.values(), np.int64, len(self.place))
        uses, most = self.uses[at], CACHED_WORDS // 2
        least = max(2, int(np.partition(uses, -most)[-most]) + 1) if len(uses) > most else 2
        kept = np.flatnonzero(uses >= least)
        ids, sizes = self._gather(at[kept])
        self.clear()
        self._add([names[i] for i in kept.tolist()], ids, sizes)

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember pieces, whose ids follow each other."""
        at = len(self.sizes)
        self.place.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int32)])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered pieces one after the other, and their numbers."""
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[at] - ends + sizes, sizes)], sizes

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _words(self, pieces: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The words of pieces of plain Latin characters, as the tokenizer splits them, and their numbers."""
        found = self.words.findall(b"\n".join(pieces).decode().lower())
        counts = np.diff(np.flatnonzero(np.array([True, *[w == "\n" for w in found], True]))) - 1
        return [w for w in found if w != "\n"], counts

    def _learn_words(self, words: list[bytes]) -> None:
        """Ids of words that the tokenizer does not split or change, each by itself."""
        ids = []
        for at in range(0, len(words), _WORDS_AT_ONCE):
            text = b" ".join(words[at : at + _WORDS_AT_ONCE]).decode()
            ids += self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids
        joined = np.array(ids, np.uint16)
        ends = np.flatnonzero(self.ends[joined])
        if len(ends) != len(words):
            raise ValueError("The tokenizer does not mark word ends.")
        self._add(words, joined, np.diff(np.append(-1, ends)))

    def _learn_any(self, pieces: list[bytes]) -> None:
        """Ids of any pieces, which go to the tokenizer with a mark between any two."""
        marked = self._encode((b" " + _MARK + b" ").join(pieces))
        ends = np.append(np.flatnonzero(marked == self.mark[0]), len(marked))
        if len(ends) != len(pieces):
            raise ValueError("The tokenizer looks across white space.")
        self._add(pieces, np.delete(marked, ends[:-1]).astype(np.uint16), np.diff(np.append(-1, ends)) - 1)

    def learn(self, new: list[bytes]) -> None:
        """Ids of pieces not seen before. Pieces of several words are put together from the words' ids."""
        letters = [p for p in new if p.isalpha()]  # of bytes: A-Z and a-z only
        others = [p for p in new if not p.isalpha()]
        text = b"".join(others).decode()
        if text and (max(text) >= _LATIN_END or _DOTTED_I in text):
            foreign = [max(t, default="") >= _LATIN_END or _DOTTED_I in t for t in map(bytes.decode, others)]
        else:
            foreign = [False] * len(others)
        latin, left = ([p for p, f in zip(others, foreign, strict=True) if f is wanted] for wanted in (False, True))
        words, counts = self._words(latin) if latin else ([], np.zeros(0, np.int64))
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        distinct = list(map(str.encode, number))
        unknown = dict.fromkeys(letters)
        unknown.update(dict.fromkeys(w for w in distinct if w not in self.place))
        if unknown:
            self._learn_words(list(unknown))
        if latin:
            places = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
            at = places[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
            np.add.at(self.uses, at, 1)
            ids, sizes = self._gather(at)
            ends = np.append(0, np.cumsum(sizes))[np.cumsum(np.append(0, counts))]
            self._add(latin, ids, np.diff(ends))
        if left:
            self._learn_any(left)

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, null being empty, and where each text's begin and end. Arrow splits the
        texts and numbers their distinct pieces."""
        if len(self.place) > CACHED_WORDS:
            self.forget()
        lowered = pc.ascii_lower(column.fill_null(""))
        whole = np.zeros(len(column), bool)
        for text in (*self.special, _MARK):
            whole |= pc.match_substring(lowered, text.decode()).to_numpy(zero_copy_only=False)
        pieces = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", lowered) if whole.any() else lowered)
        numbered = pieces.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # with the empty piece, which has no ids
        self.learn([p for p in distinct if p not in self.place])
        places = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        numbers = numbered.indices.to_numpy()
        np.add.at(self.uses, places, np.bincount(numbers, minlength=len(distinct)).astype(np.int32))
        ids, sizes = self._gather(places[numbers])
        cuts = np.append(0, np.cumsum(sizes))[np.cumsum(np.append(0, pc.list_value_length(pieces).to_numpy()))]
        if not whole.any():
            return ids, cuts
        parts = [self._encode(column[i].as_py().encode()) if special else ids[cuts[i] : cuts[i + 1]] for i, special in enumerate(whole)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def of(self, texts: Sequence[bytes | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, cuts = self.flat(pa.array(texts, pa.binary()).cast(pa.string())) if texts else (np.zeros(0), np.zeros(1, np.int64))
        return [ids[a:b].astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _by_size(column: pa.Array) -> Iterator[pa.Array]:
    """A text column in parts of a bounded size, which bounds the memory for their pieces; a larger text is a part."""
    begin, size = 0, 0
    for at, length in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        size += length
        if size > _BYTES_AT_ONCE:
            yield column.slice(begin, at + 1 - begin)
            begin, size = at + 1, 0
    if begin < len(column):
        yield column.slice(begin)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest."""
    _, start, length = _cuts(np.array([n]), capacity)
    return list(zip(start.tolist(), length.tolist(), strict=True))


def _cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of such sizes, as by :func:`cut_points`."""
    counts = -(-sizes // capacity)
    document = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
    return document, start, np.minimum(capacity, sizes[document] - start)


_PIECE = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
]))
_FIELDS = [T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", _PIECE), T.StructField("piece_ids", T.ArrayType(T.BinaryType()))]


def tokenize_and_cut(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                     with_ids: bool = False) -> DataFrame:
    """``docs`` with doc_tokens, pieces (start, length, ids_crc32) and, if asked for, piece_ids (little-endian 32-bit).

    A document's ids are its text's and ``end_id``, so a null or empty text is one id.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        config = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(config)
    name = f"token_ids_{crc32(config.encode())}"

    def start():
        ids_of = worker_cache(name, lambda: TokenIds(shared.value))

        def cut_group(group: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
            ids, cuts = ids_of.flat(group)
            full = np.insert(ids.astype("<u4"), cuts[1:], end_id)
            sizes = np.diff(cuts) + 1
            document, begin, length = _cuts(sizes, capacity)
            raw, at = memoryview(full).cast("B"), 4 * ((np.cumsum(sizes) - sizes)[document] + begin)
            spans = list(zip(at.tolist(), (at + 4 * length).tolist(), strict=True))
            checks = pa.array([crc32(raw[a:b]) for a, b in spans], pa.int64())
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(document, minlength=len(sizes)))), pa.int32())
            piece = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(length, pa.int64()), checks], names=["start", "length", "ids_crc32"])
            kept = pa.nulls(len(sizes), pa.list_(pa.binary()))
            if with_ids:
                kept = pa.ListArray.from_arrays(offsets, pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
            return pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, piece), kept

        def cut(column):
            made = [cut_group(group) for group in _by_size(column)]
            return [pa.concat_arrays(arrays) for arrays in zip(*made, strict=True)] if made else [[], [], []]

        return cut

    return add_python_columns(docs, [text], _FIELDS, start, name)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size by Karmarkar-Karp differencing into ``windows`` subsets.

    Each partial partition is its subset sums in descending order, less the smallest. The two with the widest spread are
    merged, the largest subset of one with the smallest of the other. Afterwards the merges are undone from the last to
    the first, to tell in which window each subset has ended up.
    """
    n = len(sizes)
    sums = {}
    for i, size in enumerate(sizes.tolist()):
        sums[i] = np.zeros(windows, np.int64)
        sums[i][0] = size
    heap = [(-int(s), i) for i, s in enumerate(sizes)] if windows > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-merged, kind="stable")
        made = n + len(merges)
        sums[made] = merged[order] - merged.min()
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(sums[made][0]), made))
    windows_of = {n + len(merges) - 1: np.arange(windows)}
    for made in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[made - n]
        of_a = np.empty(windows, np.int64)
        of_a[order] = windows_of.pop(made)
        windows_of[a], windows_of[b] = of_a, of_a[::-1]
    return np.array([windows_of[i][0] for i in range(n)], np.int64)


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none larger than ``capacity``: from the fewest that could do, one more window whenever
    the fullest exceeds the capacity."""
    windows = max(1, ceil(int(sizes.sum()) / capacity))
    while True:
        place = difference(sizes, windows)
        if len(sizes) <= windows or np.bincount(place, weights=sizes).max() <= capacity:
            return place
        windows += 1


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset, with the ids if asked for.

    Documents are cut at every ``capacity`` ids, so full pieces are sequences of their own; the rests are dealt into
    groups of about ``group_pieces`` by their position in the written table of pieces, whatever their ids or texts are,
    and each group is differenced in a task. Repeated rows are packed each for itself. A null, empty or blank text is one
    id. A very long text is one step of a task, which holds it and a few copies of its ids. An empty table gives no rows;
    other columns are not looked at, whatever their names.
    """
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    cut = tokenize_and_cut(narrow, tokenizer_path, "text", capacity, end_id, with_ids)
    ids = [F.get("piece_ids", F.col("piece")).alias("ids")] if with_ids else []
    columns = ["doc_id", "doc_tokens", F.posexplode("pieces").alias("piece", "p")]
    exploded = cut.select(*columns, "piece_ids").select(
        "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", *ids
    )
    pieces = settle(exploded.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rests = F.col("length") < capacity
    whole = pieces.where(~rests).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = pieces.where(rests)
    groups = max(1, ceil(parts.count() / group_pieces))
    schema = "row long, sequence_id long, offset long"

    def pack_group(table: pa.Table) -> pa.Table:
        rows, sizes = table["row"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(rows)
        rows, sizes = rows[order], sizes[order]
        place = pack_sizes(sizes, capacity)
        by_window = np.argsort(place, kind="stable")
        ends = np.cumsum(sizes[by_window])
        starts = ends - sizes[by_window]
        first = np.append(True, np.diff(place[by_window]) != 0)
        offsets = starts - np.repeat(starts[first], np.diff(np.append(np.flatnonzero(first), len(starts))))
        heads = np.repeat(rows[by_window][first], np.diff(np.append(np.flatnonzero(first), len(starts))))
        return pa.table({"row": rows[by_window], "sequence_id": heads, "offset": offsets})

    placed = (
        parts.select("row", "length").groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
        .applyInArrow(pack_group, schema)
    )
    # A sequence is named by the row number of the first piece in it, so names need no numbering pass.
    packed_parts = parts.join(placed, "row")
    return whole.unionByName(packed_parts).drop("row").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])
    )
