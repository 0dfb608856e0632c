"""Token counts by byte-pair merging with a heap of adjacent pairs over linked symbols."""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from unicodedata import normalize
from zlib import crc32

import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tillflow.llm.shared import add_python_columns, text_bytes, worker_cache

LIMIT_TOKENS = 2048
CACHED_WORDS = 1 << 19  # entries that a worker keeps at most

# The spaces, and the split pattern, that a tokenizer file of this kind has to name.
SPACES = regex.compile(r"\s+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Maps a piece of text without ASCII white space, as UTF-8 bytes, to its number of tokens; fills itself.

    ``config`` is the parsed file of a byte-level tokenizer with lower-casing, a split pattern and word ends.
    """

    def __init__(self, config: dict):
        super().__init__()
        self.ranks = {tuple(m): i for i, m in enumerate(config["merges"])}
        self.end = config["end"]
        self.pattern = regex.compile(config["pattern"])
        self.special = re.compile("|".join(map(re.escape, config["special"]))) if config["special"] else None
        self.symbols = _byte_symbols()

    def word(self, word: str) -> int:
        """Tokens of one word: its bytes as symbols, less the merges.

        The heap holds every adjacent pair that can merge, lowest rank first and leftmost of equals. A popped pair is
        stale if one of its symbols has changed since.
        """
        parts = [self.symbols[b] for b in word.encode()]
        parts[-1] += self.end
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        left = n
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j >= n or parts[i] is None or rank_of((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h))
        return left

    def __missing__(self, piece: bytes) -> int:
        text, total = piece.decode(), 0
        if self.special and self.special.search(text):
            total += len(self.special.findall(text))
            plain = self.special.split(text)
        else:
            plain = [text]
        for part in plain:
            if not part.isascii():
                part = SPACES.sub(" ", normalize("NFC", part))
                part = "".join([c.lower() for c in part])  # character by character: no final sigma
            else:
                part = part.lower()
            total += sum(map(self.word, self.pattern.findall(part)))
        self[piece] = total
        return total

    def count(self, text: bytes | None) -> int:
        """Tokens of a text. White space is dropped, so the pieces between ASCII white space count for themselves."""
        if len(self) > CACHED_WORDS:
            self.clear()
        return sum(map(self.__getitem__, (text or b"").split()))


def read_tokenizer(path: str) -> dict:
    """What counting needs of a tokenizer file; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        raw = json.load(file)
    steps = raw["pre_tokenizer"]["pretokenizers"]
    return {
        "merges": [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in raw["model"]["merges"]],
        "end": raw["model"]["end_of_word_suffix"],
        "pattern": next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"),
        "special": [t["content"] for t in raw["added_tokens"]],
    }


_FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (of the UTF-8 text) and n_tokens, which replace columns of these names.

    A null text is empty: 0 bytes and tokens. Special strings in a text are one token each. Each distinct piece is merged
    once per worker and looked up from then on. Nothing is shuffled.
    """
    config = read_tokenizer(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast(config)
    name = f"merge_counter_{crc32(json.dumps(config).encode())}"

    def start():
        counter = worker_cache(name, lambda: MergeCounter(shared.value))

        def count(column):
            texts = text_bytes(column)
            return [len(t or b"") for t in texts], [counter.count(t) for t in texts]

        return count

    return add_python_columns(docs, [text], _FIELDS, start, name)


def token_report(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Repeated rows count each; a text of any length is counted whole, in one task; other columns are not looked at, whatever
    their names; an empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return count_tokens(narrow, tokenizer_path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
