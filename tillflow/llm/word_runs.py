"""Periodic stretches of words ("runs"), from Lyndon arrays that the first phase of a suffix sorter gives."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillflow.llm.shared import add_python_columns, text_bytes

MIN_LENGTH = 12
WORDS_AT_ONCE = 1 << 17  # words of several texts that are searched together; a longer text is searched by itself
_SPACE = r"[\x20\x09-\x0D]+"
_LOOK = 16  # words that all candidates are compared at once, before single ones are followed further

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position.

    Suffixes are grouped by their first symbol, and groups are taken from the highest to the lowest. Each member of the
    taken group points to the nearest position before it that is in a lower group; the text from there up to the member is
    that position's word so far. Positions that as many members point to, out of the same group, have grown by as many
    copies of the taken group's word, and become a group of their own next above their old one. When a group is taken,
    its word is the longest Lyndon word at each of its members, which is what suffix sorting goes on from. Each position
    is taken once and moved at most once for each taken one, so the work is linear.
    """
    by_symbol = defaultdict(list)
    for i, c in enumerate(symbols):
        by_symbol[c].append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    group = [0] * len(symbols)
    for g, positions in enumerate(members):
        for i in positions:
            group[i] = g
    size = [len(m) for m in members]  # without those that have moved away
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    before = list(range(len(symbols) + 1))  # of i + 1: the next place at or before i that is not taken, plus one
    words = [0] * len(symbols)

    g = len(members) - 1
    while g >= 0:
        taken = members[g] if size[g] == len(members[g]) else [i for i in members[g] if group[i] == g]
        grown = length[g]
        for i in taken:
            words[i] = grown
            before[i + 1] = i
        pointed: dict[int, int] = {}
        for j in taken:
            while before[j] != j:  # follow and shorten the path
                before[j] = j = before[before[j]]
            if j:
                pointed[j - 1] = pointed.get(j - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moved.setdefault((group[p], times), []).append(p)
        # Those that grew more are higher, so they go first and the next ones come between them and the old group.
        for old, times in sorted(moved, reverse=True):
            moving = moved[old, times]
            if size[old] == len(moving):  # no member stays behind
                length[old] += times * grown
                continue
            new, up = len(members), above[old]
            members.append(moving)
            size.append(len(moving))
            size[old] -= len(moving)
            length.append(length[old] + times * grown)
            for p in moving:
                group[p] = new
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
        g = below[g]
    return words


def _extent(s: np.ndarray, a: int, b: int, step: int) -> int:
    """How many symbols agree from ``a`` and from ``b`` on (step 1) or back (step -1), by growing stretches."""
    room = len(s) - max(a, b) if step > 0 else min(a, b) + 1
    done, width = 0, _LOOK
    while done < room:
        width = min(width, room - done)
        x, y = a + step * done, b + step * done
        if step > 0:
            differs = s[x : x + width] != s[y : y + width]
        else:
            differs = (s[x - width + 1 : x + 1] != s[y - width + 1 : y + 1])[::-1]
        if differs.any():
            return done + int(differs.argmax())
        done, width = done + width, width * 4
    return done


def _near_extent(s: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """:func:`_extent` of many pairs at once, up to ``_LOOK``."""
    agree = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for at in range(_LOOK):
        x, y = a[open_] + step * at, b[open_] + step * at
        inside = (np.maximum(x, y) < len(s)) & (np.minimum(x, y) >= 0)
        open_, x, y = open_[inside], x[inside], y[inside]
        open_ = open_[s[x] == s[y]]
        agree[open_] = at + 1
        if not len(open_):
            break
    return agree


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` and two periods, in ascending order.

    A run has a Lyndon root that is the longest Lyndon word at its place under the order of the symbols or under the
    reverse order. So the longest Lyndon word at each place, under both, is compared with what follows and precedes it at
    its own length; it is the root of a run if both together agree over one more length. A place inside of a run already
    found for its length is left out, so agreeing text is walked once a run.
    """
    s = np.ascontiguousarray(symbols, np.int64)
    found: set[tuple[int, int, int]] = set()
    for ranks in (s, -s):
        q = np.array(lyndon_array(ranks.tolist()), np.int64)
        i = np.arange(len(s))
        inside = i + q < len(s)
        i, q = i[inside], q[inside]
        i, q = (x[s[i] == s[i + q]] for x in (i, q))  # the first place of a root in its run has this
        after, back = _near_extent(s, i, i + q, 1), _near_extent(s, i - 1, i + q - 1, -1)
        wanted = (after == _LOOK) | (back == _LOOK) | ((after + back >= q) & (after + back + q >= min_length))
        order = np.lexsort((i[wanted], q[wanted]))
        period, end = 0, -1
        for at, length, r, l in zip(*(x[wanted][order].tolist() for x in (i, q, after, back)), strict=True):
            if length == period and at + length <= end:
                continue
            if r == _LOOK:
                r = _extent(s, at, at + length, 1)
            if l == _LOOK:
                l = _extent(s, at - 1, at + length - 1, -1)
            if l + r >= length:
                period, end = length, at + length + r
                if length + l + r >= min_length:
                    found.add((at - l, length + l + r, length))
    return sorted(found)


def _repeating_stretches(ids: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches that can hold a run: maximal ones covered by windows of ``width`` words that occur
    twice in their text. ``bounds`` are the texts' ends in ``ids``.

    Windows are compared by a hash, so that a stretch may be found needlessly but none is missed.
    """
    n = len(ids)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bounds)), np.diff(np.append(0, bounds)))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    hashes = text[: n - width + 1].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    for k in range(width):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - width + 1 + k]
    inside = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    order = inside[np.argsort(hashes[inside], kind="stable")]
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(n + 1, np.int64)
    starts = order[np.append(same, False) | np.append(False, same)]
    twice[starts] += 1
    np.subtract.at(twice, starts + width, 1)
    covered = np.cumsum(twice[:-1]) > 0
    begins = covered & np.append(True, ~covered[:-1] | (text[1:] != text[:-1]))
    stops = covered & np.append(~covered[1:] | (text[1:] != text[:-1]), True)
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words.

    In a run of length n and period q, n >= 2q, each word lies in one of two equal windows of n - q >= min_length / 2
    words that are q apart. Only stretches covered by windows that occur twice in their text are searched, all of them in
    one string with a symbol of its own after each, which no run can contain.
    """
    number = defaultdict(count().__next__)
    ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in texts]
    bounds = np.cumsum([len(x) for x in ids])
    joined = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    width = max(1, (min_length + 1) // 2)
    starts, ends = _repeating_stretches(joined, bounds, width)
    long = ends - starts >= min_length
    starts, ends = starts[long], ends[long]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(starts):
        return out
    sizes = ends - starts + 1
    places = np.cumsum(sizes) - sizes
    parts = []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        parts += [joined[a:b], np.array([len(number) + k])]
    owners = np.searchsorted(bounds, starts, side="right")
    firsts = bounds - [len(x) for x in ids]
    for at, length, period in runs_of(np.concatenate(parts), min_length):
        k = int(np.searchsorted(places, at, side="right")) - 1
        owner = int(owners[k])
        out[owner].append((at - int(places[k]) + int(starts[k] - firsts[owner]), length, period))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that any run contains after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped)[:-1].tolist(), strict=True) if not d]


def _groups(texts: list[bytes | None], words_at_once: int) -> Iterator[list[list[bytes]]]:
    """Words of the texts, a bounded number at a time."""
    held, size = [], 0
    for text in texts:
        words = (text or b"").split()
        if held and size + len(words) > words_at_once:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words, by start and period) and collapsed, the text's words
    joined by a space without those that a run repeats. Columns of these names are replaced.

    Words end at ASCII white space. A run is a maximal stretch of smallest period q and a length of at least
    ``min_length`` and 2q. Null, empty and blank texts have no words, no runs and an empty collapsed text. Texts of any
    length are searched whole, each in one task; repeated rows each for itself; an empty table gives no rows. Nothing is
    shuffled.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]

    def start():
        def work(column):
            sizes, runs, kept = [], [], []
            for group in _groups(text_bytes(column), WORDS_AT_ONCE):
                for words, found in zip(group, find_runs(group, min_length), strict=True):
                    sizes.append(len(words))
                    runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                    kept.append(b" ".join(without_repeats(words, found)))
            return sizes, runs, pa.array(kept, pa.binary()).cast(pa.string())

        return work

    return add_python_columns(docs, [text], fields, start)


def plant_period(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with a tail of words of every tenth id, by its CRC-32, made periodic.

    With h the checksum, g = h / 10 and n words, the tail begins at g % n and has the period 1 + (n - g % n) / (3 + g % 8).
    Rows without an id keep their text.
    """
    doc_id, content = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.array_remove(F.split(F.coalesce(content, F.lit("")), _SPACE), ""))
    marked = docs.select(doc_id.alias("doc_id"), content.alias("text"), F.floor(h / 10).cast("long").alias("g"), words.alias("w"))
    n = F.size("w").cast("long")
    placed = marked.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long")
    tail = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    # The tail is as many copies of its first period as fill it, cut to its length.
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    filled = F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    head = F.slice("w", F.lit(1), F.col("a").cast("int"))
    made = F.array_join(F.concat(head, filled), " ")
    return placed.withColumn("p", period).select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_runs, the longest run (ties: smallest start, then period) and digests of
    all runs and of the collapsed text. Without a run its four columns are null."""
    found = collapse_runs(docs.select("doc_id", "text"), "text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    told = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    length, period = F.col("best.length"), -F.col("best.period")
    return told.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
