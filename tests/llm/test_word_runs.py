import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD_ROWS, rows
from tillflow.llm import word_runs


def brute_lyndon(s):
    """The longest start of each suffix that is smaller than all its own proper suffixes."""
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def brute_runs(s, least):
    """For each period, maximal stretches of agreement with the word one period on; smaller periods excluded."""
    found = set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, 2 * q) and not any(s[i : j + q - p] == s[i + p : j + q] for p in range(1, q)):
                found.add((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w, 12)
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{i},{n},{q}\n" for i, n, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def as_sorted(found):
    return sorted(found, key=lambda r: [(v is None, str(v)) for v in r])


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=24)))
def test_lyndon_arrays(symbols):
    assert word_runs.lyndon_array(symbols) == brute_lyndon(symbols)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 5)), max_size=8), st.sampled_from([2, 5, 12]))
def test_runs_of_repeated_blocks(blocks, least):
    s = [x for block, times in blocks for x in block * times]
    assert word_runs.runs_of(np.array(s, np.int64), least) == brute_runs(s, least)


def test_runs_of_several_texts():
    """Texts that are searched together do not touch each other."""
    rng = random.Random(3)
    for _ in range(200):
        texts = []
        for _ in range(4):
            base = [b"%d" % rng.randrange(rng.choice([2, 6, 40])) for _ in range(rng.randrange(30))]
            at, p = rng.randrange(len(base) + 1), rng.randrange(1, 9)
            texts.append(base[:at] + base[at : at + p] * rng.randrange(1, 6) + base[at:])
        assert word_runs.find_runs(texts) == [brute_runs(t, 12) for t in texts]


def test_long_texts():
    """Linear, not quadratic: one symbol, a long period, and words of an unbalanced kind."""
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 100_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert word_runs.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert word_runs.runs_of(np.arange(200_000) % 70_001) == [(0, 200_000, 70_001)]
    s = fibonacci[1]
    found = word_runs.runs_of(np.array(s))
    assert all(s[i : i + n - q] == s[i + q : i + n] for i, n, q in found[:: len(found) // 50])
    assert word_runs.runs_of(np.array(s[:400])) == brute_runs(s[:400], 12)


def test_odd_rows(odd):
    made = word_runs.run_report(word_runs.plant_period(odd))
    assert made.columns == list(COLUMNS)
    # Brute force takes too long for the very long text; test_long_texts has such.
    kept = made.where("doc_id IS NULL OR doc_id != 6")
    assert rows(kept, *COLUMNS) == as_sorted(expected(r[0], r[1]) for r in ODD_ROWS if r[0] != 6)
    assert made.where("doc_id = 6").count() == 1


def test_whole_table(table):
    documents = table("documents")
    texts = {r.doc_id: r.text for r in documents.collect()}
    made = word_runs.run_report(word_runs.plant_period(documents)).collect()
    assert len(made) == documents.count()
    short = [i for i, t in texts.items() if len((t or "").split()) <= 1500]
    assert len(short) > 0.8 * len(texts) and sum(r.n_runs > 0 for r in made) > 10
    by_id = {r.doc_id: tuple(r) for r in made}
    for i in short:
        assert by_id[i] == expected(i, texts[i])


def test_collapsed_text(spark):
    text = "begin " + "one two three four " * 5 + "end of\tthe\n\ntext"
    row = word_runs.collapse_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0].collapsed, row[0].n_words) == ("begin one two three four end of the text", 25)
    assert [tuple(r) for r in row[0].runs] == [(1, 20, 4)]
    assert (row[1].collapsed, row[1].n_words, row[1].runs) == ("", 0, [])


def test_empty_table(none):
    assert word_runs.run_report(word_runs.plant_period(none)).count() == 0


@pytest.mark.parametrize("least", [1, 3, 7, 13])
def test_other_limits(least):
    s = [b"a"] * 5 + [b"b", b"c"] * 4 + [b"d"] * 13
    assert word_runs.find_runs([s], least) == [brute_runs(s, least)]
