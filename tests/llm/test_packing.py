from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_ROWS
from tillflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_are_the_library_s(library, texts):
    texts = [t.encode("utf-8", "ignore") for t in texts]
    made = packing.TokenIds(library.to_str()).of(texts)
    assert [m.tolist() for m in made] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]


def test_forgetting_pieces_changes_nothing(library, table, monkeypatch):
    texts = [(r.text or "").encode() for r in table("documents").limit(60).collect()]
    expected = [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "CACHED_WORDS", 64)
    ids_of = packing.TokenIds(library.to_str())
    assert [ids_of.of([t])[0].tolist() for t in texts] == expected
    ids_of.forget()
    assert 0 < len(ids_of.place) <= 32 or not ids_of.place


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=80))
def test_no_window_exceeds_the_capacity(sizes):
    sizes = np.array(sizes)
    place = packing.pack_sizes(sizes, 100)
    assert len(place) == len(sizes) and np.bincount(place, weights=sizes).max() <= 100


def test_differencing_balances():
    # The textbook case: 8 7 6 5 4 in two parts differs by 2 with differencing.
    sums = np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4096, 800)
    windows = packing.pack_sizes(sizes, 4096)
    assert (windows.max() + 1) * 4096 < sizes.sum() * 1.12


def check(packed, rows, library, capacity=4096):
    ids = defaultdict(list)
    for i, text, *_ in rows:
        ids[str(i)].append(library.encode(text or "", add_special_tokens=False).ids + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        pieces[str(r.doc_id)].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, copies in ids.items():
        expected = sorted(
            (s, n, crc32(np.array(full[s : s + n], "<u4").tobytes()), len(full)) for full in copies for s, n in packing.cut_points(len(full), capacity)
        )
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc]) == expected
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_odd_rows(odd, library):
    check(packing.pack(odd, PATH), ODD_ROWS, library)
    check(packing.pack(odd, PATH, capacity=64, group_pieces=3), ODD_ROWS, library, 64)


def test_corpus_has_little_padding(table, library):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sequences = check(packing.pack(docs, PATH), rows, library)
    used = sum(n for held in sequences.values() for _, n in held)
    assert used / (len(sequences) * 4096) > 0.95


def test_ids_come_with_the_pieces(table):
    for r in packing.pack(table("documents").limit(20), PATH, with_ids=True).collect():
        assert len(r.ids) == 4 * r.length and crc32(r.ids) == r.ids_crc32


def test_empty_table(none):
    assert packing.pack(none, PATH).count() == 0
