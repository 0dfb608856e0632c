import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_ROWS, rows
from tillflow.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.MergeCounter(token_counts.read_tokenizer(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_has_as_many_tokens_as_the_library_gives(library, counter, text):
    assert counter.count(text.encode("utf-8", "ignore")) == len(
        library.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids
    )


def test_special_strings_and_odd_letters(library, counter):
    for text in ("a<|endoftext|>b", "<|ENDOFTEXT|>", "ΑΣΣ ΑΣ", "İstanbul", "it's WE'LL", "x\x1ey \x85 z", "é ́a", "ﬁ ½"):
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), text


def test_odd_rows(odd, library):
    expected = sorted(
        (str(i), len((t or "").encode()), n, n > 2048)
        for i, t, *_ in ODD_ROWS
        for n in [len(library.encode(t or "", add_special_tokens=False).ids)]
    )
    found = token_counts.token_report(odd, PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected
    kept = token_counts.count_tokens(odd, PATH)
    assert set(odd.columns) | {"n_bytes"} == set(kept.columns)


def test_corpus(table, library):
    docs = table("documents")
    expected = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert rows(token_counts.token_report(docs, PATH), "doc_id", "n_tokens") == sorted(expected, key=lambda r: [(False, str(v)) for v in r])


def test_empty_table(none):
    assert token_counts.token_report(none, PATH).count() == 0
