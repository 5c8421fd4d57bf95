"""Prefix counts against the tokenizers library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalspark.llm import token_counts

PIECES = st.lists(
    st.one_of(
        st.sampled_from(
            [" ", "  ", "\n", "\n\n", "\t", "\xa0", "'s", "'re", "'ve", "'ll", "'", "<|endoftext|>", "<|endof", "<|", "a", "the", "1",
             "!!", "aaaa", " hello", " world", "é", "ß"]
        ),
        st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=4),
    ),
    max_size=12,
).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter(merges):
    return token_counts.PrefixCounter(merges.value, remembered=300)


@settings(max_examples=200, deadline=None)
@given(text=PIECES)
def test_every_prefix(counter, library, text):
    want = [count(library, text[:i]) for i in range(len(text) + 1)]
    assert counter.prefixes(text).tolist() == want


def test_every_token_is_one_token(merges, counter):
    for token in merges.value.tokens[::37]:
        assert counter.byte_counts(token)[-1] == 1


def test_long_texts(counter, library):
    for text in ("a" * 20_000, "word " * 5_000, " " * 3_000, "<|endoftext|>" * 50):
        assert int(counter.prefixes(text)[-1]) == count(library, text)


def test_tables(documents, merges, library):
    rows = [(1, "one two  three<|endoftext|> four"), (2, None), (3, ""), (1, "x"), (None, "é" * 40)]
    df = documents(rows)
    found = token_counts.prefix_counts(df, merges).collect()
    by_text = sorted((r.doc_id is None, r.doc_id or 0, r.counts) for r in found)
    assert by_text == sorted(
        (k is None, k or 0, [count(library, (t or "")[:i]) for i in range(len(t or "") + 1)])
        for k, t in rows
    )
    assert token_counts.prefix_counts(df.limit(0), merges).count() == 0
    limit = 4
    for row in token_counts.budgets(df, merges, limit, keep=("text",)).collect():
        text = row.text or ""
        assert row.n_tokens == count(library, text)
        fits = [i for i in range(len(text) + 1) if count(library, text[:i]) <= limit]
        assert row.fit_chars == max(fits)
