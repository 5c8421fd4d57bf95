"""Encoding against the tiktoken library, round trips, and the perfect hash."""

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import bpe
from evalspark.llm.phash import PerfectHash

# code points assigned in recent versions of Unicode may be classed otherwise
TEXT = st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60)
SPACES = st.lists(
    st.sampled_from([" ", "  ", "\n", "\t", "\x85", "\x1c", "\xa0", "'s", "'re", "a", "the", "1", "é", "!?"]),
    max_size=12,
).map("".join)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=vocabulary.value.ranks,
        special_tokens={},
    )


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary.value, remembered=500)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(TEXT, SPACES))
def test_equals_the_library(encoder, library, vocabulary, text):
    ids = encoder.encode([text, "", None])
    assert ids.to_pylist() == [library.encode_ordinary(text), [], []]
    assert bpe.decode_ids(ids, vocabulary.value.tokens) == [text.encode(), b"", b""]


def test_long_pre_tokens(encoder, library):
    texts = ["a" * 30_000, "ab" * 9_000, " " * 5_000 + "x", "é" * 4_000, "q" * 7 + "z" * 900]
    assert encoder.encode(texts).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = [f"k{i}".encode() for i in range(3_000)] + [b"", b"\x00", b"\xff"]
    table = PerfectHash(keys)
    assert table.lookup(keys) == list(range(len(keys)))
    assert sorted(table.index.tolist()) == list(range(len(keys)))
    assert table.lookup([b"other", b"k3000", b"k"]) == [-1, -1, -1]
    assert PerfectHash([]).lookup([b"x"]) == [-1]
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def test_tables(spark, documents, vocabulary, library):
    rows = [(1, "Hello world, it's 2024!"), (2, None), (3, ""), (1, "Hello world, it's 2024!"),
            (None, " tabs\t\tand  spaces \n")]
    df = documents(rows)
    want = sorted((k is None, k or 0, library.encode_ordinary(t or ""), t or "") for k, t in rows)
    coded = bpe.round_trip(df, vocabulary).collect()
    found = [(r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.decoded).decode()) for r in coded]
    assert sorted(found) == want
    again = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    assert sorted(bytes(r.decoded).decode() for r in again) == sorted(t or "" for _, t in rows)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
    kept = bpe.encode(df, vocabulary, keep=("kept", "out", "n_tokens"))
    assert kept.columns == ["kept", "out", "n_tokens", "ids"] and kept.count() == 5
