"""Formatting and reading back."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from evalspark.llm import chat

HOSTILE = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|im_sep|>", "<", "\\", "|", "<|", "é", "a b", "\n"]


@given(st.lists(st.sampled_from(HOSTILE), max_size=8).map("".join))
def test_escapes_are_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and "<|" not in safe
    assert all(safe.count(c) == 0 for c in chat.CONTROLS)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    text = lambda: "".join(rng.choices(HOSTILE + ["word ", "two words "], k=rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), text()) for c in range(8) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"{t}") for t in range(300)]
    rows += [(60, 0, None, None), (60, 1, "assistant", None), (60, 2, "assistant", ""), (60, 3, "<|im_sep|>", "x")]
    rows += [(70, None, "assistant", "first"), (70, 0, "user", "second"), (70, 0, "assistant", "before")]
    rows += [(None, 1, "user", "b"), (None, 0, "assistant", "a"), (80, 5, "user", "x" * 50_000)]
    return rows


@pytest.mark.parametrize("block_turns", [1024, 3])
def test_reading_back(spark, vocabulary, rows, block_turns):
    schema = "conv_id bigint, turn bigint, role string, text string, place string, ids string"
    df = spark.createDataFrame([(*r, "p", "i") for r in rows], schema).repartition(7)
    turns = chat.format_turns(df, vocabulary, block_turns=block_turns).cache()
    read = chat.read_turns(turns, vocabulary).cache()
    found = {r.conv: r for r in chat.digests(read).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert found.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == digest("".join(f"{r}\n{t}\n" for _, r, t in own))
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), digest(loss))
    # prefix sums, and control ids only where the turn puts them
    controls = set(chat.reserved(vocabulary.value))
    for conv in by_conv:
        own = sorted((r for r in turns.collect() if r.conv == conv), key=lambda r: r.place)
        texts = sorted((r for r in read.collect() if r.conv == conv), key=lambda r: r.place)
        tokens = chars = 0
        for place, (turn, text) in enumerate(zip(own, texts)):
            assert (turn.place, turn.token_start, turn.char_start) == (place, tokens, chars)
            assert sum(i in controls for i in turn.ids) == 3
            assert len(text.rendered) == turn.n_chars and len(turn.loss_mask) == len(turn.ids)
            tokens, chars = tokens + len(turn.ids), chars + turn.n_chars
        assert found[conv].formatted_chars == chars
    turns.unpersist(), read.unpersist()


def test_empty(spark, vocabulary):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    read = chat.read_turns(chat.format_turns(df, vocabulary), vocabulary)
    assert chat.digests(read).count() == 0


def test_string_keys_and_one_encoding(spark, vocabulary):
    df = spark.createDataFrame(
        [("b", 0, "user", "hi"), ("b", 1, "assistant", "ok"), (None, 0, "assistant", "x")],
        "conv_id string, turn bigint, role string, text string",
    )
    turns = chat.format_turns(df, vocabulary)
    plan = turns._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # encoded once, in the job that writes the turns
    found = {r.conv: r for r in chat.digests(chat.read_turns(turns, vocabulary)).collect()}
    assert found["b"].loss_sha256 == digest("ok") and found[None].n_turns == 1
