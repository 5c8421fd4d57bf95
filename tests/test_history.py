"""Histories against simple Python models, with blocks small enough to be crossed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import messages as msg
from evalspark.operators import history

SCHEMA = "conv_id bigint, seq bigint, role string, text string"


def conversation(spark, roles_and_texts):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(roles_and_texts)]
    return spark.createDataFrame(rows, SCHEMA)


def random_messages(seed, conversations=40, longest=30):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        lead = rng.random() < 0.5
        first = rng.choice([0, 3])
        for i in range(rng.randint(1, longest)):
            role = "system" if lead and i == 0 else rng.choice(["user", "assistant"])
            rows.append((conv, first + i, role, "x" * rng.randint(0, 30)))
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    out = {}
    for row in sorted(rows):
        out.setdefault(row[0], []).append(row)
    return out


def placed_messages(df):
    """Messages whose time runs against their numbers, two by two."""
    timed = df.withColumn("timestamp", F.expr("timestamp_seconds(100000 - seq div 2)"))
    return history.with_positions(timed, ["conv_id"])


def in_time_order(rows):
    return {
        conv: sorted(said, key=lambda m: (-(m[1] // 2), m[1]))
        for conv, said in by_conversation(rows).items()
    }


def test_history_of_three_messages(spark):
    said = [
        ("user", "What color is the sky?"),
        ("assistant", "It's blue."),
        ("user", "What was the last question I asked you?"),
    ]
    df = conversation(spark, said).withColumn("timestamp", F.lit(0))
    placed = history.with_positions(df, ["conv_id"])
    prompts = placed.where("role = 'user'")
    found = history.chat_history(placed, prompts, ["conv_id"]).orderBy("position").collect()
    assert [r["position"] for r in found] == [0, 2]
    assert [(m["content"], m["role"]) for m in found[1]["messages"]] == [(t, r) for r, t in said]


@pytest.mark.parametrize("longest", [30, 2500])
def test_histories_and_transcripts_are_whole(spark, longest):
    rows = random_messages(1, 40 if longest < 100 else 2, longest)
    rows += [(None, i, "user", f"n{i}") for i in range(5)]
    placed = placed_messages(spark.createDataFrame(rows, SCHEMA)).cache()
    conversations = in_time_order([r for r in rows if r[0] is not None])
    conversations[None] = sorted(rows[-5:], key=lambda m: (-(m[1] // 2), m[1]))
    for r in placed.collect():
        assert conversations[r["conv_id"]][r["position"]][1] == r["seq"]
    prompts = placed.where("role = 'user' and position % 7 = 3")
    asked = [(c, i) for c, said in conversations.items() for i, m in enumerate(said)
             if m[2] == "user" and i % 7 == 3]
    found = history.chat_history(placed, prompts, ["conv_id"]).collect()
    assert sorted(map(str, ((r["conv_id"], r["position"]) for r in found))) == sorted(map(str, asked))
    for r in found:
        said = conversations[r["conv_id"]][: r["position"] + 1]
        assert [tuple(m) for m in r["messages"]] == [(t, role) for _, _, role, t in said]
    whole = history.transcript(placed, ["conv_id"], F.col("text")).collect()
    assert {r["conv_id"]: r["transcript"] for r in whole} == {
        c: "\n\n".join(m[3] for m in said) for c, said in conversations.items()
    }
    placed.unpersist()


def test_truncation_answers_prompts_without_a_key(spark):
    rows = [(None, i, "user", "x" * 5) for i in range(50)]
    found = history.truncate_context(spark.createDataFrame(rows, SCHEMA), ["conv_id"], 20, block=8)
    assert sorted((r["history_count"], r["kept_count"]) for r in found.collect()) == [
        (i, min(i, 3)) for i in range(50)
    ]


def model_truncation(past, prompt_size, budget):
    """Drop the oldest message, but no leading system message, until the rest fits."""
    if not past:
        return [] if prompt_size <= budget else None
    kept = list(past)
    for _ in past:
        if sum(len(m[3]) for m in kept) + prompt_size <= budget:
            return kept
        at = 1 if kept[0][2] == "system" else 0
        if at >= len(kept):
            return None
        kept.pop(at)
    return None


@pytest.mark.parametrize(
    "budget, block", [(25, 4), (60, 3), (60, 1024), (7, 2), (1000, 5), (None, 3)]
)
def test_truncation_equals_model(spark, budget, block):
    rows = random_messages((budget or 0) + block, conversations=60)
    df = spark.createDataFrame(rows, SCHEMA)
    conversations = by_conversation(rows)
    # without one budget for all, each conversation has its own
    limits = {conv: budget or 5 + conv * 2 for conv in conversations}
    by_column = {"budget": F.expr("5 + conv_id * 2"), "max_budget": 130}
    limit = {"budget": budget} if budget else by_column
    found = history.truncate_context(df, ["conv_id"], block=block, **limit).collect()
    assert len(found) == sum(r[2] == "user" for r in rows)
    for r in found:
        said = conversations[r["conv_id"]]
        past = [m for m in said if m[1] < r["seq"]]
        prompt = next(m for m in said if m[1] == r["seq"])
        kept = model_truncation(past, len(prompt[3]), limits[r["conv_id"]])
        has_system = bool(past) and past[0][2] == "system"
        assert r["history_count"] == len(past)
        assert r["keeps_system"] == has_system
        assert r["over_budget"] == (kept is None)
        if kept is None:
            assert r["kept_count"] is None and r["first_kept_position"] is None
        else:
            assert r["kept_count"] == len(kept)
            rest = kept[1:] if has_system else kept
            first = past.index(rest[0]) if rest else len(past)
            assert r["first_kept_position"] == first


def test_truncation_needs_a_budget(spark):
    with pytest.raises(ValueError):
        history.truncate_context(conversation(spark, [("user", "x")]), ["conv_id"], 0)
    with pytest.raises(ValueError):
        history.truncate_context(conversation(spark, [("user", "x")]), ["conv_id"], F.lit(1))
    with pytest.raises(Exception, match="above max_budget"):
        history.truncate_context(
            conversation(spark, [("user", "x")]), ["conv_id"], F.lit(9), max_budget=8
        ).collect()


def test_order_breaks_ties_by_sequence(spark):
    rows = [(2, 5, 1), (1, 9, 4), (1, 3, 7), (1, 9, 2), (2, 5, 0)]
    df = spark.createDataFrame(rows, "conv_id int, timestamp int, seq int")
    got = history.ordered_conversation(df, ["conv_id"], "timestamp", "seq").collect()
    assert [tuple(r) for r in got] == sorted(rows)
    assert [tuple(r) for r in history.order_by_all(df).collect()] == sorted(rows)


CYCLES = [
    ("a", 0, "60_tb_failed", "c0"),
    ("a", 1, "80_tb_passed", "c1"),
    ("a", 2, "60_tb_failed", "c2"),
    ("b", 0, "80_tb_passed", "d0"),
    ("b", 1, "80_tb_passed", "d1"),
    ("c", 0, None, "e0"),
    ("c", 1, "30_iverilog_compile_error", None),
    ("c", 2, "20_code_extraction_error", "e2"),
    ("c", 3, "80_tb_passed", "e3"),
    ("c", 7, "60_tb_failed", "e7"),
    ("d", 0, "60_tb_failed", "f0"),
    ("d", 1, "exception", "f1"),
    ("d", 2, "80_tb_passed", "f2"),
]


@pytest.fixture(scope="module")
def cycles(spark):
    schema = "experiment_execution_uuid string, cycle_num int, exit_stage string, code string"
    return spark.createDataFrame(CYCLES, schema)


def test_until_end(cycles):
    got = history.until_end(cycles).select("experiment_execution_uuid", "cycle_num")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1), ("c", 2), ("c", 3), ("d", 0), ("d", 1),
    ]


def test_last_attempt_and_phase(cycles):
    got = history.last_attempts(cycles, ["code"]).withColumn("phase", history.phase())
    rows = {(r[0], r["cycle_num"]): (r["last_code"], r["phase"]) for r in got.collect()}
    assert len(rows) == len(CYCLES)
    assert rows["c", 0] == (None, "init")
    assert rows["c", 1] == ("e0", "retry")
    assert rows["c", 2] == (None, "retry")
    assert rows["c", 7] == ("e3", "retry")


def test_state_snapshots(spark):
    rows = [
        ("a", 0, "60_tb_failed", ['"d0"', '"d1"'], [], "x", '{"return_code":0}', None),
        ("a", 1, "80_tb_passed", ['"d2"'], ['"b0"'], None, None, '{"return_code":1}'),
        ("b", 0, "80_tb_passed", [], None, 'q"q', None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "experiment_execution_uuid string, cycle_num int, exit_stage string, "
        "designer_agent array<string>, debugger_agent array<string>, code string, c string, e string",
    )
    got = history.state_snapshots(df, ["designer_agent", "debugger_agent"], "code", "c", "e")
    found = got.collect()
    states = {(r[0], r[1]): json.loads(r["exit_state"]) for r in found}
    before = {(r[0], r[1]): json.loads(r["entry_state"]) for r in found}
    assert before["a", 1] == states["a", 0]
    assert before["a", 0] == before["b", 0] == {
        "phase": "init",
        "conversation_histories": {},
        "last_attempted_solution_code": None,
        "last_compile_result": None,
        "last_execute_result": None,
        "last_was_testbench_passed": False,
    }
    assert states["a", 0] == {
        "phase": "retry",
        "conversation_histories": {"designer_agent": ["d0", "d1"]},
        "last_attempted_solution_code": "x",
        "last_compile_result": {"return_code": 0},
        "last_execute_result": None,
        "last_was_testbench_passed": False,
    }
    assert states["a", 1]["conversation_histories"] == {
        "designer_agent": ["d0", "d1", "d2"], "debugger_agent": ["b0"],
    }
    assert states["a", 1]["phase"] == "retry" and states["a", 1]["last_was_testbench_passed"]
    assert states["b", 0]["phase"] == "init"
    assert states["b", 0]["last_attempted_solution_code"] == 'q"q'


def test_message_metadata_is_an_object(spark):
    df = spark.sql(
        "select 'assistant' r, 'a' a, 'u' u, timestamp'2024-01-01' t, 'x' x, '{\"k\": [1]}' m"
    )
    assert json.loads(df.select(msg.message_json(*df.columns)).first()[0])["metadata"] == {"k": [1]}
