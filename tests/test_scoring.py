"""Scoring: failing rows by bisection, and runs that go on where others ended."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.operators import scoring


def counting(folder, bad=(), broken=()):
    """A responder that notes each call in a file; `bad` prompts fail, `broken` ones end the job."""

    def respond(prompts, histories):
        import uuid

        path = f"{folder}/{uuid.uuid4().hex}"
        with open(path, "w") as out:
            json.dump(list(prompts), out)
        if any(p in broken for p in prompts):
            raise SystemExit("the worker is gone")
        if any(p in bad for p in prompts):
            raise ValueError("refused")
        return [f"{p}!{len(h)}" for p, h in zip(prompts, histories)]

    return respond


def asked(folder):
    return Counter(p for f in folder.iterdir() for p in json.loads(f.read_text()))


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, prompt string")


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def test_bisection(spark, calls):
    texts = [f"p{i}" for i in range(256)]
    df = table(spark, texts).coalesce(1)
    rows = scoring.score_prompts(df, counting(calls, bad={"p77"})).collect()
    assert [r.id for r in rows if r.error] == [77]
    assert all(r.response == f"{r.prompt}!0" for r in rows if r.id != 77)
    assert len(list(calls.iterdir())) <= 1 + 2 * 8  # halves, not all rows one by one
    assert asked(calls)["p200"] == 2 and asked(calls)["p77"] == 9


def test_all_rows_fail(spark, calls):
    df = table(spark, ["a", "b", None, "a"]).coalesce(1)
    rows = scoring.score_prompts(df, counting(calls, bad={"a", "b", None})).collect()
    assert [r.error for r in rows] == ["refused"] * 4


def test_repeated_prompts_are_asked_once(spark, calls, tmp_path):
    df = table(spark, ["a", "b", "a", None, None, "", "a"])
    log = str(tmp_path / "log")
    rows = scoring.score_resumably(df, counting(calls), log).collect()
    assert sorted((r.id, r.response) for r in rows) == [
        (0, "a!0"), (1, "b!0"), (2, "a!0"), (3, "None!0"), (4, "None!0"), (5, "!0"), (6, "a!0")
    ]
    assert set(asked(calls).values()) == {1}
    again = scoring.score_resumably(df.union(table(spark, ["c"])), counting(calls), log)
    assert again.count() == 8
    assert asked(calls) == Counter(["a", "b", None, "", "c"])


def test_a_run_that_ends_early_goes_on(spark, calls, tmp_path):
    texts = [f"p{i}" for i in range(60)]
    df, log = table(spark, texts), str(tmp_path / "log")
    digests = df.select("prompt", scoring.prompt_digest().alias("d")).collect()
    of_round = {r.prompt: int(r.d[:8], 16) % 6 for r in digests}
    broken = next(p for p in texts if of_round[p] == 3)
    with pytest.raises(Exception):
        scoring.score_resumably(df, counting(calls, broken={broken}), log, rounds=6, partitions=2)
    kept = {r.response for r in spark.read.parquet(log).collect()}
    before = asked(calls)
    assert kept == {f"{p}!0" for p in texts if of_round[p] < 3}
    rows = scoring.score_resumably(df, counting(calls), log, rounds=6, partitions=2).collect()
    assert sorted(r.response for r in rows) == sorted(f"{t}!0" for t in texts)
    after = asked(calls)
    assert all(after[p] == before[p] for p in texts if f"{p}!0" in kept)


def test_failures_are_asked_again(spark, calls, tmp_path):
    df, log = table(spark, ["a", "b"]), str(tmp_path / "log")
    first = scoring.score_resumably(df, counting(calls, bad={"b"}), log).collect()
    assert {r.prompt: r.error for r in first} == {"a": None, "b": "refused"}
    before = asked(calls)["a"]
    kept = scoring.score_resumably(df, counting(calls), log, retry_errors=False).collect()
    assert {r.prompt: r.error for r in kept} == {"a": None, "b": "refused"}
    then = scoring.score_resumably(df, counting(calls), log).collect()
    assert {r.prompt: r.response for r in then} == {"a": "a!0", "b": "b!0"}
    assert asked(calls)["a"] == before


def test_histories_count(spark, calls, tmp_path):
    told = "array(named_struct('content', 'x', 'role', 'user'))"
    df = table(spark, ["a", "a"]).withColumn("past", F.expr(f"case id when 0 then {told} end"))
    rows = scoring.score_resumably(df, counting(calls), str(tmp_path / "log"), history="past").collect()
    assert sorted((r.id, r.response) for r in rows) == [(0, "a!1"), (1, "a!0")]


def test_empty_table(spark, calls, tmp_path):
    assert scoring.score_resumably(table(spark, []), counting(calls), str(tmp_path / "log")).collect() == []
    assert not list(calls.iterdir())
