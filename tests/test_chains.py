"""Chains of histories against lists of messages, with restarts and blocks small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import history
from evalspark.operators.chains import HistoryChain

SCHEMA = "conv string, seq bigint, timestamp bigint, role string, text string"


def batches_of(seed, n=3):
    rng, out, number = random.Random(seed), [], 0
    for _ in range(n):
        rows = []
        for conv in ("a", "b", None, "hot"):
            for _ in range(rng.randrange(0, 9) + (40 if conv == "hot" else 0)):
                number += 1
                role = rng.choice(["user", "assistant", "system"])
                text = rng.choice([None, "", "x" * rng.randrange(9), f"t{number}"])
                rows.append((conv, number, number // 3, role, text))
        rng.shuffle(rows)
        out.append(rows)
    return out


def expected(batches):
    """(conv, position) -> the messages up to and including each prompt."""
    said, out = {}, {}
    for rows in batches:
        for conv, _, _, role, text in sorted(rows, key=lambda r: r[1]):
            told = said.setdefault(conv, [])
            told.append((text, role))
            if role == "user":
                out[conv, len(told) - 1] = list(told)
    return out


def chain_in(spark, folder, batches, block=4):
    fields = [spark.createDataFrame([], SCHEMA).schema["conv"]]
    chain = HistoryChain(str(folder), fields, block)
    for i, rows in enumerate(batches):
        chain.append(spark.createDataFrame(rows, SCHEMA), i)
    return chain


def histories(found):
    return {
        (r["conv"], r["position"]): [(m["content"], m["role"]) for m in r["messages"]]
        for r in found.collect()
    }


def test_all_prompts(spark, tmp_path):
    batches = batches_of(1)
    chain = chain_in(spark, tmp_path / "c", batches)
    wanted = expected(batches)
    assert histories(chain.histories(chain.heads(spark))) == wanted
    assert {(r["conv"], r["position"]): (r["message_count"], r["char_count"]) for r in chain.sizes(spark).collect()} == {
        k: (len(v), sum(len(t or "") for t, _ in v)) for k, v in wanted.items()
    }
    last = {conv: max(p for c, p in wanted if c == conv) for conv, _ in wanted}
    assert set(histories(chain.histories(chain.last_heads(spark)))) == set(last.items())


def test_space_is_linear(spark, tmp_path):
    rows = [("hot", i, i, "user", f"t{i}") for i in range(3000)]
    chain = chain_in(spark, tmp_path / "c", [rows], block=100)
    blocks = chain.blocks(spark)
    assert blocks.agg(F.sum("block_size")).first()[0] == 3000 and blocks.count() == 30
    assert blocks.agg(F.max(F.size("messages"))).first()[0] == 100
    heads = chain.heads(spark)
    assert heads.count() == 3000 and "messages" not in heads.columns


def test_a_batch_that_ended_early_is_repeated(spark, tmp_path):
    batches = batches_of(2)
    chain = chain_in(spark, tmp_path / "c", batches[:2])
    # blocks of a third batch are there, its heads are not
    whole, chain._write = chain._write, lambda df, name, batch: whole(df, name, batch) if name == "blocks" else 1 / 0
    part = spark.createDataFrame(batches[2][:5], SCHEMA)
    with pytest.raises(ZeroDivisionError):
        chain.append(part, 2)
    chain._write = whole
    assert histories(chain.histories(chain.heads(spark))) == expected(batches[:2])
    chain.append(spark.createDataFrame(batches[2], SCHEMA), 2)
    chain.append(spark.createDataFrame(batches[2], SCHEMA), 2)
    assert histories(chain.histories(chain.heads(spark))) == expected(batches)
    with pytest.raises(ValueError):
        chain.append(part, 1)


def test_empty_batches(spark, tmp_path):
    chain = chain_in(spark, tmp_path / "c", [[], batches_of(3)[0], []])
    assert histories(chain.histories(chain.heads(spark))) == expected([batches_of(3)[0]])
    none = HistoryChain(str(tmp_path / "none"), [spark.createDataFrame([], SCHEMA).schema["conv"]])
    assert none.sizes(spark).collect() == [] and none.histories(none.heads(spark)).collect() == []


def test_heads_meet_blocks_by_number(spark, tmp_path):
    chain = chain_in(spark, tmp_path / "c", batches_of(4, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = chain.histories(chain.heads(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :].split("\n")[0]
    assert "block_no" in join and "NestedLoop" not in plan and "Cartesian" not in plan
    sizes = chain.sizes(spark)._jdf.queryExecution().executedPlan().toString()
    assert "messages" not in sizes  # texts are not read for sizes


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_chat_history_whatever_the_block(spark, block):
    rows = [("a", i, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(30)]
    placed = history.with_positions(spark.createDataFrame(rows, SCHEMA), ["conv"]).cache()
    found = history.chat_history(placed, placed.where("role = 'user'"), ["conv"], block)
    assert histories(found) == expected([rows])
