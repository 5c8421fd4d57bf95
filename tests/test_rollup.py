"""The live roll-up: closing, late cycles, restarts, expiry, and the batch roll-up of the same log."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evalspark.operators.summary import rollup_cycles
from evalspark.sources import sinks
from evalspark.streaming import live, rollup

ROW = (
    "experiment_execution_uuid string, llm_provider_name string, configured_llm_name string, "
    "cycle_num bigint, exit_stage string"
)
PASS, FAIL, ODD = "80_tb_passed", "60_tb_failed", "exception"


@pytest.fixture
def drain(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema

    def run(rows, idle_ms=rollup.DAY_MS):
        df = spark.createDataFrame([(e, "p", "m", c, s) for e, c, s in rows], schema)
        sinks.append_jsonl(df.coalesce(1), str(tmp_path / "log"))
        log = live.stream_log(spark, str(tmp_path / "log"), schema)
        found = rollup.drain_rollup(log, str(tmp_path / "cp"), str(tmp_path / "out"), idle_ms)
        return sorted(
            (r["experiment_execution_uuid"], r["kind"], r["cycle_num"], r["exit_stage"], r["used_cycle_count"], r["configured_llm_name"])
            for r in found.collect()
        )

    return run


def test_closing_late_cycles_and_restarts(drain, spark):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    first = [("a", 0, FAIL), ("a", 1, PASS), ("b", 0, FAIL), ("c", 0, ODD), (None, 0, PASS), ("d", None, PASS)]
    closed = [("a", "closed", 1, PASS, 2, "m"), ("c", "closed", 0, ODD, None, None)]
    assert drain(first) == closed
    # a restart with nothing new repeats nothing, a late cycle is reported, the rest goes on
    then = [("a", 2, FAIL), ("b", 1, None), ("c", 0, ODD)]
    late = [("a", "late", 2, FAIL, None, "m"), ("c", "late", 0, ODD, None, None)]
    assert drain(then) == sorted(closed + late)
    assert drain([("b", 2, PASS), ("b", 3, PASS)]) == sorted(
        closed + late + [("b", "closed", 2, PASS, 3, "m"), ("b", "late", 3, PASS, None, "m")]
    )
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider


def test_expiry(drain):
    assert drain([("a", 0, FAIL), ("b", 0, PASS)], idle_ms=1) == [("b", "closed", 0, PASS, 1, "m")]
    time.sleep(0.1)
    # the next batch fires the timers: "a" is reported, and the state of both is gone
    assert drain([("c", 0, FAIL)], idle_ms=1) == [
        ("a", "expired", 0, FAIL, 1, "m"),
        ("b", "closed", 0, PASS, 1, "m"),
    ]


def test_a_timer_waits_for_what_is_heard_of(drain):
    drain([("a", 0, FAIL)], idle_ms=15000)
    time.sleep(1)
    drain([("a", 1, FAIL)], idle_ms=15000)
    assert drain([("a", 2, PASS)], idle_ms=15000) == [("a", "closed", 2, PASS, 3, "m")]


def test_equals_the_batch_rollup(drain, spark):
    stages = [FAIL, "20_code_extraction_error", PASS, ODD, FAIL, FAIL]
    rows = [(f"e{i}", c, stages[(i * 7 + c * c) % 6]) for i in range(40) for c in range(5)]
    drain([r for r in rows if r[1] < 2])
    found = drain([r for r in rows if r[1] >= 2])
    df = spark.createDataFrame([(e, "p", "m", c, s) for e, c, s in rows], ROW)
    ended = rollup_cycles(df).where(F.col("latest_exit_stage").isin(PASS, ODD)).collect()
    assert [(e, s, u) for e, k, _, s, u, _ in found if k == "closed"] == sorted(
        (r[0], r["latest_exit_stage"], r["used_cycle_count"]) for r in ended
    )


def model(batches, idle_ms):
    """(batch, experiment, kind, cycle, stage) of batches of (time, rows), with a state per experiment."""
    states, found = {}, []
    for i, (now, rows) in enumerate(batches):
        for e, c, s in sorted(rows, key=lambda r: (r[0], r[1], r[2] in (PASS, ODD), r[2])):
            last, _ = states.get(e, (None, 0))
            if last and last[1] in (PASS, ODD):
                found.append((i, e, "late", c, s))
            else:
                last = max(last or (c, s), (c, s)) if s not in (PASS, ODD) else (c, s)
                found += [(i, e, "closed", c, s)] if s in (PASS, ODD) else []
            states[e] = (last, now)
        for e, (last, seen) in list(states.items()):
            if seen + idle_ms <= now:
                found += [(i, e, "expired", *last)] if last[1] not in (PASS, ODD) else []
                del states[e]
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_a_model_with_a_state_per_experiment(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(rollup, "WHOLE", 3)
    chance, now, batches = random.Random(seed), 1_000_000, []
    for i in range(8):
        now += chance.choice([10, 60])
        few = 0 if i == 4 else chance.randrange(4, 14)  # one batch is empty
        rows = [(f"e{chance.randrange(9)}", chance.randrange(5), chance.choice([FAIL, FAIL, FAIL, PASS, ODD])) for _ in range(few)]
        batches.append((now, rows + rows[:1]))  # a cycle that is logged twice
    at = str(tmp_path / "cp"), str(tmp_path / "out")
    for i, (now, rows) in enumerate(batches):
        monkeypatch.setattr(rollup.time, "time", lambda now=now: now / 1000)
        df = rollup.cycles_of(spark.createDataFrame([(e, "p", "m", c, s) for e, c, s in rows], ROW))
        for _ in range(2 if i in (2, 3) else 1):  # a batch that is run again repeats nothing
            rollup.take_batch(df, i, *at, 100)
    found = spark.read.parquet(at[1]).select("batch", "experiment_execution_uuid", "kind", "cycle_num", "exit_stage")
    assert sorted(tuple(r) for r in found.collect()) == model(batches, 100)


def test_a_batch_is_one_shuffle_without_a_call_per_experiment(spark):
    cycles = rollup.cycles_of(spark.createDataFrame([("a", "p", "m", 0, PASS)], ROW))
    states = spark.createDataFrame([], f"{ROW}, ended boolean, seen_ms bigint")
    plan = rollup.advance(states, cycles, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Join" not in plan
