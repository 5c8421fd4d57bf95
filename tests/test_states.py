"""A log of changes against whole states, with restarts and experiments of very different length."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import history
from evalspark.operators.states import StateLog

AGENTS = ["designer_agent", "debugger_agent"]
LAST = ("code", "compiled", "executed")
SCHEMA = (
    "experiment_execution_uuid string, cycle_num int, exit_stage string, "
    "designer_agent array<string>, debugger_agent array<string>, code string, "
    "compiled string, executed string, extra string"
)
BATCHES = 3


def batches_of(seed):
    rng, number = random.Random(seed), 0
    out = [[] for _ in range(BATCHES)]
    for uuid, n in (("a", 5), ("b", 1), (None, 9), ("long", 60), ("silent", 4), ("late", 3)):
        for cycle in range(n):
            said = []
            for _ in AGENTS:
                few = 0 if uuid == "silent" else rng.choice([0, 0, 1, 2, 7])
                said.append([f'"m{number + i}"' for i in range(few)] or rng.choice([None, []]))
                number += few
            stage = "80_tb_passed" if cycle == n - 1 else rng.choice(["60_tb_failed", None])
            code = rng.choice([None, 'q"q', ""])
            row = (uuid, cycle, stage, *said, code, '{"return_code":0}', None, "x")
            out[2 if uuid == "late" else cycle * BATCHES // n].append(row)
    for rows in out:
        rng.shuffle(rows)
    return out


def log_in(spark, folder, batches):
    log = StateLog(str(folder), AGENTS)
    for i, rows in enumerate(batches):
        log.append(spark.createDataFrame(rows, SCHEMA), i, *LAST)
    return log


def expected(spark, batches):
    cycles = spark.createDataFrame(sum(batches, []), SCHEMA)
    found = history.state_snapshots(cycles, AGENTS, *LAST).collect()
    return {(r[0], r.cycle_num): r.exit_state for r in found}


def restored(log, asked):
    return {(r[0], r.cycle_num): r.exit_state for r in log.as_json(log.restore(asked)).collect()}


def test_every_cycle_is_restored(spark, tmp_path):
    batches = batches_of(1)
    log, wanted = log_in(spark, tmp_path / "s", batches), expected(spark, batches)
    assert restored(log, log.changes(spark)) == wanted
    last = {}
    for uuid, cycle in wanted:
        last[uuid] = max(cycle, last.get(uuid, 0))
    assert restored(log, log.last_cycles(spark)) == {k: wanted[k] for k in last.items()}
    # a cycle that is not there, and one that is asked for twice
    some = spark.createDataFrame([("a", 2), ("a", 2), ("a", 99), ("x", 0)], "experiment_execution_uuid string, cycle_num int")
    assert restored(log, some) == {("a", 2): wanted["a", 2]}


def test_space_grows_with_the_messages(spark, tmp_path):
    batches = [[("e", i, None, [f'"{i}"'], None, None, None, None, "x") for i in range(a, a + 100)] for a in (0, 100, 200)]
    log = log_in(spark, tmp_path / "s", batches)
    whole = {r.cycle_num: len(r.designer_agent) for r in log.fulls(spark).collect()}
    assert whole == {n - 1: n for n in (1, 2, 4, 8, 16, 32, 64, 128, 256)}
    said = log.changes(spark).select(F.sum(F.size("designer_agent"))).first()[0]
    assert said == 300 and sum(whole.values()) < 4 * said
    # the messages between a whole state and a cycle are no more than the state has
    for r in log.changes(spark).collect():
        assert r.cycle_num - r.base_cycle <= whole[r.base_cycle]
    state = restored(log, log.last_cycles(spark))["e", 299]
    assert json.loads(state)["conversation_histories"]["designer_agent"] == [str(i) for i in range(300)]


def test_a_run_that_ended_early_is_repeated(spark, tmp_path):
    batches = batches_of(2)
    log = log_in(spark, tmp_path / "s", batches[:2])
    last = spark.createDataFrame(batches[2], SCHEMA)
    written, log._write = log._write, lambda df, name, batch: (_ for _ in ()).throw(OSError(name))
    with pytest.raises(OSError):
        log.append(last, 2, *LAST)
    # whole states without changes that lead to them
    log._write = lambda df, name, batch: written(df, name, batch) if name == "fulls" else 1 / 0
    with pytest.raises(ZeroDivisionError):
        log.append(last, 2, *LAST)
    assert restored(log, log.changes(spark)) == expected(spark, batches[:2])
    log._write = written
    for _ in range(2):
        log.append(last, 2, *LAST)
        assert restored(log, log.changes(spark)) == expected(spark, batches)
    with pytest.raises(ValueError, match="batches after 1"):
        log.append(last, 1, *LAST)


@pytest.mark.parametrize("cycles", [(0, 0), (None,), (3, 3)])
def test_cycles_out_of_order_raise(spark, tmp_path, cycles):
    log = log_in(spark, tmp_path / "s", [])
    rows = [("e", c, None, ['"x"'], [], None, None, None, "x") for c in cycles]
    with pytest.raises(Exception, match="does not follow"):
        log.append(spark.createDataFrame(rows, SCHEMA), 0, *LAST)


def test_earlier_cycle_raises(spark, tmp_path):
    row = ("e", 4, None, ['"x"'], [], None, None, None, "x")
    log = log_in(spark, tmp_path / "s", [[row]])
    with pytest.raises(Exception, match="does not follow"):
        log.append(spark.createDataFrame([row], SCHEMA), 1, *LAST)


def test_empty(spark, tmp_path):
    log = log_in(spark, tmp_path / "s", [[]])
    assert log.restore(log.last_cycles(spark)).count() == 0


def test_plan_reads_no_message_for_places(spark, tmp_path):
    log = log_in(spark, tmp_path / "s", batches_of(3)[:1])
    plan = log.last_cycles(spark)._jdf.queryExecution().executedPlan().toString()
    assert "cycle_num" in plan and "designer_agent" not in plan
