"""Projections, checks, joins, summaries and scoring."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators import checks, joins, projections, scoring, summary
from evalspark.schemas import (
    AGENT_VARIANT_ROWS,
    AGENT_VARIANTS,
    CYCLE_STAGES,
    MODEL_CONFIGS,
    PASS_STAGE,
    PROBLEMS,
)
from evalspark.sources import readers


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- projections -----------------------------------------------------------------------------


def test_keep_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b.c` int, d int")
    kept = projections.keep_columns(df, ["d", "b.c", "zzz"])
    assert kept.columns == ["b.c", "d"] and rows_of(kept) == [(2, 3)]


def test_flatten(spark):
    df = spark.sql(
        "select 1 a, named_struct('x', 2, 'y', named_struct('z', array(3, 4))) b, array('p', 'q') c"
    )
    flat = projections.flatten(df)
    assert flat.columns == ["a", "b.x", "b.y.z", "c"]
    assert rows_of(flat) == [(1, 2, "3, 4", "p, q")]
    assert projections.flatten(flat).columns == flat.columns


def test_problems(spark):
    described = spark.createDataFrame([("t1", "Do it.")], "task_id string, detail_description string")
    solved = spark.createDataFrame(
        [("t1", " module m(); \n", "\n endmodule\t", "tb")],
        "task_id string, prompt string, canonical_solution string, test string",
    )
    problems = readers.problems_from(described, solved)
    assert problems.columns == PROBLEMS.fieldNames()
    row = problems.first()
    assert row["problem_id"] == "ve_t1" and row["code_language"] == "systemverilog"
    assert row["module_header"] == " module m(); \n" and row["other_data"] == {}
    assert row["canonical_solution"] == (
        "module m();\n\n\t// BREAK between verilog_eval 'prompt' and 'canonical_solution'\n\n"
        "endmodule\n"
    )
    with pytest.raises(ValueError, match="columns differ"):
        readers.problems_from(described.withColumn("x", F.lit(1)), solved)
    with pytest.raises(ValueError, match="row counts differ"):
        readers.problems_from(described, solved.limit(0))


def test_flags_and_label(spark):
    df = spark.createDataFrame([("p", "s", None), ("q", "s", "t"), ("r", None, None)], "i string, s string, t string")
    flags = projections.data_flags("s", "t")
    got = rows_of(df.select("i", projections.problem_label("i", flags)))
    assert got == [
        ("p", "SimpleCodeGenProblem(p, has_canonical_solution)"),
        ("q", "SimpleCodeGenProblem(q, has_canonical_solution, has_testbench_code)"),
        ("r", "SimpleCodeGenProblem(r)"),
    ]


def test_qualify_vcd_paths(values):
    codes = ['$dumpfile("wave.vcd"); "wave.vcd" "a b.vcd" "größe.vcd" wave.vcd', None]
    got = values(codes, lambda c: projections.qualify_vcd_paths(c, F.lit("/a$1/b\\c")))
    assert got == [
        '$dumpfile("/a$1/b\\c/wave.vcd"); "/a$1/b\\c/wave.vcd" "a b.vcd" '
        '"/a$1/b\\c/größe.vcd" wave.vcd',
        None,
    ]


def test_config_options(spark):
    df = spark.sql(
        """select * from values (map('seed', 'old', 'k', 'v'), 7, 0.0D), (null, null, null),
           (map('temperature', '1'), null, null) as t(o, s, t)"""
    )
    got = [r[0] for r in df.select(projections.config_options("o", "s", "t")).collect()]
    assert got == [{"k": "v", "seed": "7", "temperature": "0.0"}, {}, {"temperature": "1"}]


def test_metadata(spark):
    df = spark.sql("select named_struct('model', 'm', 'response', 'long', 'done', true, 'x', null) r")
    got = df.select(projections.metadata_json("r", "response")).first()[0]
    assert got == '{"model":"m","done":true,"x":null}'


# -- checks ----------------------------------------------------------------------------------


def test_named_one(spark):
    variants = readers.rows_to_table(spark, AGENT_VARIANT_ROWS, AGENT_VARIANTS)
    assert checks.named_one(variants, "v2").first()["phrasing"] == "be_specific"
    assert rows_of(checks.name_report(variants.where("name = 'v2'"))) == [("v2", 1, True)]
    assert {r["ok"] for r in checks.name_report(variants.unionAll(variants)).collect()} == {False}
    for bad in (variants.where("name <> 'v2'"), variants.unionAll(variants)):
        with pytest.raises(ValueError, match="named 'v2'"):
            checks.named_one(bad, "v2")


def test_extraction_ok(spark):
    df = spark.createDataFrame(
        [("abcd", "abcd"), ("abc", "abcd"), ("", ""), (None, "a")], "x string, s string"
    )
    got = [r[0] for r in df.select(checks.extraction_ok(F.col("x"), F.col("s"))).collect()]
    assert got == [True, False, False, False]


# -- joins -----------------------------------------------------------------------------------


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y")], "k int, r string")
    assert rows_of(joins.join_one_to_one(left, right, "k")) == [(2, "b", "x")]
    twice = right.unionAll(right)
    with pytest.raises(ValueError, match="repeats on the right side"):
        joins.join_one_to_one(left, twice, "k")
    with pytest.raises(ValueError, match="repeats on the left side"):
        joins.join_one_to_one(twice, left, "k")
    assert rows_of(checks.duplicate_keys(twice, "k")) == [(2, 2), (3, 2)]


def test_with_each(spark):
    df = spark.range(3)
    models = [
        {"llm_class": "MockLlm", "configured_llm_name": "a"},
        {"llm_class": "OllamaLlm", "configured_llm_name": "b", "model_name": "x:7b",
         "other_model_file_options": {"num_ctx": "1"}},
    ]
    grid = joins.with_each(df, models, MODEL_CONFIGS)
    assert grid.columns == ["id", *MODEL_CONFIGS.fieldNames()]
    assert grid.schema["option_seed"].dataType == T.IntegerType()
    assert rows_of(grid.select("id", "configured_llm_name")) == [
        (i, n) for i in range(3) for n in "ab"
    ]
    assert grid.where("configured_llm_name = 'b'").first()["other_model_file_options"] == {
        "num_ctx": "1"
    }
    assert joins.with_each(df, [], MODEL_CONFIGS).count() == 0


def test_attach_results(spark):
    key = "experiment_execution_uuid string, cycle_num int"
    cycles = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], key)
    results = spark.createDataFrame(
        [("a", 0, "compile", 0, "o", ""), ("a", 0, "execute", None, "p", "q"), ("b", 0, "compile", 1, "", "e")],
        key + ", step string, return_code int, stdout string, stderr string",
    )
    with pytest.raises(ValueError, match="more than once"):
        joins.attach_results(cycles, results.unionAll(results))
    got = joins.attach_results(cycles, results)
    assert rows_of(
        got.select(
            "experiment_execution_uuid", "cycle_num", "was_compile_success", "was_execute_success",
            "execute_result_stdout", "compile_result_stderr",
        )
    ) == [("a", 0, True, False, "p", ""), ("a", 1, None, None, None, None),
          ("b", 0, False, None, None, "e")]


def test_join_on_same(spark):
    left = spark.createDataFrame([(None, 1, "a"), (2, None, "b"), (3, 3, "c")], "k int, n int, x string")
    right = spark.createDataFrame([(None, 1, 7), (2, None, 8), (3, 4, 9)], "k int, n int, y int")
    joined = joins.join_on_same(left, right, ["k", "n"])
    assert joined.columns == ["k", "n", "x", "y"]
    assert rows_of(joined) == sorted([(None, 1, "a", 7), (2, None, "b", 8)], key=repr)


def test_cycles_without_an_experiment_stay(spark):
    key = "experiment_execution_uuid string"
    cycles = spark.createDataFrame([("a", 0), ("b", 0)], key + ", cycle_num int")
    experiments = spark.createDataFrame([("a", 5)], key + ", used int")
    assert rows_of(joins.attach_experiments(cycles, experiments)) == [("a", 0, 5), ("b", 0, None)]


def test_ragged_union(spark):
    done = spark.createDataFrame([("a", "end")], "m string, exit_stage string")
    crashed = spark.createDataFrame([("exception", "boom")], "exit_stage string, error string")
    assert rows_of(joins.union_ragged(done, crashed)) == [
        ("a", "end", None), (None, "exception", "boom"),
    ]


# -- summaries -------------------------------------------------------------------------------


def test_rollup_equals_a_loop(spark):
    rng = random.Random(4)
    stages = [s for s in CYCLE_STAGES if s != "end"]
    rows, expected = [], []
    for e in range(300):
        chosen = [rng.choice(stages) for _ in range(rng.randint(1, 8))]
        limit = rng.randint(1, 8)
        rows += [(f"e{e}", "p", i, s, limit) for i, s in enumerate(chosen)]
        used = latest = None
        for i, s in enumerate(chosen):
            used, latest = i + 1, s
            if s in (PASS_STAGE, "exception"):
                break
        if latest == "exception":
            expected.append((f"e{e}", None, None, None, None, latest, False))
        else:
            passed = latest == PASS_STAGE
            expected.append((f"e{e}", "p", used, limit, used > limit, latest, passed))
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows,
        "experiment_execution_uuid string, llm_provider_name string, cycle_num int, "
        "exit_stage string, allowed int",
    )
    keys = ["experiment_execution_uuid", "llm_provider_name"]
    rolled = summary.rollup_cycles(df, keys, limit="allowed")
    assert rows_of(rolled) == sorted(expected, key=repr)
    assert summary.rollup_cycles(df).columns == [
        "experiment_execution_uuid", "used_cycle_count", "latest_exit_stage", "was_testbench_passed"
    ]


def test_rollup_rejects_unknown_stages(spark):
    df = spark.createDataFrame(
        [("a", 0, "what")], "experiment_execution_uuid string, cycle_num int, exit_stage string"
    )
    with pytest.raises(Exception, match="unknown exit stage: what"):
        summary.rollup_cycles(df).collect()


@pytest.fixture
def log(spark):
    rows = [
        ("p", "m1", "tb_pass"), ("p", "m1", "tb_pass"), ("p", "m1", "tb_fail"), ("p", "m2", "tb_fail"),
        (None, None, "exception"),
    ]
    return spark.createDataFrame(
        rows, "llm_provider_name string, configured_llm_name string, exit_stage string"
    )


def test_summaries(log):
    one = summary.stages_by_model(log)
    assert [tuple(r) for r in one.collect()] == [
        (None, None, "exception", 1), ("p", "m1", "tb_fail", 1), ("p", "m1", "tb_pass", 2),
        ("p", "m2", "tb_fail", 1),
    ]
    two = summary.pivot_stages(one)
    assert two.columns[2:] == ["exception", "tb_fail", "tb_pass", "other"]
    assert rows_of(two) == [
        ("p", "m1", 0, 1, 2, 0), ("p", "m2", 0, 1, 0, 0), (None, None, 1, 0, 0, 0),
    ]
    listed = summary.pivot_stages(one, stages=["tb_pass", "end"])
    assert listed.columns[2:] == ["end", "tb_pass", "other"]
    total = sum(r["count"] for r in one.collect())
    for pivoted in (two, listed):
        assert total == log.count() == sum(sum(r[2:]) for r in pivoted.collect())


def test_counters(log):
    assert summary.run_counters(log).first().asDict() == {
        "total_experiment_count": 5, "exception_count": 1, "nonexception_count": 4,
    }
    counted = summary.run_counters(log, valid=F.col("configured_llm_name") == "m1").first()
    assert (counted["valid_count"], counted["invalid_count"]) == (3, 2)


def test_stability(spark):
    rows = [("m", "p", "x")] * 4 + [("m", "q", "x"), ("m", "q", "y")]
    df = spark.createDataFrame(rows, "configured_llm_name string, prompt string, response string")
    assert rows_of(summary.response_stability(df)) == [
        ("m", "p", 4, 1, True), ("m", "q", 2, 2, False),
    ]
    for promise, kept in ((True, False), (False, True)):
        flagged = df.withColumn("is_stable", F.lit(promise))
        got = summary.response_stability(flagged, is_stable="is_stable")
        assert rows_of(got.select("prompt", "is_as_promised")) == [("p", True), ("q", kept)]


def test_distinct_agents(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("",), ("b",)], "agent_name string")
    assert rows_of(summary.distinct_agents(df)) == [("a",), ("b",)]


# -- scoring ---------------------------------------------------------------------------------


def test_scoring_marks_failing_rows(spark):
    big = 2**60 + 1
    df = spark.createDataFrame(
        [(big, "hi", [("before", "user")]), (None, "bad", None), (3, "yo", [])],
        "i bigint, prompt string, past array<struct<content:string,role:string>>",
    )

    def respond(prompts, histories):
        if "bad" in prompts:
            raise ValueError("cannot")
        return [f"{p} after {[m['content'] for m in past]}" for p, past in zip(prompts, histories)]

    got = scoring.score_prompts(df, respond, history="past").select("i", "response", "error")
    assert rows_of(got) == sorted(
        [(big, "hi after ['before']", None), (None, None, "cannot"), (3, "yo after []", None)],
        key=repr,
    )
