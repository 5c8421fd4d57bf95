"""Whole experiments on a few hand-made rows."""

import pytest

from evalspark.plans import experiments

FENCE = "`" * 3
CODE = f"{FENCE}verilog\nmodule m; endmodule\n{FENCE}"
PASS = "Total mismatched samples is 0 out of 9 samples"
FAIL = "Total mismatched samples is 2 out of 9 samples"
RESULT = (
    "experiment_execution_uuid string, cycle_num bigint, step string, return_code int, "
    "stdout string, stderr string"
)


def result_rows(key, cycle, compile_code, execute_code, out):
    return [
        (key, cycle, "compile", compile_code, "", ""),
        (key, cycle, "execute", execute_code, out, ""),
    ]


def test_single_shot(spark):
    cases = {
        "none": ("no code", 0, 0, PASS, "code_extraction_error"),
        "compile": (CODE, 1, 0, PASS, "iverilog_compile_error"),
        "late": (CODE, 0, None, PASS, "iverilog_execute_error"),
        "pass": (CODE, 0, 0, PASS, "tb_pass"),
        "fail": (CODE, 0, 0, FAIL, "tb_fail"),
        "lost": (CODE, 0, 0, "", "tb_stats_not_found"),
    }
    attempts = spark.createDataFrame(
        [(k, c[0]) for k, c in cases.items()], "experiment_execution_uuid string, llm_response string"
    )
    results = spark.createDataFrame(
        [r for k, c in cases.items() for r in result_rows(k, 0, *c[1:4])], RESULT
    )
    rows = {r[0]: r for r in experiments.single_shot(attempts, results).collect()}
    assert {k: r["exit_stage"] for k, r in rows.items()} == {k: c[4] for k, c in cases.items()}
    # nothing is known of steps behind a failed gate
    assert rows["none"]["was_compile_success"] is None
    assert rows["compile"]["was_compile_success"] is False
    assert rows["compile"]["execute_result_stdout"] is None
    assert rows["late"]["was_execute_success"] is False
    assert rows["late"]["was_testbench_passed"] is None
    assert rows["pass"]["was_testbench_passed"] is True
    assert rows["fail"]["testbench_stats"] == '{"mismatch_sample_count":2,"total_sample_count":9}'
    assert rows["pass"]["extracted_generated_code"] == "module m; endmodule"


def test_validation(spark):
    problems = spark.createDataFrame(
        [
            ("ok", f"module m; {'x' * 200} endmodule", "tb"),
            ("bad", "nothing to find", "tb"),
            ("short", "module m; abc endmodule" + " " * 200 + "tail", "tb"),
            ("no tb", "module m; endmodule", None),
            ("no solution", None, "tb"),
        ],
        "experiment_execution_uuid string, canonical_solution string, testbench_code string",
    )
    results = spark.createDataFrame(
        [r for k in ("ok", "bad", "short") for r in result_rows(k, 0, 0, 0, PASS)], RESULT
    )
    checked = experiments.validate_testbenches(problems, results)
    rows = {r[0]: (r["exit_stage"], r["error"]) for r in checked.collect()}
    assert rows == {
        "ok": ("tb_pass", None),
        "bad": ("exception", "No module can be found in the known solution."),
        "short": ("exception", "Extracted code is too short."),
    }


@pytest.mark.parametrize("cut", [True, False])
def test_cycle_loop(spark, cut):
    cycles = [("a", i, CODE, 3) for i in range(4)] + [("b", 0, "no", 3), ("b", 1, CODE, 3)]
    cycles += [("c", 0, CODE, 3)] + [("d", i, CODE, 1) for i in range(3)]
    cycles += [("e", i, CODE, 9) for i in range(3)]
    codes = {("a", 0): (0, 0, FAIL), ("a", 1): (0, 0, PASS), ("a", 2): (1, 0, ""), ("a", 3): (1, 0, ""),
             ("b", 1): (0, None, ""), ("c", 0): (None, 0, ""), ("d", 0): (0, 0, FAIL),
             ("d", 1): (0, 0, FAIL), ("d", 2): (0, 0, PASS), ("e", 0): (0, 0, FAIL),
             ("e", 1): (0, 0, "unreadable"), ("e", 2): (0, 0, PASS)}
    attempts = spark.createDataFrame(
        cycles,
        "experiment_execution_uuid string, cycle_num bigint, llm_response string, allowed int",
    )
    results = spark.createDataFrame(
        [r for (k, i), c in codes.items() for r in result_rows(k, i, *c)], RESULT
    )
    build = experiments.cycle_log if cut else experiments.classified_cycles
    staged = build(attempts, results)
    stages = {(r[0], r["cycle_num"]): r["exit_stage"] for r in staged.collect()}
    expected = {
        ("a", 0): "60_tb_failed", ("a", 1): "80_tb_passed", ("b", 0): "20_code_extraction_error",
        ("b", 1): "35_iverilog_execute_timeout", ("c", 0): "25_iverilog_compile_timeout",
        ("d", 0): "60_tb_failed", ("d", 1): "60_tb_failed", ("d", 2): "80_tb_passed",
        ("e", 0): "60_tb_failed", ("e", 1): "exception",
    }
    behind = {("a", 2): "30_iverilog_compile_error", ("a", 3): "30_iverilog_compile_error",
              ("e", 2): "80_tb_passed"}
    assert stages == expected | ({} if cut else behind)
    rolled = experiments.cycle_experiments(staged, ["experiment_execution_uuid"], "allowed")
    assert sorted(tuple(r) for r in rolled.collect()) == [
        ("a", 2, 3, False, "80_tb_passed", True),
        ("b", 2, 3, False, "35_iverilog_execute_timeout", False),
        ("c", 1, 3, False, "25_iverilog_compile_timeout", False),
        ("d", 3, 1, True, "80_tb_passed", True),
        ("e", None, None, None, "exception", False),
    ]


def test_bug_scan(spark):
    files = spark.createDataFrame(
        [("/a.v", "a.v", "x\ny"), ("/b.v", "b.v", "z"), ("/c.v", "c.v", "")],
        "file_path string, file_name string, contents string",
    )
    responses = spark.createDataFrame(
        [("/a.v", "m", "Bug found.", None), ("/b.v", "m", None, "boom")],
        "target_file_path string, configured_llm_name string, llm_response string, error string",
    )
    scanned = experiments.bug_scan(files, responses, ["m", "n"]).collect()
    rows = {(r["target_file_name"], r["configured_llm_name"]): r for r in scanned}
    assert len(scanned) == len(rows) == 6
    assert rows["a.v", "m"]["llm_prompt"].endswith("\n\n1: x\n2: y")
    assert rows["a.v", "m"]["bug_found_status"] == "BUG FOUND"
    assert rows["b.v", "m"]["bug_found_status"] == "exception"
    assert rows["b.v", "m"]["error"] == "boom"
    unanswered = [rows[f, m] for f, m in rows if m == "n" or f == "c.v"]
    assert {(r["bug_found_status"], r["error"], r["llm_response"]) for r in unanswered} == {
        ("exception", None, None)
    }


ANSWERED = "target_file_path string, configured_llm_name string, llm_response string, error string"


def test_bug_scan_loses_no_answer(spark):
    files = spark.createDataFrame(
        [("/a.v", "a.v", "x"), (None, "b.v", "y")], "file_path string, file_name string, contents string"
    )
    said = [
        ("/a.v", "m", "Bug found.", None),
        ("/a.v", "other", "Bug not found.", None),
        ("/a.v", None, "neither", None),
        ("/gone.v", "m", "Bug found.", None),
        ("/gone.v", "other", None, "boom"),
        (None, "m", "Bug not found.", None),
    ]
    scanned = experiments.bug_scan(files, spark.createDataFrame(said, ANSWERED), ["m", "n"]).collect()
    found = {
        (r["target_file_path"], r["target_file_name"], r["configured_llm_name"]): (
            r["llm_response"],
            r["bug_found_status"],
            r["llm_prompt"] is None,
        )
        for r in scanned
    }
    assert found == {
        ("/a.v", "a.v", "m"): ("Bug found.", "BUG FOUND", False),
        ("/a.v", "a.v", "n"): (None, "exception", False),
        ("/a.v", "a.v", "other"): ("Bug not found.", "BUG NOT FOUND", False),
        ("/a.v", "a.v", None): ("neither", "UNKNOWN", False),
        ("/gone.v", None, "m"): ("Bug found.", "BUG FOUND", True),
        ("/gone.v", None, "other"): (None, "exception", True),
        (None, "b.v", "m"): (None, "exception", False),
        (None, "b.v", "n"): (None, "exception", False),
        (None, None, "m"): ("Bug not found.", "BUG NOT FOUND", True),
    }
    assert len(scanned) == len(found)


def test_bug_scan_without_files_or_answers(spark):
    files = spark.createDataFrame([], "file_path string, file_name string, contents string")
    none = spark.createDataFrame([], ANSWERED)
    assert experiments.bug_scan(files, none, ["m"]).collect() == []
    one = spark.createDataFrame([("/a.v", "m", "Bug found.", None)], ANSWERED)
    assert [r["bug_found_status"] for r in experiments.bug_scan(files, one, []).collect()] == ["BUG FOUND"]


def test_bug_scan_refuses_repeated_answers(spark):
    files = spark.createDataFrame([("/a.v", "a.v", "x")], "file_path string, file_name string, contents string")
    said = [("/a.v", "m", "Bug found.", None), ("/a.v", "m", "Bug not found.", None)]
    with pytest.raises(ValueError, match="more than once"):
        experiments.bug_scan(files, spark.createDataFrame(said, ANSWERED), ["m"])


def test_key_depends_on_every_part(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), ("a", "b")], "x string, y string")
    keys = [r[0] for r in df.select(experiments.experiment_key("x", "y")).collect()]
    assert keys[0] == keys[3] and len(set(keys)) == 3
