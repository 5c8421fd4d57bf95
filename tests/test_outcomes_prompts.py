"""Outcome columns over all gate combinations, and prompt texts letter by letter."""

import itertools

import pytest
from pyspark.sql import functions as F

from evalspark.functions import outcomes, prompts, toolout
from evalspark.schemas import AGENT_VARIANT_ROWS


@pytest.fixture(scope="module")
def gates(spark):
    codes, lates, passed = (None, 0, 1), (False, True), (None, True, False)
    rows = [
        (i, *row)
        for i, row in enumerate(
            itertools.product((None, "code"), codes, lates, codes, lates, passed)
        )
    ]
    return spark.createDataFrame(
        rows, "i int, code string, cc int, cl boolean, ec int, el boolean, passed boolean"
    ).cache()


def _by_hand(df, column, decide):
    rows = df.select("*", column.alias("got")).collect()
    assert len(rows) > 100
    for r in rows:
        assert r["got"] == decide(r), r


def test_oneshot(gates):
    def decide(r, extraction=True):
        if extraction and r["code"] is None:
            return "code_extraction_error"
        if r["cc"] != 0:
            return "iverilog_compile_error"
        if r["ec"] != 0:
            return "iverilog_execute_error"
        return {True: "tb_pass", False: "tb_fail", None: "tb_stats_not_found"}[r["passed"]]

    _by_hand(gates, outcomes.oneshot_stage("code", "cc", "ec", "passed"), decide)
    _by_hand(
        gates, outcomes.oneshot_stage(None, "cc", "ec", "passed"), lambda r: decide(r, False)
    )


@pytest.mark.parametrize("separate", [True, False])
def test_cycle(gates, separate):
    def decide(r):
        if r["code"] is None:
            return "20_code_extraction_error"
        if separate and r["cl"]:
            return "25_iverilog_compile_timeout"
        if r["cc"] != 0:
            return "30_iverilog_compile_error"
        if separate and r["el"]:
            return "35_iverilog_execute_timeout"
        if r["ec"] != 0:
            return "40_iverilog_execute_error"
        return {True: "80_tb_passed", False: "60_tb_failed", None: "exception"}[r["passed"]]

    column = outcomes.cycle_stage(
        "code", "cc", "cl", "ec", "el", "passed", separate_timeouts=separate
    )
    _by_hand(gates, column, decide)


def test_tool_status(gates):
    _by_hand(
        gates,
        outcomes.tool_status("cc", "ec"),
        lambda r: "compile_error" if r["cc"] != 0 else "execute_error" if r["ec"] != 0 else "success",
    )


@pytest.mark.parametrize("wording", ["debugger", "retry"])
def test_failure_words(gates, wording):
    running, hint = {
        "debugger": (
            "running the simulation",
            " (simulation timed out; check for self-referential combinatorial assignments)",
        ),
        "retry": ("running the code/simulation", " (simulation timed out)"),
    }[wording]

    def decide(r):
        if r["code"] is None:
            return "extracting the code"
        if r["cc"] != 0:
            return "compiling the code"
        if r["el"] or r["ec"] != 0:
            return running + (hint if r["el"] else "")
        return "passing the testbench" if r["passed"] is False else None

    args = (F.col("code").isNotNull(), "cc", "ec", "el", "passed", wording)
    _by_hand(gates, outcomes.failure_words(*args, strict=False), decide)
    with pytest.raises(Exception, match="no failure stage"):
        gates.select(outcomes.failure_words(*args)).collect()


def test_bug_verdict(values):
    texts = ["Bug Found", "BUG NOT FOUND", "bug found or bug not found", "none", "bug  found"]
    assert values(texts, outcomes.bug_verdict) == [
        "BUG FOUND", "BUG NOT FOUND", "UNKNOWN", "UNKNOWN", "UNKNOWN",
    ]


# -- prompts ---------------------------------------------------------------------------------

TEMPLATE = "Template module:\nmodule m();\n// Your solution here"


@pytest.fixture(scope="module")
def problem(spark):
    return spark.createDataFrame([("Build it.", "module m();")], "d string, h string")


def _text(df, column):
    return df.select(column.alias("p")).first()[0]


def test_single_shot(problem):
    assert _text(problem, prompts.single_shot_prompt("d", "h")) == (
        "You are a student learning Verilog/SystemVerilog. Solve the following problem by writing a "
        "Verilog module. Wrap your code in Markdown code blocks. Do not write anything extraneous "
        "to the Verilog solution. You will be given a template module. In your solution, repeat "
        "the template, and complete the rest of the module. Your solution should be a Verilog "
        "module which meets the following requirements: Build it.\n\n" + TEMPLATE
    )
    missing = problem.select(prompts.single_shot_prompt("d", F.lit(None).cast("string")))
    assert missing.first()[0].endswith("Template module:\nNone\n// Your solution here")


def test_initial(problem):
    shared = (
        "Solve the following problem by writing a Verilog module.\n"
        "Wrap your code in Markdown code blocks.\n"
        "Do not write anything extraneous to the Verilog solution.\n"
        "You will be given a template module. In your solution, repeat the template, and fill in "
        "your solution.\n"
        "Your solution should be a Verilog module which meets the following requirements:"
    )
    tail = "\nBuild it.\n\n\n" + TEMPLATE
    assert _text(problem, prompts.initial_prompt("d", "h")) == shared + tail
    assert _text(problem, prompts.initial_prompt("d", "h", "retry")) == (
        "You are a Verilog designer solving an elementary implementation problem.\n"
        + shared + " " + tail
    )
    with pytest.raises(ValueError):
        prompts.initial_prompt("d", "h", "other")


def test_bug_scan(values):
    text = values(["a\nb"], prompts.bug_scan_prompt)[0]
    assert text.startswith("You are the designer of the OpenTitan Hardware Root of Trust. ")
    assert text.endswith("you must include 'BUG FOUND' or 'BUG NOT FOUND'. \n\n1: a\n2: b")


@pytest.fixture(scope="module")
def attempts(spark):
    rows = [
        ("extract", None, None, False, None, False, None),
        ("compile", "c1\nc2", 1, False, None, False, None),
        ("timeout", "c1", 0, False, None, True, None),
        ("execute", "c1", 0, False, 3, False, None),
        ("bench", "c1", 0, False, 0, False, False),
    ]
    df = spark.createDataFrame(
        rows, "name string, code string, cc int, cl boolean, ec int, el boolean, passed boolean"
    )
    none = F.lit("")
    return df.select(
        "*",
        F.lit("Build it.").alias("d"),
        F.lit("module m();").alias("h"),
        F.when(F.col("code").isNotNull(), toolout.command_summary("cc", "cl", none, none)).alias("ct"),
        F.when(F.col("cc") == 0, toolout.command_summary("ec", "el", none, none)).alias("et"),
    ).cache()


COMPILE_TEXT = {"compile": "1 (failed)", "timeout": "0 (success)", "execute": "0 (success)",
                "bench": "0 (success)"}
EXECUTE_TEXT = {"timeout": "None (failed, timed out)", "execute": "3 (failed)",
                "bench": "0 (success)"}


def _tools(name):
    parts = []
    if name in COMPILE_TEXT:
        parts.append(f"Compile result:\nCommand return code: {COMPILE_TEXT[name]}")
    if name in EXECUTE_TEXT:
        parts.append(f"Execute result:\nCommand return code: {EXECUTE_TEXT[name]}")
    return parts


def test_retry(attempts):
    prompt = prompts.retry_prompt(
        "d", "h", F.col("code").isNotNull(), "cc", "ct", "ec", "el", "et", "passed"
    )
    got = {r["name"]: r["p"] for r in attempts.select("name", prompt.alias("p")).collect()}
    step = {
        "extract": "extracting the code",
        "compile": "compiling the code",
        "timeout": "running the code/simulation (simulation timed out)",
        "execute": "running the code/simulation",
        "bench": "passing the testbench",
    }
    for name, words in step.items():
        intro = (
            "Please make sure to follow the requested top-level module template in your response."
            if name == "extract"
            else "Here is the success/failure output from each tool:"
        )
        assert got[name] == "\n\n".join(
            [
                "Your solution is not quite right.",
                f"It failed at this step: {words}.",
                intro,
                *_tools(name),
                *(["The testbench did not pass."] if name == "bench" else []),
                "Please try to solve the problem again: ",
                "Build it.",
                TEMPLATE,
            ]
        )


@pytest.mark.parametrize("variant", AGENT_VARIANT_ROWS, ids=lambda v: v[0])
def test_debugger_and_designer(attempts, variant):
    _, _, repeat, numbers, phrasing, location, wrap, _ = variant
    shown = prompts.code_for_prompt("code", F.lit(numbers))
    debug = prompts.debugger_prompt(
        "d", shown, "cc", "ct", "ec", "el", "et", F.lit(False), F.lit(phrasing), F.lit(location),
        F.lit(wrap),
    )
    design = prompts.designer_prompt("d", F.lit("Look again."), shown, F.lit(repeat))
    rows = attempts.select("name", "code", debug.alias("debug"), design.alias("design")).collect()
    assert len(rows) == 5
    step = {
        "extract": "extracting the code",
        "compile": "compiling the code",
        "timeout": "running the simulation (simulation timed out; check for self-referential "
        "combinatorial assignments)",
        "execute": "running the simulation",
        "bench": "passing the testbench",
    }
    request = {
        "basic": "Please construct feedback for the Designer Employee, such that they can better "
        "attempt to solve the problem next time. Do not provide a solution. You may, however, "
        "reference parts of the solution in your feedback.",
        "be_specific": "Please construct a report for the Designer Employee, such that they can "
        "better attempt to solve the problem next time. Be EXTREMELY SPECIFIC about what you think "
        "the issue(s) may be, and how they can be fixed. Be precise and detailed.",
    }[phrasing]
    for r in rows:
        code = r["code"]
        if code and numbers:
            code = "\n".join(f"{i}: {x}" for i, x in enumerate(code.split("\n"), start=3))
        fenced = f"```verilog\n{code}\n```" if wrap else code
        solution = ["The designer proposed the following solution:", fenced] if code else []
        intro = (
            "Here is the success/failure output from each tool:"
            if code
            else "It is important to follow the requested top-level module template."
        )
        assert r["debug"] == "\n\n".join(
            [
                "Your coworker, the Designer Employee, has attempted to solve the following "
                "problem: ",
                "Build it.",
                "The solution your coworker came up with is not quite right.",
                *([request] if location == "top" else []),
                *solution,
                f"When testing the solution, it failed at this step: {step[r['name']]}.",
                intro,
                *_tools(r["name"]),
                "The testbench did not pass.",
                *([request] if location == "bottom" else []),
            ]
        )
        recalled = ["Recall, your previous solution was:", code] if repeat and code else []
        assert r["design"] == "\n\n".join(
            [
                "You have attempted to solve the following problem: ",
                "Build it.",
                "The solution you came up with is not quite right.",
                *recalled,
                "The Debugger Employee has provided the following feedback:",
                "Look again.",
                "Please attempt to solve the problem correctly.",
            ]
        )


def test_unknown_phrasing_raises(attempts):
    prompt = prompts.debugger_prompt(
        "d", "code", "cc", "ct", "ec", "el", "et", F.lit(False), F.lit("loud"), F.lit("top"),
        F.lit(True),
    )
    with pytest.raises(Exception, match="unknown phrasing"):
        attempts.select(prompt).collect()
