"""Outcome classification: CASE columns over extraction, compile, execute and testbench results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.strings import ColumnOrName, as_col, bind


def failed(return_code: ColumnOrName) -> Column:
    """True for any return code but 0; a missing code (time-out) counts as failure."""
    return ~as_col(return_code).eqNullSafe(F.lit(0))


def oneshot_stage(
    code: ColumnOrName | None,
    compile_code: ColumnOrName,
    execute_code: ColumnOrName,
    passed: ColumnOrName,
) -> Column:
    """Stage at which a single attempt ended; without a code column there is no extraction gate."""
    passed = as_col(passed)
    not_extracted = F.lit(False) if code is None else as_col(code).isNull()
    return (
        F.when(not_extracted, "code_extraction_error")
        .when(failed(compile_code), "iverilog_compile_error")
        .when(failed(execute_code), "iverilog_execute_error")
        .when(passed, "tb_pass")
        .when(~passed, "tb_fail")
        .otherwise("tb_stats_not_found")
    )


def cycle_stage(
    code: ColumnOrName,
    compile_code: ColumnOrName,
    compile_timed_out: ColumnOrName,
    execute_code: ColumnOrName,
    execute_timed_out: ColumnOrName,
    passed: ColumnOrName,
    separate_timeouts: bool = True,
) -> Column:
    """Stage at which one cycle ended; unreadable simulator output is an exception.

    Without ``separate_timeouts`` time-outs count as plain compile and execute errors.
    """
    passed = as_col(passed)
    stage = F.when(as_col(code).isNull(), "20_code_extraction_error")
    if separate_timeouts:
        stage = stage.when(as_col(compile_timed_out), "25_iverilog_compile_timeout")
    stage = stage.when(failed(compile_code), "30_iverilog_compile_error")
    if separate_timeouts:
        stage = stage.when(as_col(execute_timed_out), "35_iverilog_execute_timeout")
    return (
        stage.when(failed(execute_code), "40_iverilog_execute_error")
        .when(~passed, "60_tb_failed")
        .when(passed, "80_tb_passed")
        .otherwise("exception")
    )


# The words for each failure stage, by loop.
_RUN_WORDS = {
    "debugger": (
        "running the simulation",
        " (simulation timed out; check for self-referential combinatorial assignments)",
    ),
    "retry": ("running the code/simulation", " (simulation timed out)"),
}


def failure_words(
    has_code: Column,
    compile_code: ColumnOrName,
    execute_code: ColumnOrName,
    execute_timed_out: ColumnOrName,
    passed: ColumnOrName,
    wording: str = "debugger",
    strict: bool = True,
) -> Column:
    """What went wrong, in words; an attempt that did not fail raises (or gives null)."""
    running, hint = _RUN_WORDS[wording]
    late = F.coalesce(as_col(execute_timed_out), F.lit(False))
    none_failed = F.raise_error(F.lit("no failure stage")).cast("string") if strict else F.lit(None)
    return (
        F.when(~has_code, "extracting the code")
        .when(failed(compile_code), "compiling the code")
        .when(late, running + hint)
        .when(failed(execute_code), running)
        .when(~as_col(passed), "passing the testbench")
        .otherwise(none_failed)
    )


def bug_verdict(response: ColumnOrName) -> Column:
    """Verdict of a review answer; both phrases or neither give UNKNOWN."""

    def verdict(text: Column) -> Column:
        found, not_found = text.contains("bug found"), text.contains("bug not found")
        return (
            F.when(found & not_found, "UNKNOWN")
            .when(not_found, "BUG NOT FOUND")
            .when(found, "BUG FOUND")
            .otherwise("UNKNOWN")
        )

    return bind(F.lower(as_col(response)), verdict)


def tool_status(compile_code: ColumnOrName, execute_code: ColumnOrName) -> Column:
    return (
        F.when(failed(compile_code), "compile_error")
        .when(failed(execute_code), "execute_error")
        .otherwise("success")
    )
