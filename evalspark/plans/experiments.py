"""Whole experiments as one plan each: stored answers and command results in, result tables out.

The four experiments: one attempt per problem, checking the testbenches with the known solutions,
cycles with feedback, and the scan of source files for bugs. Rows that fail become exception rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.extract import extract_code
from evalspark.functions.outcomes import bug_verdict, cycle_stage, oneshot_stage
from evalspark.functions.prompts import bug_scan_prompt
from evalspark.functions.strings import ColumnOrName, as_col
from evalspark.functions.toolout import testbench_result
from evalspark.operators.checks import extraction_ok
from evalspark.operators.history import until_end
from evalspark.operators.joins import EXPERIMENT, attach_results
from evalspark.operators.projections import has_solution_and_testbench
from evalspark.operators.summary import rollup_cycles

_STEP_COLUMNS = ("result_return_code", "result_stdout", "result_stderr")


def experiment_key(*parts: ColumnOrName) -> Column:
    """A key that is the same in every run: the digest of what makes the experiment unique."""
    texts = [F.coalesce(as_col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.to_json(F.array(*texts)), 256)


def _with_results(attempts: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach command results, and blank those of steps that an earlier gate keeps from running."""
    joined = attach_results(attempts, results, key)
    gates = {
        "compile": F.col("extracted_generated_code").isNotNull(),
        "execute": F.col("extracted_generated_code").isNotNull()
        & F.coalesce(F.col("was_compile_success"), F.lit(False)),
    }
    gated = {
        column: F.when(ran, F.col(column))
        for step, ran in gates.items()
        for column in (*[f"{step}_{c}" for c in _STEP_COLUMNS], f"was_{step}_success")
    }
    joined = joined.withColumns(gated)
    known = F.coalesce(F.col("was_execute_success"), F.lit(False))
    return (
        joined.withColumn("_tb", F.when(known, testbench_result("execute_result_stdout")))
        .withColumn("was_testbench_passed", F.col("_tb.was_testbench_passed"))
        .withColumn("testbench_stats", F.col("_tb.testbench_stats"))
        .drop("_tb")
    )


def single_shot(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """One attempt per experiment, with everything known about it and its exit stage.

    ``attempts`` has the experiment key and ``llm_response``; ``results`` one row per experiment
    and step.
    """
    extracted = attempts.withColumn("extracted_generated_code", extract_code("llm_response"))
    return _with_results(extracted, results, [EXPERIMENT]).withColumn(
        "exit_stage",
        oneshot_stage(
            "extracted_generated_code",
            "compile_result_return_code",
            "execute_result_return_code",
            "was_testbench_passed",
        ),
    )


def validate_testbenches(problems: DataFrame, results: DataFrame) -> DataFrame:
    """The known solutions put through the same commands; problems without data are left out.

    A solution from which the extractor does not get most of the code is an exception row.
    """
    checked = has_solution_and_testbench(problems).withColumn(
        "_code", extract_code("canonical_solution")
    )
    problem = F.when(
        F.coalesce(F.col("_code"), F.lit("")) == "",
        "No module can be found in the known solution.",
    ).when(
        ~extraction_ok(F.col("_code"), F.col("canonical_solution")), "Extracted code is too short."
    )
    attempts = (
        checked.withColumn("error", problem)
        # nothing is compiled after a failed check
        .withColumn(
            "extracted_generated_code", F.when(F.col("error").isNull(), F.col("canonical_solution"))
        )
        .drop("_code")
    )
    stage = oneshot_stage(
        None, "compile_result_return_code", "execute_result_return_code", "was_testbench_passed"
    )
    return (
        _with_results(attempts, results, [EXPERIMENT])
        .withColumn("exit_stage", F.when(F.col("error").isNotNull(), "exception").otherwise(stage))
        .withColumnRenamed("extracted_generated_code", "solution_code")
    )


def _timed_out(step: str) -> Column:
    """A command that ran but has no return code was stopped."""
    return F.col(f"was_{step}_success").isNotNull() & F.col(f"{step}_result_return_code").isNull()


def classified_cycles(
    cycles: DataFrame, results: DataFrame, separate_timeouts: bool = True
) -> DataFrame:
    """All cycles with their results and exit stage.

    ``cycles`` has the experiment key, ``cycle_num`` and ``llm_response``.
    """
    extracted = cycles.withColumn("extracted_generated_code", extract_code("llm_response"))
    return _with_results(extracted, results, [EXPERIMENT, "cycle_num"]).withColumn(
        "exit_stage",
        cycle_stage(
            "extracted_generated_code",
            "compile_result_return_code",
            _timed_out("compile"),
            "execute_result_return_code",
            _timed_out("execute"),
            "was_testbench_passed",
            separate_timeouts,
        ),
    )


def cycle_log(cycles: DataFrame, results: DataFrame, separate_timeouts: bool = True) -> DataFrame:
    """Classified cycles up to the first pass or exception of each experiment."""
    return until_end(classified_cycles(cycles, results, separate_timeouts))


def cycle_experiments(log: DataFrame, keys: list[str], limit: str | None = None) -> DataFrame:
    """Experiment rows from classified cycles, whether or not cut where they ended.

    ``limit`` names the column with the cycles that an experiment's variant allows.
    """
    return rollup_cycles(log, keys, limit=limit)


def bug_scan(files: DataFrame, responses: DataFrame, models: list[str]) -> DataFrame:
    """Every file with every model, and every other answer that there is, with prompt and verdict.

    ``files`` has file_path, file_name and contents, ``responses`` one row per file and model with
    ``llm_response`` (null when the query failed, then ``error`` says why). A file that a model did
    not answer is an exception row. An answer of a model that is not listed, or to a file that is
    not there, has a row too, the latter without name and prompt. Two answers of one model to one
    file raise; a job over these two columns looks for that first. Contents move as they are; the
    longer prompt is made afterwards.
    """
    key = ["target_file_path", "configured_llm_name"]
    again = responses.groupBy(*key).count().where("count > 1").select(*key).first()
    if again is not None:
        raise ValueError(f"an answer is there more than once: {again.asDict()}")
    named = files.select(
        F.col("file_path").alias("target_file_path"),
        F.col("file_name").alias("target_file_name"),
        "contents",
    )
    # answers meet per file first, so that a file's contents move once whatever the models
    answers = [c for c in responses.columns if c != "target_file_path"]
    per_file = responses.groupBy("target_file_path").agg(
        F.collect_list(F.struct(*answers)).alias("_answers")
    )
    met = named.withColumn("_listed", F.lit(True)).join(per_file, "target_file_path", "full_outer")
    none = F.array().cast("array<string>")
    listed = F.when(F.col("_listed"), F.array(*[F.lit(m) for m in models]).cast("array<string>"))
    answered_by = F.coalesce(F.col("_answers")["configured_llm_name"], none)
    asked = F.array_union(F.coalesce(listed, none), answered_by)
    grid = met.withColumn("configured_llm_name", F.explode(asked))
    own = F.filter(
        "_answers", lambda a: a["configured_llm_name"].eqNullSafe(F.col("configured_llm_name"))
    )
    found = grid.withColumn("_answer", F.get(own, F.lit(0)))
    rest = [F.col("_answer")[c].alias(c) for c in answers if c not in key]
    answered = F.col("llm_response").isNotNull()
    return (
        found.select(*key, "target_file_name", bug_scan_prompt("contents").alias("llm_prompt"), *rest)
        .withColumn(
            "bug_found_status", F.when(answered, bug_verdict("llm_response")).otherwise("exception")
        )
    )
