"""Parsing of compiler, simulator and server output, and its rendering for prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.extract import strip_paths
from evalspark.functions.strings import ColumnOrName, as_col, bind, blank_to_null, first_match
from evalspark.schemas import TESTBENCH_STATS

# The output patterns.
MISMATCH_LINE = r"(?i)Total mismatched samples is (\d+) out of (\d+) samples"
TOOL_LINE = r"(?Ud)^\s*(.*Icarus.+?)\s+([vV]ersion\s+)?((\d+\.\d+(\.\d+)?).*)$"
# digits with single dots between them, written as a flat loop
SERVER_VERSION = r"(?i)version is (\d(?:[\d.](?<!\.\.))*)"
PARAMETER_COUNT = r"(\d+(\.\d+)?)b"


def testbench_result(stdout: ColumnOrName, strict: bool = False) -> Column:
    """Struct (testbench_stats JSON, was_testbench_passed) from the first mismatch line.

    Without such a line both fields are null; ``strict`` raises instead.
    """
    stdout = as_col(stdout)
    missing = (
        F.raise_error(F.lit("no mismatched sample count in the testbench output")).cast(
            "struct<testbench_stats:string,was_testbench_passed:boolean>"
        )
        if strict
        else F.lit(None)
    )

    def parsed(counts: Column) -> Column:
        return F.when(
            counts["mismatch_sample_count"].isNotNull(),
            F.struct(
                F.to_json(counts).alias("testbench_stats"),
                (counts["mismatch_sample_count"] == 0).alias("was_testbench_passed"),
            ),
        ).otherwise(missing)

    # one search for the whole line; the two numbers are then read from that short match
    return bind(
        F.regexp_extract(stdout, MISMATCH_LINE, 0),
        lambda line: bind(
            F.struct(
                F.regexp_extract(line, MISMATCH_LINE, 1)
                .try_cast("bigint")
                .alias("mismatch_sample_count"),
                F.regexp_extract(line, MISMATCH_LINE, 2)
                .try_cast("bigint")
                .alias("total_sample_count"),
            ),
            parsed,
        ),
    )


def read_stats(stats: ColumnOrName) -> Column:
    """Typed struct back from the stored JSON stats."""
    return F.from_json(as_col(stats), TESTBENCH_STATS)


def tool_versions(stdout: ColumnOrName) -> Column:
    """Array of (tool_name, version_num, full_version_id), one per banner line.

    The text is cut into lines first, and only lines that name the tool are matched.
    """
    lines = F.filter(F.split(as_col(stdout), "\n", -1), lambda line: line.contains("Icarus"))
    return F.transform(
        F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.rlike(TOOL_LINE)),
        lambda line: F.struct(
            F.regexp_extract(line, TOOL_LINE, 1).alias("tool_name"),
            F.regexp_extract(line, TOOL_LINE, 4).alias("version_num"),
            F.regexp_extract(line, TOOL_LINE, 3).alias("full_version_id"),
        ),
    )


def server_version(stdout: ColumnOrName) -> Column:
    return first_match(as_col(stdout), SERVER_VERSION)


def parameter_count(model_name: ColumnOrName, strict: bool = False) -> Column:
    """Billions of parameters named in a model tag such as ``name:7b``."""
    name = as_col(model_name)
    count = first_match(name, PARAMETER_COUNT).try_cast("double")
    if not strict:
        return count
    problem = F.concat(F.lit("no parameter count in model name: "), name)
    return F.coalesce(count, F.raise_error(problem).cast("double"))


def command_summary(
    return_code: ColumnOrName, timed_out: ColumnOrName, stdout: ColumnOrName, stderr: ColumnOrName
) -> Column:
    """Readable summary of one command run; empty streams are left out."""
    code = as_col(return_code)
    verdict = (
        F.when(code.eqNullSafe(F.lit(0)), " (success)")
        .when(as_col(timed_out), " (failed, timed out)")
        .otherwise(" (failed)")
    )
    head = F.concat(
        F.lit("Command return code: "), F.coalesce(code.cast("string"), F.lit("None")), verdict
    )

    def stream(name: str, text: Column) -> Column:
        return F.concat(F.lit(f"Command {name}:\n"), strip_paths(blank_to_null(text)))

    return F.concat_ws(
        "\n\n", head, stream("stdout", as_col(stdout)), stream("stderr", as_col(stderr))
    )


def with_timescale(code: ColumnOrName, always: bool = False) -> Column:
    """Put the simulator time scale in front, unless it is there already, and end the line."""
    code = as_col(code)
    longer = F.concat(F.lit("`timescale 1 ps/1 ps\n\n"), code, F.lit("\n"))
    if always:
        return longer
    return F.when(code.startswith("`timescale"), F.concat(code, F.lit("\n"))).otherwise(longer)
