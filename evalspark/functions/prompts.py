"""Prompt texts as string columns over joined rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.extract import number_lines
from evalspark.functions.outcomes import failure_words
from evalspark.functions.strings import ColumnOrName, as_col

# Prompt wordings. Results must equal them letter by letter.
SINGLE_SHOT = (
    "You are a student learning Verilog/SystemVerilog. "
    "Solve the following problem by writing a Verilog module. "
    "Wrap your code in Markdown code blocks. "
    "Do not write anything extraneous to the Verilog solution. "
    "You will be given a template module. In your solution, repeat the template, and complete "
    "the rest of the module. "
    "Your solution should be a Verilog module which meets the following requirements: "
)
SECURITY_REVIEW = (
    "You are the designer of the OpenTitan Hardware Root of Trust. "
    "A hacker has forked your repository, introduced several security-related mechanisms, and "
    "and has made changes to the code. They introduced a security vulnerability that enables "
    "untrusted agents (as defined in the adversary model "
    "to bypass security features or compromise protected SoC assets. \n\n"
    "In the following code snippet, please identify and describe the bug, if there is one. "
    "Include the line number, "
    "and a brief description of the bug. Each line is prefixed with its line number. "
    "At the end of your response, you must include 'BUG FOUND' or 'BUG NOT FOUND'. \n\n"
)
DESIGNER_SYSTEM = (
    "You work in a hardware design company with many employees. "
    "You are a hardware designer with extensive Verilog experience, who is tasked "
    "with solving a Verilog problem. You must obey instructions."
)
DEBUGGER_SYSTEM = (
    "You work in a hardware design company with many employees. "
    "You are a hardware engineer with extensive debugging experience, who is "
    "tasked with providing feedback on a Verilog solution to better solve the "
    "problem. You must obey instructions."
)
INITIAL_LINES = [
    "Solve the following problem by writing a Verilog module.",
    "Wrap your code in Markdown code blocks.",
    "Do not write anything extraneous to the Verilog solution.",
    "You will be given a template module. In your solution, repeat the template, and "
    "fill in your solution.",
]
RETRY_OPENING = "You are a Verilog designer solving an elementary implementation problem."
REQUIREMENTS = "Your solution should be a Verilog module which meets the following requirements:"
FEEDBACK_REQUEST = {
    "basic": (
        "Please construct feedback for the Designer Employee, such that they can better "
        "attempt to solve the problem next time. Do not provide a solution. You may, however, "
        "reference parts of the solution in your feedback."
    ),
    "be_specific": (
        "Please construct a report for the Designer Employee, such that they can better "
        "attempt to solve the problem next time. Be EXTREMELY SPECIFIC about what you think "
        "the issue(s) may be, and how they can be fixed. Be precise and detailed."
    ),
}
RETRY_INTRO = "Your solution is not quite right."
RETRY_STEP = "It failed at this step: "
RETRY_TEMPLATE_HINT = (
    "Please make sure to follow the requested top-level module template in your response."
)
RETRY_REQUEST = "Please try to solve the problem again: "
DEBUGGER_INTRO = (
    "Your coworker, the Designer Employee, has attempted to solve the following problem: "
)
DEBUGGER_VERDICT = "The solution your coworker came up with is not quite right."
DEBUGGER_CODE_INTRO = "The designer proposed the following solution:"
DEBUGGER_STEP = "When testing the solution, it failed at this step: "
DEBUGGER_TEMPLATE_HINT = "It is important to follow the requested top-level module template."
DESIGNER_INTRO = "You have attempted to solve the following problem: "
DESIGNER_VERDICT = "The solution you came up with is not quite right."
DESIGNER_CODE_INTRO = "Recall, your previous solution was:"
DESIGNER_FEEDBACK_INTRO = "The Debugger Employee has provided the following feedback:"
DESIGNER_REQUEST = "Please attempt to solve the problem correctly."
TOOL_OUTPUT_INTRO = "Here is the success/failure output from each tool:"
TESTBENCH_FAILED = "The testbench did not pass."
PARAGRAPH = "\n\n"


def _shown(value: Column) -> Column:
    """A missing text is printed as ``None``."""
    return F.coalesce(value, F.lit("None"))


def _template(header: Column) -> Column:
    return F.concat(F.lit("Template module:\n"), _shown(header), F.lit("\n// Your solution here"))


def single_shot_prompt(description: ColumnOrName, header: ColumnOrName) -> Column:
    return F.concat(
        F.lit(SINGLE_SHOT),
        _shown(as_col(description)),
        F.lit(PARAGRAPH),
        _template(as_col(header)),
    )


def bug_scan_prompt(source: ColumnOrName) -> Column:
    return F.concat(F.lit(SECURITY_REVIEW), number_lines(source))


def initial_prompt(
    description: ColumnOrName, header: ColumnOrName, loop: str = "debugger"
) -> Column:
    """First prompt of a cycle loop, in the wording of the debugger or of the retry loop."""
    if loop not in ("debugger", "retry"):
        raise ValueError(f"unknown loop: {loop}")
    opening = [RETRY_OPENING] if loop == "retry" else []
    requirements = REQUIREMENTS + (" " if loop == "retry" else "")
    return F.concat_ws(
        "\n",
        F.lit("\n".join([*opening, *INITIAL_LINES, requirements])),
        _shown(as_col(description)),
        F.concat(F.lit(PARAGRAPH), _template(as_col(header))),
    )


def _tool_parts(compile_text: Column, execute_text: Column, passed: Column) -> list[Column]:
    return [
        F.concat(F.lit("Compile result:\n"), compile_text),
        F.concat(F.lit("Execute result:\n"), execute_text),
        F.when(~passed, TESTBENCH_FAILED),
    ]


def retry_prompt(
    description: ColumnOrName,
    header: ColumnOrName,
    has_code: Column,
    compile_code: ColumnOrName,
    compile_text: ColumnOrName,
    execute_code: ColumnOrName,
    execute_timed_out: ColumnOrName,
    execute_text: ColumnOrName,
    passed: ColumnOrName,
    strict: bool = True,
) -> Column:
    """Self-debug prompt. The summaries of steps that did not run are null and left out.

    An attempt that did not fail raises, or gives null when not strict.
    """
    passed = as_col(passed)
    words = failure_words(
        has_code, compile_code, execute_code, execute_timed_out, passed, "retry", strict
    )
    text = F.concat_ws(
        PARAGRAPH,
        F.lit(RETRY_INTRO),
        F.concat(F.lit(RETRY_STEP), words, F.lit(".")),
        F.when(has_code, TOOL_OUTPUT_INTRO).otherwise(RETRY_TEMPLATE_HINT),
        *_tool_parts(as_col(compile_text), as_col(execute_text), passed),
        F.lit(RETRY_REQUEST),
        _shown(as_col(description)),
        _template(as_col(header)),
    )
    return text if strict else F.when(words.isNotNull(), text)


def code_for_prompt(code: ColumnOrName, add_line_numbers: ColumnOrName) -> Column:
    """The last attempt as shown to a model; numbering starts after the two added lines."""
    code = as_col(code)
    return F.when(as_col(add_line_numbers), number_lines(code, start=3)).otherwise(code)


def debugger_prompt(
    description: ColumnOrName,
    code: ColumnOrName,
    compile_code: ColumnOrName,
    compile_text: ColumnOrName,
    execute_code: ColumnOrName,
    execute_timed_out: ColumnOrName,
    execute_text: ColumnOrName,
    passed: ColumnOrName,
    phrasing: ColumnOrName,
    instruction_location: ColumnOrName,
    wrap_in_md: ColumnOrName,
    strict: bool = True,
) -> Column:
    """Prompt for the debugging agent, in all variants.

    An attempt that did not fail raises, or gives null when not strict.
    """
    code, passed, location = as_col(code), as_col(passed), as_col(instruction_location)
    phrasing = as_col(phrasing)
    words = failure_words(
        code.isNotNull(), compile_code, execute_code, execute_timed_out, passed, "debugger", strict
    )
    request = F.when(phrasing == "basic", FEEDBACK_REQUEST["basic"]).when(
        phrasing == "be_specific", FEEDBACK_REQUEST["be_specific"]
    )
    request = F.coalesce(
        request, F.raise_error(F.concat(F.lit("unknown phrasing: "), phrasing)).cast("string")
    )
    shown_code = F.when(
        as_col(wrap_in_md), F.concat(F.lit("```verilog\n"), code, F.lit("\n```"))
    ).otherwise(code)
    text = F.concat_ws(
        PARAGRAPH,
        F.lit(DEBUGGER_INTRO),
        _shown(as_col(description)),
        F.lit(DEBUGGER_VERDICT),
        F.when(location == "top", request),
        F.when(code.isNotNull(), DEBUGGER_CODE_INTRO),
        shown_code,
        F.concat(F.lit(DEBUGGER_STEP), words, F.lit(".")),
        F.when(code.isNotNull(), TOOL_OUTPUT_INTRO).otherwise(DEBUGGER_TEMPLATE_HINT),
        *_tool_parts(as_col(compile_text), as_col(execute_text), passed),
        F.when(location == "bottom", request),
    )
    return text if strict else F.when(words.isNotNull(), text)


def designer_prompt(
    description: ColumnOrName,
    feedback: ColumnOrName,
    code: ColumnOrName,
    repeat_last_attempt: ColumnOrName,
) -> Column:
    """Prompt for the designing agent after feedback."""
    code = as_col(code)
    repeated = as_col(repeat_last_attempt) & code.isNotNull()
    return F.concat_ws(
        PARAGRAPH,
        F.lit(DESIGNER_INTRO),
        _shown(as_col(description)),
        F.lit(DESIGNER_VERDICT),
        F.when(repeated, DESIGNER_CODE_INTRO),
        F.when(repeated, code),
        F.lit(DESIGNER_FEEDBACK_INTRO),
        as_col(feedback),
        F.lit(DESIGNER_REQUEST),
    )
