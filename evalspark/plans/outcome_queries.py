"""Queries over the outcome classification, prompt texts and responders."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import extract, messages as msg, outcomes, prompts, toolout
from evalspark.operators import joins, scoring
from evalspark.plans import inputs as src
from evalspark.plans import oracle_text as ora
from evalspark.plans.inputs import quoted
from evalspark.plans.registry import query
from evalspark.schemas import AGENT_VARIANT_ROWS, AGENT_VARIANTS
from evalspark.session import fresh_path

_RESULTS = f"""with {src.attempts_sql('doc_id', 'text', 'header', 'response', 'stdout', 'stderr',
                                      'compile_code', 'compile_late', 'execute_code',
                                      'execute_late')},
r as (select *, {ora.code('response')} as code, {ora.mismatch('stdout', 1)} = 0 as passed
      from attempts)"""


def _results(spark, sf_dir):
    return (
        src.attempts(spark, sf_dir)
        .withColumn("code", extract.extract_code("response"))
        .withColumn("passed", toolout.testbench_result("stdout")["was_testbench_passed"])
    )


@query(
    "cls_exit_stage_oneshot",
    f"""{_RESULTS}, v as (select *,
      case when compile_code is distinct from 0 then 'iverilog_compile_error'
           when execute_code is distinct from 0 then 'iverilog_execute_error'
           when passed then 'tb_pass' when not passed then 'tb_fail'
           else 'tb_stats_not_found' end as validation_stage from r)
    select doc_id, case when code is null then 'code_extraction_error' else validation_stage end
             as exit_stage, validation_stage from v""",
)
def exit_stage_oneshot(spark, sf_dir):
    gates = ("compile_code", "execute_code", "passed")
    return _results(spark, sf_dir).select(
        "doc_id",
        outcomes.oneshot_stage("code", *gates).alias("exit_stage"),
        outcomes.oneshot_stage(None, *gates).alias("validation_stage"),
    )


@query(
    "cls_exit_stage_cycle",
    f"""{_RESULTS}
    select doc_id,
      case when code is null then '20_code_extraction_error'
           when compile_late then '25_iverilog_compile_timeout'
           when compile_code <> 0 then '30_iverilog_compile_error'
           when execute_late then '35_iverilog_execute_timeout'
           when execute_code <> 0 then '40_iverilog_execute_error'
           when passed then '80_tb_passed' when not passed then '60_tb_failed'
           else 'exception' end as exit_stage,
      case when code is null then '20_code_extraction_error'
           when compile_code is distinct from 0 then '30_iverilog_compile_error'
           when execute_code is distinct from 0 then '40_iverilog_execute_error'
           when passed then '80_tb_passed' when not passed then '60_tb_failed'
           else 'exception' end as retry_exit_stage
    from r""",
)
def exit_stage_cycle(spark, sf_dir):
    gates = ("code", "compile_code", "compile_late", "execute_code", "execute_late", "passed")
    return _results(spark, sf_dir).select(
        "doc_id",
        outcomes.cycle_stage(*gates).alias("exit_stage"),
        outcomes.cycle_stage(*gates, separate_timeouts=False).alias("retry_exit_stage"),
    )


def _ora_words(running: str, hint: str) -> str:
    return f"""case when code is null then 'extracting the code'
      when compile_code is distinct from 0 then 'compiling the code'
      when execute_late then {quoted(running + hint)}
      when execute_code is distinct from 0 then {quoted(running)}
      when not passed then 'passing the testbench' end"""


_DEBUGGER_WORDS = _ora_words(
    "running the simulation",
    " (simulation timed out; check for self-referential combinatorial assignments)",
)
_RETRY_WORDS = _ora_words("running the code/simulation", " (simulation timed out)")


@query(
    "cls_failure_stage",
    f"{_RESULTS} select doc_id, {_DEBUGGER_WORDS} as debugger_words, {_RETRY_WORDS} as retry_words "
    "from r",
)
def failure_stage(spark, sf_dir):
    has_code = F.col("code").isNotNull()
    gates = ("compile_code", "execute_code", "execute_late", "passed")
    return _results(spark, sf_dir).select(
        "doc_id",
        *[
            outcomes.failure_words(has_code, *gates, wording, strict=False).alias(f"{wording}_words")
            for wording in ("debugger", "retry")
        ],
    )


_VERDICT = """case when lower(response) like '%bug found%' and lower(response) like '%bug not found%'
  then 'UNKNOWN' when lower(response) like '%bug not found%' then 'BUG NOT FOUND'
  when lower(response) like '%bug found%' then 'BUG FOUND' else 'UNKNOWN' end"""


@query(
    "cls_bug_verdict",
    f"with {src.attempts_sql('doc_id', 'response')} "
    f"select doc_id, {_VERDICT} as bug_found_status from attempts",
)
def bug_verdict(spark, sf_dir):
    return src.attempts(spark, sf_dir).select(
        "doc_id", outcomes.bug_verdict("response").alias("bug_found_status")
    )


@query(
    "cls_tool_status",
    f"""with {src.attempts_sql('doc_id', 'compile_code', 'execute_code')}
    select doc_id, case when compile_code is distinct from 0 then 'compile_error'
      when execute_code is distinct from 0 then 'execute_error' else 'success' end as status
    from attempts""",
)
def tool_status(spark, sf_dir):
    return src.attempts(spark, sf_dir).select(
        "doc_id", outcomes.tool_status("compile_code", "execute_code").alias("status")
    )


# -- prompts ---------------------------------------------------------------------------------

_TEMPLATE = (
    "'Template module:' || chr(10) || coalesce(header, 'None') || chr(10) || "
    "'// Your solution here'"
)
_P = "chr(10) || chr(10)"


@query(
    "pmt_single_shot",
    f"""with {src.attempts_sql('doc_id', 'text', 'header')}
    select doc_id, {quoted(prompts.SINGLE_SHOT)} || text || {_P} || {_TEMPLATE} as prompt
    from attempts""",
)
def single_shot(spark, sf_dir):
    return src.attempts(spark, sf_dir).select(
        "doc_id", prompts.single_shot_prompt("text", "header").alias("prompt")
    )


@query(
    "pmt_bug_scan",
    f"""with {src.FILES_SQL}
    select file_name, {quoted(prompts.SECURITY_REVIEW)} || {ora.numbered('contents')} as prompt
    from files""",
)
def bug_scan(spark, sf_dir):
    return src.source_files(spark, sf_dir).select(
        "file_name", prompts.bug_scan_prompt("contents").alias("prompt")
    )


_INITIAL = quoted("\n".join([*prompts.INITIAL_LINES, prompts.REQUIREMENTS]))
_INITIAL_RETRY = quoted(
    "\n".join([prompts.RETRY_OPENING, *prompts.INITIAL_LINES, prompts.REQUIREMENTS + " "])
)


@query(
    "pmt_initial",
    f"""with {src.attempts_sql('doc_id', 'text', 'header')},
    p as (
      select doc_id, 'designer_agent' as agent_name, 'user' as role, 'debugger' as loop,
             {_INITIAL} || chr(10) || text || chr(10) || {_P} || {_TEMPLATE} as prompt from attempts
      union all
      select doc_id, 'designer_agent', 'user', 'retry',
             {_INITIAL_RETRY} || chr(10) || text || chr(10) || {_P} || {_TEMPLATE} from attempts
      union all
      select doc_id, 'designer_agent', 'system', 'debugger', {quoted(prompts.DESIGNER_SYSTEM)}
      from attempts
      union all
      select doc_id, 'debugger_agent', 'system', 'debugger', {quoted(prompts.DEBUGGER_SYSTEM)}
      from attempts)
    select * from p""",
)
def initial(spark, sf_dir):
    """The opening messages of every experiment, one exploded row each."""

    def opening(agent, role, loop, prompt):
        return F.struct(
            F.lit(agent).alias("agent_name"),
            F.lit(role).alias("role"),
            F.lit(loop).alias("loop"),
            prompt.alias("prompt"),
        )

    rows = F.array(
        opening("designer_agent", "user", "debugger", prompts.initial_prompt("text", "header")),
        opening("designer_agent", "user", "retry", prompts.initial_prompt("text", "header", "retry")),
        opening("designer_agent", "system", "debugger", F.lit(prompts.DESIGNER_SYSTEM)),
        opening("debugger_agent", "system", "debugger", F.lit(prompts.DEBUGGER_SYSTEM)),
    )
    return src.attempts(spark, sf_dir).select("doc_id", F.inline(rows))


# Summaries of the steps that ran: none without code, no execution after a failed compilation.
_STEPS = f"""{_RESULTS}, s as (select *,
  case when code is not null then {ora.summary('compile_code', 'compile_late', "''", 'stderr')} end
    as compile_text,
  case when code is not null and compile_code = 0 then
    {ora.summary('execute_code', 'execute_late', 'stdout', "''")} end as execute_text from r),
f as (select *, {_DEBUGGER_WORDS} as dw, {_RETRY_WORDS} as rw from s)"""


def _with_outputs(spark, sf_dir):
    """All attempts with the summaries of their steps, and whether they failed.

    There is no filter on the outcome: it would be pushed below the projection that computes it,
    and every text would be searched twice.
    """
    empty = F.lit("")
    has_code = F.col("code").isNotNull()
    gates = ("compile_code", "execute_code", "execute_late", "passed")
    compiled = toolout.command_summary("compile_code", "compile_late", empty, "stderr")
    executed = toolout.command_summary("execute_code", "execute_late", "stdout", empty)
    has_failed = outcomes.failure_words(has_code, *gates, strict=False).isNotNull()
    return (
        _results(spark, sf_dir)
        .withColumn("has_failed", has_failed)
        .withColumn("compile_text", F.when(has_code, compiled))
        .withColumn("execute_text", F.when(has_code & (F.col("compile_code") == 0), executed))
    )


_TOOL_INTRO = quoted(prompts.TOOL_OUTPUT_INTRO)


def _ora_tools(passed: str) -> str:
    return f"""'Compile result:' || chr(10) || compile_text,
      'Execute result:' || chr(10) || execute_text,
      case when not {passed} then {quoted(prompts.TESTBENCH_FAILED)} end"""


@query(
    "pmt_retry",
    f"""{_STEPS}
    select doc_id, case when rw is not null then {ora.join_parts(
        chr(10) * 2, "'Your solution is not quite right.'",
        "'It failed at this step: ' || rw || '.'",
        "case when code is null then 'Please make sure to follow the requested top-level module "
        f"template in your response.' else {_TOOL_INTRO} end",
        _ora_tools("(case when execute_text is null or execute_code is distinct from 0 "
                   "then null else passed end)"),
        "'Please try to solve the problem again: '", "text", _TEMPLATE)} end as prompt
    from f""",
)
def retry(spark, sf_dir):
    """The prompt after each attempt, null where it passed or left no verdict.

    The testbench verdict is only known after a clean run.
    """
    known = F.when(
        F.col("execute_text").isNotNull() & (F.col("execute_code") == 0), F.col("passed")
    )
    return _with_outputs(spark, sf_dir).select(
        "doc_id",
        prompts.retry_prompt(
            "text",
            "header",
            F.col("code").isNotNull(),
            "compile_code",
            "compile_text",
            "execute_code",
            "execute_late",
            "execute_text",
            known,
            strict=False,
        ).alias("prompt"),
    )


_VARIANTS = "variants(name, repeat_last_attempt, numbers, phrasing, location, wrap) as (values {})".format(
    ", ".join(
        f"('{v[0]}', {v[2]}, {v[3]}, '{v[4]}', '{v[5]}', {v[6]})" for v in AGENT_VARIANT_ROWS
    )
)
_SHOWN = f"case when numbers then {ora.numbered('code', 3)} else code end"


@query(
    "pmt_debugger",
    f"""{_STEPS}, {_VARIANTS}, g as (select *, {_SHOWN} as shown,
      case phrasing when 'basic' then {quoted(prompts.FEEDBACK_REQUEST['basic'])}
                    else {quoted(prompts.FEEDBACK_REQUEST['be_specific'])} end as request
      from f cross join variants)
    select doc_id, name, case when rw is not null then {ora.join_parts(
        chr(10) * 2,
        "'Your coworker, the Designer Employee, has attempted to solve the following problem: '",
        "text", "'The solution your coworker came up with is not quite right.'",
        "case when location = 'top' then request end",
        "case when code is not null then 'The designer proposed the following solution:' end",
        "case when wrap then repeat(chr(96), 3) || 'verilog' || chr(10) || shown || chr(10) || "
        "repeat(chr(96), 3) else shown end",
        "'When testing the solution, it failed at this step: ' || dw || '.'",
        "case when code is null then 'It is important to follow the requested top-level module "
        f"template.' else {_TOOL_INTRO} end",
        _ora_tools("false"), "case when location = 'bottom' then request end")} end as prompt
    from g""",
)
def debugger(spark, sf_dir):
    """All variants of the prompt for each attempt, null where it did not fail.

    This loop hands over "not passed" at every failure, so the prompt says so each time.
    """
    grid = joins.with_each(_with_outputs(spark, sf_dir), AGENT_VARIANT_ROWS, AGENT_VARIANTS)
    shown = grid.withColumn("shown", prompts.code_for_prompt("code", "add_line_number_prefixes"))
    prompt = prompts.debugger_prompt(
        "text",
        "shown",
        "compile_code",
        "compile_text",
        "execute_code",
        "execute_late",
        "execute_text",
        F.lit(False),
        "phrasing",
        "instruction_location",
        "wrap_in_md",
    )
    return shown.select("doc_id", "name", F.when(F.col("has_failed"), prompt).alias("prompt"))


@query(
    "pmt_designer",
    f"""{_RESULTS}, {_VARIANTS}, g as (select *, {_SHOWN} as shown from r cross join variants)
    select doc_id, name, {ora.join_parts(
        chr(10) * 2, "'You have attempted to solve the following problem: '", "text",
        "'The solution you came up with is not quite right.'",
        "case when repeat_last_attempt and code is not null then "
        "'Recall, your previous solution was:' end",
        "case when repeat_last_attempt then shown end",
        "'The Debugger Employee has provided the following feedback:'", "stderr",
        "'Please attempt to solve the problem correctly.'")} as prompt
    from g""",
)
def designer(spark, sf_dir):
    grid = joins.with_each(_results(spark, sf_dir), AGENT_VARIANT_ROWS, AGENT_VARIANTS)
    shown = grid.withColumn("shown", prompts.code_for_prompt("code", "add_line_number_prefixes"))
    return shown.select(
        "doc_id",
        "name",
        prompts.designer_prompt("text", "stderr", "shown", "repeat_last_attempt").alias("prompt"),
    )


# -- responders ------------------------------------------------------------------------------

PROMPT = f"""case doc_id % 5
  when 0 then concat('Write me ', {src.ID}, ' sentences ending with the word ''apple''. ', text)
  when 1 then concat('Write me a list of numbers from 1 to ', {src.ID}, ' as JSON.')
  when 2 then concat(text, ' Write me 10 sentences ending with apple')
  when 3 then concat('Write', {src.NL}, 'a list of numbers from 1 to 10') else text end"""
_MOCK = f"""case
  when regexp_matches(prompt, '^Write.*(\\d+)\\s*sentences.*ending.*apple')
    then {quoted(msg.APPLE_ANSWER)}
  when regexp_matches(prompt, '^Write.*list.*numbers.*(\\d+).*') then {quoted(msg.NUMBERS_ANSWER)}
  else {quoted(msg.ECHO_PREFIX)} || prompt end"""
_PROMPTS = f"with p as (select doc_id, {PROMPT} as prompt from documents)"


def _prompts(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PROMPT} as prompt")


@query("udf_mock_responder", f"{_PROMPTS} select doc_id, {_MOCK} as response from p")
def mock_responder(spark, sf_dir):
    return _prompts(spark, sf_dir).select("doc_id", msg.mock_answer("prompt").alias("response"))


@query(
    "udf_batch_score",
    f"""{_PROMPTS} select doc_id,
      case when prompt like 'Write%' then {_MOCK} end as response,
      case when prompt not like 'Write%' then 'cannot answer ' || length(prompt) end as error
    from p""",
)
def batch_score(spark, sf_dir):
    """The offline rules as a Python responder that refuses prompts without an order."""
    return scoring.score_prompts(_prompts(spark, sf_dir), _offline_responder()).drop("prompt")


def _offline_responder():
    import re

    rules = [
        (msg.APPLE_RULE, msg.APPLE_ANSWER),
        (msg.NUMBERS_RULE, msg.NUMBERS_ANSWER),
    ]
    echo = msg.ECHO_PREFIX

    def answer(prompt):
        if not prompt.startswith("Write"):
            raise ValueError(f"cannot answer {len(prompt)}")
        return next((answer for rule, answer in rules if re.match(rule, prompt)), echo + prompt)

    def respond(prompts, _histories):
        return [answer(p) for p in prompts]

    return respond


@query(
    "udf_batch_score_resumed",
    f"""{_PROMPTS} select doc_id,
      case when prompt like 'Write%' then {_MOCK} end as response,
      case when prompt not like 'Write%' then 'cannot answer ' || length(prompt) end as error
    from p""",
)
def batch_score_resumed(spark, sf_dir):
    """The same answers from a log that a first run over other prompts has begun."""
    prompts, log = _prompts(spark, sf_dir), fresh_path(spark, "answers")
    begun = prompts.where("prompt like 'Write%'")
    scoring.score_resumably(begun, _offline_responder(), log)
    return scoring.score_resumably(prompts, _offline_responder(), log, rounds=2).drop("prompt")
