"""Queries over the whole experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.prompts import SECURITY_REVIEW
from evalspark.plans import experiments
from evalspark.plans import inputs as src
from evalspark.plans import oracle_text as ora
from evalspark.plans.inputs import quoted
from evalspark.plans.registry import query

# Attempts are documents; four neighbouring ones are the cycles of one experiment.
_DIMENSIONS = {
    "experiment_execution_uuid": "concat('x', {id})",
    "llm_provider_name": "concat('prov', {mod2})",
    "configured_llm_name": "concat('m', {mod3})",
}


def _dimensions(key: str) -> dict[str, str]:
    parts = {
        "id": src.text_of(key),
        "mod2": src.text_of(f"({key}) % 2"),
        "mod3": src.text_of(f"({key}) % 3"),
    }
    return {name: sql.format(**parts) for name, sql in _DIMENSIONS.items()}


ONE = _dimensions("doc_id")
LOOP = _dimensions("doc_id - doc_id % 4")


def _attempts(spark, sf_dir, dimensions, cycle, **more):
    rows = src.table(spark, sf_dir, "documents")
    return rows.selectExpr(
        *[f"{sql} as {name}" for name, sql in dimensions.items()],
        f"{cycle} as cycle_num",
        "text as problem_description",
        f"{src.RESPONSE} as llm_response",
        *[f"{sql} as {name}" for name, sql in more.items()],
    )


def _results(spark, sf_dir, dimensions, cycle):
    """Compile and execute results of every attempt, whether or not it got that far."""
    rows = src.table(spark, sf_dir, "documents").selectExpr(
        f"{dimensions['experiment_execution_uuid']} as experiment_execution_uuid",
        f"{cycle} as cycle_num",
        *[
            f"{src.ATTEMPT[c]} as {c}"
            for c in ("stdout", "stderr", "compile_code", "execute_code")
        ],
    )

    def step(name, code, out, err):
        return F.struct(
            F.lit(name).alias("step"),
            F.col(code).alias("return_code"),
            out.alias("stdout"),
            err.alias("stderr"),
        )

    steps = F.array(
        step("compile", "compile_code", F.lit(""), F.col("stderr")),
        step("execute", "execute_code", F.col("stdout"), F.lit("")),
    )
    return rows.select("experiment_execution_uuid", "cycle_num", F.inline(steps))


def _gated(dimensions: dict[str, str], cycle: str, code: str) -> str:
    """Attempts with the results of the steps that ran."""
    names = ", ".join(f"{sql} as {name}" for name, sql in dimensions.items())
    picked = ", ".join(
        f"{src.ATTEMPT[c]} as {c}"
        for c in ("text", "response", "stdout", "stderr", "compile_code", "execute_code",
                  "compile_late", "execute_late")
    )
    return f"""a as (select {names}, {cycle} as cycle_num, doc_id, {picked} from documents),
    c as (select *, {code} as code from a),
    g as (select *, code is not null as ran1,
                 code is not null and compile_code is not distinct from 0 as ran2,
                 code is not null and compile_code is not distinct from 0
                   and execute_code is not distinct from 0 as ran3 from c),
    t as (select *, case when ran3 then {ora.mismatch('stdout', 1)} end as mm,
                 case when ran3 then {ora.mismatch('stdout', 2)} end as mn from g)"""


_RESULT_COLUMNS = """
  case when ran1 then compile_code end as compile_result_return_code,
  case when ran1 then '' end as compile_result_stdout,
  case when ran1 then stderr end as compile_result_stderr,
  case when ran1 then compile_code is not distinct from 0 end as was_compile_success,
  case when ran2 then execute_code end as execute_result_return_code,
  case when ran2 then stdout end as execute_result_stdout,
  case when ran2 then '' end as execute_result_stderr,
  case when ran2 then execute_code is not distinct from 0 end as was_execute_success,
  mm = 0 as was_testbench_passed,
  '{"mismatch_sample_count":' || mm || ',"total_sample_count":' || mn || '}' as testbench_stats"""

_ONE_STAGE = """case when not ran1 then 'code_extraction_error'
  when not ran2 then 'iverilog_compile_error' when not ran3 then 'iverilog_execute_error'
  when mm = 0 then 'tb_pass' when mm > 0 then 'tb_fail' else 'tb_stats_not_found' end"""


@query(
    "exp_single_shot",
    f"""with {_gated(ONE, '0', ora.code('response'))}
    select {', '.join(ONE)}, text as problem_description, response as llm_response,
           code as extracted_generated_code, {_RESULT_COLUMNS}, {_ONE_STAGE} as exit_stage from t""",
)
def single_shot(spark, sf_dir):
    attempts = _attempts(spark, sf_dir, ONE, "0").drop("cycle_num")
    return experiments.single_shot(attempts, _results(spark, sf_dir, ONE, "0"))


SOLUTION = f"""case when doc_id % 7 = 0 then null when doc_id % 4 = 0 then concat(text, text)
  when doc_id % 4 = 1 then concat('module top(); ', text, ' endmodule', chr(10))
  else concat('module top(); ', text, ' endmodule', repeat(' tail', 200)) end"""
TESTBENCH = "case when doc_id % 11 = 3 then null else concat('tb ', text) end"


@query(
    "exp_validate_testbenches",
    f"""with p as (select doc_id, {SOLUTION} as solution, {TESTBENCH} as testbench,
                         {src.STDOUT} as stdout, {src.STDERR} as stderr,
                         {src.COMPILE_CODE} as compile_code, {src.EXECUTE_CODE} as execute_code
                  from documents),
    x as (select *, {ora.code('solution')} as extracted from p
          where solution is not null and testbench is not null),
    e as (select *, case
            when coalesce(extracted, '') = ''
              then {quoted("No module can be found in the known solution.")}
            when length(extracted) <= 0.75 * length(solution) then 'Extracted code is too short.'
            end as error from x),
    g as (select *, error is null as ran1, error is null and compile_code is not distinct from 0 as ran2,
                 error is null and compile_code is not distinct from 0
                   and execute_code is not distinct from 0 as ran3 from e),
    t as (select *, case when ran3 then {ora.mismatch('stdout', 1)} end as mm,
                 case when ran3 then {ora.mismatch('stdout', 2)} end as mn from g)
    select concat('x', doc_id) as experiment_execution_uuid, error, {_RESULT_COLUMNS},
           case when error is not null then 'exception' else
             case when not ran2 then 'iverilog_compile_error'
                  when not ran3 then 'iverilog_execute_error' when mm = 0 then 'tb_pass'
                  when mm > 0 then 'tb_fail' else 'tb_stats_not_found' end end as exit_stage
    from t""",
)
def validate_testbenches(spark, sf_dir):
    problems = src.table(spark, sf_dir, "documents").selectExpr(
        f"{ONE['experiment_execution_uuid']} as experiment_execution_uuid",
        f"{SOLUTION} as canonical_solution",
        f"{TESTBENCH} as testbench_code",
    )
    checked = experiments.validate_testbenches(problems, _results(spark, sf_dir, ONE, "0"))
    return checked.drop("solution_code", "canonical_solution", "testbench_code")


# Four cycles each, of which the variant allowed three or four.
_ALLOWED = "3 + (doc_id - doc_id % 4) % 8 / 4"
_LOOP_STAGES = f"""s as (select *, case when not ran1 then '20_code_extraction_error'
            when compile_late then '25_iverilog_compile_timeout'
            when not ran2 then '30_iverilog_compile_error'
            when execute_late then '35_iverilog_execute_timeout'
            when not ran3 then '40_iverilog_execute_error'
            when mm = 0 then '80_tb_passed' when mm > 0 then '60_tb_failed' else 'exception' end
            as exit_stage
          from t),
    k as (select *, coalesce(max(case when {src.ENDS_SQL} then 1 else 0 end) over (
            partition by experiment_execution_uuid order by cycle_num
            rows between unbounded preceding and 1 preceding), 0) as pb from s)"""


@query(
    "exp_cycle_loop",
    f"""with {_gated(LOOP, 'doc_id % 4', ora.code('response'))},
    {_LOOP_STAGES},
    e as (select {', '.join(LOOP)}, max(cycle_num) + 1 as used,
                 cast(min({_ALLOWED}) as bigint) as allowed,
                 arg_max(exit_stage, cycle_num) as latest_exit_stage
          from k where pb = 0 group by all)
    select experiment_execution_uuid, latest_exit_stage,
           latest_exit_stage = '80_tb_passed' as was_testbench_passed,
           case when latest_exit_stage <> 'exception' then llm_provider_name end
             as llm_provider_name,
           case when latest_exit_stage <> 'exception' then configured_llm_name end
             as configured_llm_name,
           case when latest_exit_stage <> 'exception' then used end as used_cycle_count,
           case when latest_exit_stage <> 'exception' then allowed end as max_cycle_count,
           case when latest_exit_stage <> 'exception' then used > allowed end as is_beyond_limit
    from e""",
)
def cycle_loop(spark, sf_dir):
    cycle = "doc_id % 4"
    attempts = _attempts(spark, sf_dir, LOOP, cycle, allowed=f"cast({_ALLOWED} as bigint)")
    staged = experiments.classified_cycles(attempts, _results(spark, sf_dir, LOOP, cycle))
    return experiments.cycle_experiments(staged, list(LOOP), limit="allowed")


@query(
    "exp_cycle_log",
    f"""with {_gated(LOOP, 'doc_id % 4', ora.code('response'))}, {_LOOP_STAGES}
    select {', '.join(LOOP)}, cycle_num, text as problem_description, response as llm_response,
           code as extracted_generated_code, {_RESULT_COLUMNS}, exit_stage from k where pb = 0""",
)
def cycle_log(spark, sf_dir):
    cycle = "doc_id % 4"
    return experiments.cycle_log(
        _attempts(spark, sf_dir, LOOP, cycle), _results(spark, sf_dir, LOOP, cycle)
    )


_SCAN_ANSWER = """case page_id % 5 when 0 then null when 1 then 'There is a Bug Found here'
  when 2 then 'bug not found' when 3 then 'BUG FOUND / BUG NOT FOUND' else 'nothing' end"""
_PATH = f"concat('/src/p', {src.text_of('page_id')}, case page_id % 2 when 0 then '.v' else '.sv' end)"


@query(
    "exp_bug_scan",
    f"""with f as (select page_id, {_PATH} as target_file_path,
                      {src.FILE['file_name']} as target_file_name,
                      {ora.numbered('html')} as numbered, {_SCAN_ANSWER} as answer from pages),
    m(configured_llm_name, i) as (values ('m0', 0), ('m1', 1), ('m2', 2)),
    g as (select target_file_path, target_file_name, numbered, configured_llm_name,
                 case when (page_id + i) % 3 < 2 then answer end as llm_response
          from f cross join m
          union all
          select target_file_path, target_file_name, numbered, 'unlisted', answer
          from f where page_id % 7 = 0
          union all
          select concat('/gone', target_file_path), null, null, 'm1', answer
          from f where page_id % 11 = 0)
    select target_file_path, target_file_name, length(numbered) as numbered_length, llm_response,
           configured_llm_name,
           case when llm_response is null then 'exception'
                when llm_response = 'There is a Bug Found here' then 'BUG FOUND'
                when llm_response = 'bug not found' then 'BUG NOT FOUND' else 'UNKNOWN' end
             as bug_found_status
    from g""",
)
def bug_scan(spark, sf_dir):
    """Every file with three models, of which each left out a third; more models and files answered."""
    pages = src.table(spark, sf_dir, "pages")
    files = pages.selectExpr(
        f"{_PATH} as file_path", f"{src.FILE['file_name']} as file_name", "html as contents"
    )
    model = "concat('m', cast(i as string))"
    answered = pages.selectExpr(
        "page_id", f"{_PATH} as path", f"{_SCAN_ANSWER} as llm_response", "explode(array(0, 1, 2, 3, 4)) as i"
    )
    responses = answered.selectExpr(
        "case when i = 4 then concat('/gone', path) else path end as target_file_path",
        f"case i when 3 then 'unlisted' when 4 then 'm1' else {model} end as configured_llm_name",
        "llm_response",
        "case i when 3 then page_id % 7 = 0 when 4 then page_id % 11 = 0"
        " else (page_id + i) % 3 < 2 end as answers",
    ).where("answers").drop("answers")
    scanned = experiments.bug_scan(files, responses, ["m0", "m1", "m2"])
    length = F.length("llm_prompt") - F.lit(len(SECURITY_REVIEW))
    return scanned.withColumn("numbered_length", length.cast("bigint")).drop("llm_prompt")
