"""Queries over projections, checks, joins, summaries and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import extract
from evalspark.functions.outcomes import bug_verdict
from evalspark.operators import chains, checks, history, joins, projections, summary
from evalspark.plans import inputs as src
from evalspark.plans import oracle_text as ora
from evalspark.plans.inputs import big, quoted
from evalspark.plans.registry import query
from evalspark.schemas import AGENT_VARIANT_ROWS, AGENT_VARIANTS, CYCLE_STAGES, MODEL_CONFIGS
from evalspark.session import fresh_path
from evalspark.sources import readers
from evalspark.sources.checked import write_checked

# -- projections -----------------------------------------------------------------------------


@query(
    "prj_keep_keys",
    f"with {src.EXPERIMENTS_SQL} "
    "select experiment_execution_uuid, latest_exit_stage, was_testbench_passed from experiments",
)
def keep_keys(spark, sf_dir):
    return projections.keep_columns(
        src.experiments(spark, sf_dir),
        ["was_testbench_passed", "latest_exit_stage", "experiment_execution_uuid", "no_such_key"],
    )


@query(
    "prj_flatten",
    r"""select event_id, event_type as event_type, value as event_value,
        try_cast(regexp_extract(props, '"k": (\d+)', 1) as bigint) as event_props_k,
        concat_ws(', ', event_type, cast(user_id as varchar)) as tags from events""",
)
def flatten(spark, sf_dir):
    nested = src.table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(
            F.col("event_type").alias("type"),
            "value",
            F.from_json("props", "k bigint").alias("props"),
        ).alias("event"),
        F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
    )
    return projections.flatten(nested, sep="_")


SOLUTION = (
    "case when doc_id % 7 = 0 then null else concat(chr(10), '  ', text, chr(9), chr(10)) end"
)
BENCH = (
    "case when doc_id % 4 = 0 then null "
    "else concat('$dumpfile(\"wave_', lang, '.vcd\");', text) end"
)


def _problem_sides(spark, sf_dir):
    documents = src.table(spark, sf_dir, "documents")
    described = documents.selectExpr(f"{src.ID} as task_id", "text as detail_description")
    solved = documents.selectExpr(
        f"{src.ID} as task_id",
        f"concat(' module top', {src.ID}, '(input a);', chr(10)) as prompt",
        f"coalesce({SOLUTION}, 'none') as canonical_solution",
        f"coalesce({BENCH}, 'none') as test",
    )
    return described, solved


_MARKER = quoted(projections.BREAK_MARKER)
_PROBLEMS = f"""with sides as (
  select {src.ID} as task_id, text, concat(' module top', {src.ID}, '(input a);', chr(10)) as prompt,
         coalesce({SOLUTION}, 'none') as canonical_solution, coalesce({BENCH}, 'none') as test
  from documents)"""


@query(
    "prj_problem_build",
    f"""{_PROBLEMS}
    select 've_' || task_id as problem_id, text as problem_description, prompt as module_header,
           test as testbench_code,
           {ora.trim('prompt')} || {_MARKER} || {ora.trim('canonical_solution')} || chr(10)
             as canonical_solution, 'systemverilog' as code_language from sides""",
)
def problem_build(spark, sf_dir):
    return readers.problems_from(*_problem_sides(spark, sf_dir)).drop("other_data")


_OPTIONAL = (
    f"p as (select doc_id, {SOLUTION} as canonical_solution, {BENCH} as testbench_code "
    "from documents)"
)


def _optional_problems(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{SOLUTION} as canonical_solution", f"{BENCH} as testbench_code"
    )


@query(
    "prj_data_flags",
    f"""with {_OPTIONAL}, f as (select doc_id, concat_ws(', ',
          case when canonical_solution is not null then 'has_canonical_solution' end,
          case when testbench_code is not null then 'has_testbench_code' end) as flags from p)
    select doc_id, flags, 'SimpleCodeGenProblem(ve_' || doc_id
           || case when flags = '' then '' else ', ' || flags end || ')' as label from f""",
)
def data_flags(spark, sf_dir):
    flags = projections.data_flags("canonical_solution", "testbench_code")
    problem_id = F.concat(F.lit("ve_"), F.col("doc_id").cast("string"))
    return _optional_problems(spark, sf_dir).select(
        "doc_id",
        F.array_join(flags, ", ").alias("flags"),
        projections.problem_label(problem_id, flags).alias("label"),
    )


@query(
    "prj_qualify_vcd_paths",
    f"""with {_OPTIONAL} select doc_id, regexp_replace(testbench_code, '"(\\w+\\.vcd)"',
        '"/work/$run/c_' || (doc_id % 100) || '/\\1"', 'g') as testbench_code from p""",
)
def qualify_vcd_paths(spark, sf_dir):
    folder = F.concat(F.lit("/work/$run/c_"), (F.col("doc_id") % 100).cast("string"))
    return _optional_problems(spark, sf_dir).select(
        "doc_id",
        projections.qualify_vcd_paths("testbench_code", folder).alias("testbench_code"),
    )


@query(
    "prj_metadata_strip",
    f"""select doc_id, '{{"model":' || {ora.js('source')} || ',"done":true,"eval_count":' || n_chars
        || ',"note":' || case when doc_id % 2 = 0 then 'null' else {ora.js('lang')} end || '}}'
        as metadata, text as body from documents""",
)
def metadata_strip(spark, sf_dir):
    full = src.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct(
            F.col("source").alias("model"),
            F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias(
                "message"
            ),
            F.lit(True).alias("done"),
            F.col("n_chars").alias("eval_count"),
            F.when(F.col("doc_id") % 2 != 0, F.col("lang")).alias("note"),
        ).alias("response"),
    )
    return full.select(
        "doc_id",
        projections.metadata_json("response", "message").alias("metadata"),
        F.col("response.message.content").alias("body"),
    )


@query(
    "prj_config_options",
    f"""select event_id, concat_ws(', ',
      case when event_type <> 'view' then 'num_ctx=' || event_id end,
      case when user_id % 2 = 0 then 'seed=' || user_id
           when event_type <> 'view' then 'seed=free' end,
      case when user_id % 3 = 0 then 'temperature=0.5' end) as options from events""",
)
def config_options(spark, sf_dir):
    free = F.when(
        F.col("event_type") != "view",
        F.create_map(
            F.lit("num_ctx"), F.col("event_id").cast("string"), F.lit("seed"), F.lit("free")
        ),
    )
    seed = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("int"))
    temperature = F.when(F.col("user_id") % 3 == 0, F.lit(0.5))
    options = projections.config_options(free, seed, temperature)
    shown = F.transform(
        F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return src.table(spark, sf_dir, "events").select(
        "event_id", F.array_join(shown, ", ").alias("options")
    )


@query(
    "flt_has_solution_and_tb",
    f"""with {_OPTIONAL} select doc_id, length(canonical_solution) as solution_length from p
    where canonical_solution is not null and testbench_code is not null""",
)
def has_solution_and_tb(spark, sf_dir):
    return projections.has_solution_and_testbench(_optional_problems(spark, sf_dir)).select(
        "doc_id", big(F.length("canonical_solution")).alias("solution_length")
    )


NAME = f"concat(event_type, '-', {src.text_of('event_id % 4000')})"


@query(
    "flt_named_one",
    f"""with n as (select {NAME} as name, event_id, value from events),
    c as (select *, count(*) over (partition by name) as row_count from n)
    select name, row_count, case when row_count = 1 then event_id end as event_id,
           case when row_count = 1 then value end as value
    from c qualify row_number() over (partition by name order by event_id) = 1""",
)
def named_one(spark, sf_dir):
    """Every name looked up: its row where it stands for exactly one, and how many it stands for."""
    rows = src.table(spark, sf_dir, "events").selectExpr(f"{NAME} as name", "event_id", "value")
    report = checks.name_report(rows)
    found = rows.join(report.where("ok").select("name"), "name")
    return report.select("name", "row_count").join(found, "name", "left")


@query(
    "asr_columns",
    "select lang, count(*) as row_count, 5 as column_count from documents group by lang",
)
def asr_columns(spark, sf_dir):
    documents = checks.assert_columns(
        src.table(spark, sf_dir, "documents"), {"doc_id", "text", "lang", "source", "n_chars"}
    )
    return documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(documents.columns)).alias("column_count")
    )


@query(
    "asr_row_parity",
    """select (select count(*) from documents) as left_count,
              (select count(*) from labels) as right_count,
              (select count(*) from documents) = (select count(*) from labels) as ok""",
)
def row_parity(spark, sf_dir):
    return checks.row_parity(
        src.table(spark, sf_dir, "documents"), src.table(spark, sf_dir, "labels")
    )


@query(
    "asr_extract_ratio",
    f"""with {src.attempts_sql('doc_id', 'response')},
    c as (select doc_id, response, {ora.code('response')} as code from attempts)
    select doc_id, coalesce(code <> '' and length(code) > 0.75 * length(response), false) as ok
    from c""",
)
def extract_ratio(spark, sf_dir):
    return src.attempts(spark, sf_dir).select(
        "doc_id",
        checks.extraction_ok(extract.extract_code("response"), F.col("response")).alias("ok"),
    )


@query(
    "asr_checked_write",
    f"""with {src.attempts_sql('doc_id', 'response')},
    c as (select doc_id, length(response) as size, {ora.code('response')} as code from attempts),
    f as (select *, coalesce(code <> '' and length(code) > 0.75 * size, false) as ok,
                 coalesce(code <> '', false) as has_code from c)
    select 'rows' as rule, count(*) as row_count, 0::bigint as failed_count, null::varchar as first_failed
    from f
    union all select 'written', count(*) filter (has_code), 0, null from f
    union all select 'has_code', count(*), count(*) filter (not has_code),
                     cast(min(doc_id) filter (not has_code) as varchar) from f
    union all select 'extraction', count(*) filter (has_code), count(*) filter (has_code and not ok),
                     cast(min(doc_id) filter (has_code and not ok) as varchar) from f""",
)
def checked_write(spark, sf_dir):
    """Answers with code written out; what the checks found was counted by the same job."""
    answers = src.attempts(spark, sf_dir).select(
        "doc_id",
        F.length("response").alias("size"),
        extract.extract_code("response").alias("code"),
    )
    long_enough = F.length("code") > F.lit(0.75) * F.col("size")
    return write_checked(
        answers,
        fresh_path(spark, "checked"),
        {"extraction": (F.col("code") != "") & long_enough},
        "doc_id",
        keep={"has_code": F.col("code") != ""},
        columns=["doc_id", "size", "code"],
    )


# -- joins and unions ------------------------------------------------------------------------


@query(
    "join_inner_1to1",
    """select d.doc_id, d.text, l.quality, l.toxic from documents d join labels l using (doc_id)""",
)
def inner_1to1(spark, sf_dir):
    return joins.join_one_to_one(
        src.table(spark, sf_dir, "documents").select("doc_id", "text"),
        src.table(spark, sf_dir, "labels"),
        "doc_id",
    )


CONFIGURED_MODELS = [
    {"llm_class": provider, "configured_llm_name": f"{provider}-{size}b", "model_name": f"own:{size}b"}
    for provider in ("OllamaLlm", "ChatGptLlm")
    for size in (1, 3, 8)
] + [{"llm_class": "MockLlm", "configured_llm_name": "offline", "is_stable": True}]
_MODELS = "models(provider, model, tag) as (values {})".format(
    ", ".join(
        "('{}', '{}', {})".format(
            m["llm_class"],
            m["configured_llm_name"],
            quoted(m["model_name"]) if "model_name" in m else "null",
        )
        for m in CONFIGURED_MODELS
    )
)
_VARIANT_NAMES = "variants(name, phrasing) as (values {})".format(
    ", ".join(f"('{v[0]}', '{v[4]}')" for v in AGENT_VARIANT_ROWS)
)


@query(
    "join_cross_models",
    f"""with {_MODELS} select doc_id, provider as llm_class, model as configured_llm_name,
        tag as model_name, n_chars from documents cross join models""",
)
def cross_models(spark, sf_dir):
    problems = src.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return joins.with_each(problems, CONFIGURED_MODELS, MODEL_CONFIGS).select(
        "doc_id", "llm_class", "configured_llm_name", "model_name", "n_chars"
    )


@query(
    "join_cross_variants",
    f"""with {_MODELS}, {_VARIANT_NAMES}
    select doc_id, model as configured_llm_name, name from documents cross join models
    cross join variants where phrasing = 'be_specific'""",
)
def cross_variants(spark, sf_dir):
    problems = src.table(spark, sf_dir, "documents").select("doc_id")
    grid = joins.with_each(problems, CONFIGURED_MODELS, MODEL_CONFIGS)
    # the variants that are asked for are picked before they multiply the rows
    phrasing = AGENT_VARIANTS.fieldNames().index("phrasing")
    variants = [v for v in AGENT_VARIANT_ROWS if v[phrasing] == "be_specific"]
    return joins.with_each(
        grid.select("doc_id", "configured_llm_name"), variants, AGENT_VARIANTS
    ).select("doc_id", "configured_llm_name", "name")


@query(
    "join_cycle_experiment",
    f"""with {src.EXPERIMENTS_SQL}
    select experiment_execution_uuid, cycle_num, value, exit_stage, used_cycle_count,
           latest_exit_stage
    from cycles left join (select * from experiments where used_cycle_count is not null)
    using (experiment_execution_uuid)""",
)
def cycle_experiment(spark, sf_dir):
    """All cycles with their experiment; those of an exception find none."""
    cycles = src.cycles(spark, sf_dir)
    experiments = summary.rollup_cycles(cycles).where("used_cycle_count is not null")
    return joins.attach_experiments(
        cycles.select("experiment_execution_uuid", "cycle_num", "value", "exit_stage"),
        experiments.drop("was_testbench_passed"),
    )


RESULT = {
    "experiment_execution_uuid": src.EXPERIMENT_ID,
    "cycle_num": "event_id % 8",
    "event_type": "event_type",
    "props": "props",
    "return_code": "cast(case event_type when 'error' then 1 when 'signup' then null else 0 end as int)",
}


@query(
    "join_results_to_cycle",
    f"""with r as (select {', '.join(f'{v} as {k}' for k, v in RESULT.items())} from events)
    select experiment_execution_uuid, cycle_num, event_type as exit_kind,
           case when event_type <> 'view' then return_code end as compile_result_return_code,
           case when event_type <> 'view' then props end as compile_result_stdout,
           case when event_type <> 'view' then '' end as compile_result_stderr,
           case when event_type <> 'view' then return_code is not distinct from 0 end
             as was_compile_success,
           case when event_type in ('click', 'purchase') then 0 end as execute_result_return_code,
           case when event_type in ('click', 'purchase') then event_type end as execute_result_stdout,
           case when event_type in ('click', 'purchase') then props end as execute_result_stderr,
           case when event_type in ('click', 'purchase') then true end as was_execute_success
    from r""",
)
def results_to_cycle(spark, sf_dir):
    key = ["experiment_execution_uuid", "cycle_num"]
    rows = src.table(spark, sf_dir, "events").selectExpr(
        *[f"{sql} as {name}" for name, sql in RESULT.items()]
    )
    steps = {
        "compile": (F.col("event_type") != "view", F.col("props"), F.lit("")),
        "execute": (
            F.col("event_type").isin("click", "purchase"), F.col("event_type"), F.col("props")
        ),
    }
    ran = F.array_compact(
        F.array(
            *[
                F.when(
                    condition,
                    F.struct(F.lit(step).alias("step"), out.alias("stdout"), err.alias("stderr")),
                )
                for step, (condition, out, err) in steps.items()
            ]
        )
    )
    results = rows.select(*key, "return_code", F.inline(ran))
    return joins.attach_results(rows.select(*key, F.col("event_type").alias("exit_kind")), results)


@query(
    "set_union_scans",
    f"with {src.FILES_SQL} select file_name, contents from files",
)
def union_scans(spark, sf_dir):
    files = src.source_files(spark, sf_dir)
    plain = files.where(F.col("file_name").endswith(".v"))
    system = files.where(F.col("file_name").endswith(".sv"))
    return joins.union_ragged(plain, system)


_RAGGED = f"""{src.EXPERIMENTS_SQL}, log as (
  select llm_provider_name, configured_llm_name, latest_exit_stage, was_testbench_passed,
         experiment_execution_uuid, cast(null as varchar) as problem_id, cast(null as varchar) as error
  from experiments
  union all
  select null, null, 'exception', false, null, 've_' || doc_id, 'bad ' || lang from documents)"""


def _ragged(spark, sf_dir):
    """Finished experiments and, from the documents, exception rows with other columns."""
    done = src.experiments(spark, sf_dir).drop(
        "used_cycle_count", "max_cycle_count", "is_beyond_limit"
    )
    crashed = src.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("ve_"), F.col("doc_id").cast("string")).alias("problem_id"),
        F.lit("exception").alias("latest_exit_stage"),
        F.lit(False).alias("was_testbench_passed"),
        F.concat(F.lit("bad "), F.col("lang")).alias("error"),
    )
    return joins.union_ragged(done, crashed)


@query("set_union_ragged", f"with {_RAGGED} select * from log")
def union_ragged(spark, sf_dir):
    return _ragged(spark, sf_dir)


# -- summaries -------------------------------------------------------------------------------


@query(
    "agg_exit_stage_by_model",
    f"""with {_RAGGED} select llm_provider_name, configured_llm_name, latest_exit_stage,
        count(*) as count from log group by all""",
)
def exit_stage_by_model(spark, sf_dir):
    return summary.stages_by_model(_ragged(spark, sf_dir), "latest_exit_stage")


@query(
    "agg_exit_stage",
    f"with {src.CYCLES_SQL} select exit_stage, count(*) as count from cycles group by exit_stage",
)
def exit_stage(spark, sf_dir):
    return summary.count_by(src.cycles(spark, sf_dir), "exit_stage")


_LISTED = sorted(set(CYCLE_STAGES) - {"60_tb_failed"})
_STAGE_SUMS = ", ".join(
    f"cast(count(*) filter (latest_exit_stage = '{s}') as bigint) as \"{s}\"" for s in _LISTED
) + """, cast(count(*) filter (latest_exit_stage is null or latest_exit_stage not in ({})) as bigint)
    as other""".format(", ".join(f"'{s}'" for s in _LISTED))


@query(
    "agg_pivot_exit_stage",
    f"""with {_RAGGED} select llm_provider_name, configured_llm_name, {_STAGE_SUMS},
        count(*) as total from log group by all""",
)
def pivot_exit_stage(spark, sf_dir):
    """Summary 2 with one stage missing in its list, beside the totals of summary 1."""
    counts = summary.stages_by_model(_ragged(spark, sf_dir), "latest_exit_stage")
    totals = counts.groupBy(*summary.MODEL_KEYS).agg(F.sum("count").alias("total"))
    two = summary.pivot_stages(counts, "latest_exit_stage", _LISTED)
    return joins.join_on_same(two, totals, summary.MODEL_KEYS)


@query(
    "agg_run_counters",
    f"""with {_RAGGED} select count(*) as total_experiment_count,
      count(*) filter (latest_exit_stage = 'exception') as exception_count,
      count(*) filter (latest_exit_stage <> 'exception') as nonexception_count,
      count(*) filter (was_testbench_passed) as valid_count,
      count(*) filter (not was_testbench_passed) as invalid_count from log""",
)
def run_counters(spark, sf_dir):
    return summary.run_counters(
        _ragged(spark, sf_dir), "latest_exit_stage", valid=F.col("was_testbench_passed")
    )


@query("agg_cycle_rollup", f"with {src.EXPERIMENTS_SQL} select * from experiments")
def cycle_rollup(spark, sf_dir):
    return src.experiments(spark, sf_dir)


@query(
    "agg_bug_status",
    f"""with {src.attempts_sql('doc_id', 'response')}, v as (
      select 'prov' || (doc_id % 2) as llm_provider_name, 'm' || (doc_id % 3) as configured_llm_name,
        case when doc_id % 50 = 49 then 'exception'
             when lower(response) like '%bug found%' and lower(response) like '%bug not found%'
               then 'UNKNOWN'
             when lower(response) like '%bug not found%' then 'BUG NOT FOUND'
             when lower(response) like '%bug found%' then 'BUG FOUND' else 'UNKNOWN' end
        as bug_found_status from attempts)
    select *, count(*) as count from v group by all""",
)
def bug_status(spark, sf_dir):
    def name(prefix, n):
        return F.concat(F.lit(prefix), (F.col("doc_id") % n).cast("string"))

    scans = src.attempts(spark, sf_dir).select(
        name("prov", 2).alias("llm_provider_name"),
        name("m", 3).alias("configured_llm_name"),
        F.when(F.col("doc_id") % 50 == 49, "exception")
        .otherwise(bug_verdict("response"))
        .alias("bug_found_status"),
    )
    return summary.stages_by_model(scans, "bug_found_status")


@query(
    "agg_distinct_agents",
    f"with {src.MESSAGES_SQL} select distinct agent_name from messages where agent_name <> ''",
)
def distinct_agents(spark, sf_dir):
    return summary.distinct_agents(src.messages(spark, sf_dir))


RESPONSE = {
    "configured_llm_name": f"concat('m', {src.text_of('user_id % 3')})",
    "prompt": "event_type",
    "response": "case when user_id % 3 = 0 then event_type else props end",
    "is_stable": "user_id % 3 < 2",
}


@query(
    "agg_response_stability",
    f"""with r as (select {', '.join(f'{v} as {k}' for k, v in RESPONSE.items())} from events),
    c as (select configured_llm_name, prompt, count(*) as query_count,
                 count(distinct response) as distinct_responses, bool_or(is_stable) as promise
          from r group by all)
    select configured_llm_name, prompt, query_count, distinct_responses,
           distinct_responses = 1 as is_one_response,
           not promise or distinct_responses = 1 as is_as_promised from c""",
)
def response_stability(spark, sf_dir):
    responses = src.table(spark, sf_dir, "events").selectExpr(
        *[f"{sql} as {name}" for name, sql in RESPONSE.items()]
    )
    return summary.response_stability(responses, is_stable="is_stable")


# -- order and windows -----------------------------------------------------------------------


@query(
    "ord_conversation",
    f"""with {src.MESSAGES_SQL} select conv_id, seq, role, agent_name, text from messages
    order by conv_id, timestamp, seq""",
)
def conversation_order(spark, sf_dir):
    ordered = history.ordered_conversation(
        src.messages(spark, sf_dir), ["conv_id"], "timestamp", "seq"
    )
    return ordered.select("conv_id", "seq", "role", "agent_name", "text")


@query(
    "ord_all_columns",
    f"""with {src.CYCLES_SQL} select exit_stage, llm_provider_name, configured_llm_name,
        count(*) as n from cycles group by all order by all""",
)
def all_columns_order(spark, sf_dir):
    counted = (
        src.cycles(spark, sf_dir)
        .groupBy("exit_stage", "llm_provider_name", "configured_llm_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return history.order_by_all(counted)


@query(
    "win_chat_history",
    f"""with {src.LONG_MESSAGES_SQL},
    asked as (select conv_id, max(position) as position from messages where role = 'user'
              group by conv_id)
    select a.conv_id, a.position, count(*) as message_count,
           '[' || string_agg('{{"content":' || {ora.js('m.text')} || ',"role":'
             || {ora.js('m.role')} || '}}', ',' order by m.position) || ']' as messages
    from asked a join messages m on m.conv_id = a.conv_id and m.position <= a.position
    group by all""",
)
def chat_history(spark, sf_dir):
    """The whole history of the last prompt of every conversation."""
    placed = history.with_positions(src.long_messages(spark, sf_dir), ["conv_id"])
    prompts = placed.where("role = 'user'").groupBy("conv_id").agg(
        F.max("position").alias("position")
    )
    found = history.chat_history(placed, prompts, ["conv_id"])
    return found.select(
        "conv_id",
        "position",
        F.size("messages").cast("bigint").alias("message_count"),
        F.to_json("messages").alias("messages"),
    )


@query(
    "win_chat_history_chain",
    f"""with {src.LONG_MESSAGES_SQL}
    select conv_id, position, position + 1 as message_count, cast(char_count as bigint) as char_count
    from (select *, sum(length(text)) over (partition by conv_id order by position) as char_count
          from messages) where role = 'user'""",
)
def chat_history_chain(spark, sf_dir):
    """The histories of all prompts as a chain, written in two batches; how long each of them is."""
    messages = src.long_messages(spark, sf_dir)
    chain = chains.HistoryChain(fresh_path(spark, "chain"), [messages.schema["conv_id"]])
    chain.append(messages.where("seq >= 1000"), 0)  # time runs against the numbers
    chain.append(messages.where("seq < 1000"), 1)
    return chain.sizes(spark)


BUDGET = 2000


@query(
    "win_context_truncate",
    f"""with {src.MESSAGES_SQL},
    m as (select conv_id, seq, role, length(text) as size,
                 row_number() over w - 1 as pos,
                 coalesce(sum(length(text)) over (w rows between unbounded preceding and 1 preceding), 0)
                   as begins
          from messages window w as (partition by conv_id order by seq)),
    lead as (select conv_id, size as lead_size from m where pos = 0 and role = 'system'),
    p as (select m.*, coalesce(lead_size, 0) as lead_size, lead_size is not null and pos > 0 as sys
          from m left join lead using (conv_id) where role = 'user'),
    c as (select p.conv_id, p.seq, p.pos, p.sys, min(h.pos) as first_kept
          from p join m h on h.conv_id = p.conv_id and h.pos <= p.pos
               and h.pos >= case when p.sys then 1 else 0 end
               and p.begins - h.begins + p.size + case when p.sys then p.lead_size else 0 end <= {BUDGET}
          group by all),
    k as (select * from c where sys or pos = 0 or first_kept < pos)
    select p.conv_id, p.seq, p.pos as history_count, p.sys as keeps_system,
           k.first_kept as first_kept_position,
           p.pos - k.first_kept + case when p.sys then 1 else 0 end as kept_count,
           k.first_kept is null as over_budget
    from p left join k on k.conv_id = p.conv_id and k.seq = p.seq""",
)
def context_truncate(spark, sf_dir):
    return history.truncate_context(src.messages(spark, sf_dir), ["conv_id"], BUDGET)


@query(
    "win_last_attempt",
    f"""with {src.CYCLES_SQL} select experiment_execution_uuid, cycle_num, exit_stage, value,
      lag(exit_stage) over w as last_exit_stage, lag(value) over w as last_value from cycles
      window w as (partition by experiment_execution_uuid order by cycle_num)""",
)
def last_attempt(spark, sf_dir):
    rows = src.cycles(spark, sf_dir).select(
        "experiment_execution_uuid", "cycle_num", "exit_stage", "value"
    )
    return history.last_attempts(rows, ["exit_stage", "value"])


@query("win_until_first_pass", f"with {src.KEPT_SQL} select * from kept")
def until_end(spark, sf_dir):
    return history.until_end(src.cycles(spark, sf_dir))


@query(
    "win_phase",
    f"""with {src.CYCLES_SQL} select experiment_execution_uuid, cycle_num,
      case when row_number() over (partition by experiment_execution_uuid order by cycle_num) = 1
           then 'init' else 'retry' end as phase from cycles""",
)
def phase(spark, sf_dir):
    return src.cycles(spark, sf_dir).select(
        "experiment_execution_uuid", "cycle_num", history.phase().alias("phase")
    )
