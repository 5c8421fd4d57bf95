"""Queries over the text, time and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import extract, messages as msg, times, toolout
from evalspark.functions.strings import int_div
from evalspark.operators import history, states
from evalspark.plans import inputs as src
from evalspark.plans import oracle_text as ora
from evalspark.plans.inputs import quoted
from evalspark.plans.registry import query
from evalspark.session import fresh_path


def _per_document(name: str, function, sql: str) -> None:
    """One text function over the whole answers, one output row per document."""

    @query(
        name,
        f"with {src.attempts_sql('doc_id', 'response')} "
        f"select doc_id, {sql} as result from attempts",
    )
    def run(spark, sf_dir):
        return src.attempts(spark, sf_dir).select("doc_id", function("response").alias("result"))


_per_document("txt_extract_fenced", extract.fenced_code, ora.fenced("response"))
_per_document("txt_extract_module", extract.module_code, ora.module("response"))
_per_document("txt_extract_code", extract.extract_code, ora.code("response"))


@query(
    "txt_line_numbers",
    f"""select doc_id, {ora.numbered('text')} as numbered,
        {ora.numbered('text', 3, prefix=False)} as numbered_behind from documents""",
)
def line_numbers(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select(
        "doc_id",
        extract.number_lines("text").alias("numbered"),
        extract.number_lines("text", "postfix", 3).alias("numbered_behind"),
    )


MIN_CHUNK, MAX_CHUNK = 8, 20
SPACED = "replace(text, '. ', concat('.', repeat(chr(10), 3)))"


@query(
    "txt_chunk_blank_lines",
    f"""with parts as (
      select doc_id, string_split(replace({SPACED}, chr(13), ''), chr(10)) as lines from documents),
    numbered as (
      select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from parts),
    paired as (
      select doc_id, i, trim(line) = '' and
             trim(coalesce(lead(line) over (partition by doc_id order by i), 'x')) = '' as is_break
      from numbered),
    breaks as (select doc_id, list([i] order by i) filter (is_break) as cand from paired group by doc_id),
    cuts as (
      select doc_id, lines, len(lines) as n,
             list_reduce(coalesce(cand, []), lambda acc, x:
               case when x[1] - acc[len(acc)] >= {MIN_CHUNK} then list_concat(acc, x) else acc end,
               [0::bigint]) as begins
      from parts join breaks using (doc_id)),
    trimmed as (
      select doc_id, lines, n, case when len(begins) > 1 and n - begins[len(begins)] < {MIN_CHUNK}
                                    then begins[:len(begins) - 1] else begins end as begins
      from cuts),
    spans as (
      select doc_id, lines, unnest(begins) as a, unnest(list_append(begins[2:], n)) as b
      from trimmed),
    pieces as (
      select doc_id, lines, b, unnest(generate_series(a, b - 1, {MAX_CHUNK})) as a from spans)
    select doc_id, row_number() over (partition by doc_id order by a) - 1 as chunk_no,
           a + 1 as start_line, least(a + {MAX_CHUNK}, b) - a as line_count,
           array_to_string(lines[a + 1:least(a + {MAX_CHUNK}, b)], chr(10)) as chunk_text
    from pieces""",
)
def chunk_blank_lines(spark, sf_dir):
    files = src.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SPACED} as text")
    return extract.split_into_chunks(files, "text", MIN_CHUNK, MAX_CHUNK)


@query(
    "txt_strip_paths",
    f"""with {src.attempts_sql('doc_id', 'stdout', 'stderr')}
    select doc_id, {ora.stripped_paths('stdout')} as clean_stdout,
           {ora.stripped_paths('stderr')} as clean_stderr from attempts""",
)
def strip_paths(spark, sf_dir):
    return src.attempts(spark, sf_dir).select(
        "doc_id",
        extract.strip_paths("stdout").alias("clean_stdout"),
        extract.strip_paths("stderr").alias("clean_stderr"),
    )


_STATS = (
    "'{\"mismatch_sample_count\":' || m || ',\"total_sample_count\":' || n || '}'"
)
_PARSED = f"""with {src.attempts_sql('doc_id', 'stdout')}, parsed as (
    select doc_id, stdout, {ora.mismatch('stdout', 1)} as m, {ora.mismatch('stdout', 2)} as n
    from attempts)"""


@query(
    "txt_parse_testbench",
    f"""{_PARSED} select doc_id, {_STATS} as testbench_stats, m = 0 as was_testbench_passed,
           m is null as raises from parsed""",
)
def parse_testbench(spark, sf_dir):
    """Strict parsing of every output that has the line; the others are those it raises on."""
    found = src.attempts(spark, sf_dir).select(
        "doc_id", "stdout", toolout.testbench_result("stdout").alias("r")
    )
    raises = F.col("r.testbench_stats").isNull()
    strict = F.when(~raises, toolout.testbench_result("stdout", strict=True))
    return found.select("doc_id", raises.alias("raises"), strict.alias("r")).select(
        "doc_id", "r.*", "raises"
    )


@query(
    "txt_parse_testbench_lenient",
    f"""{_PARSED}
    select doc_id, {_STATS} as testbench_stats, m = 0 as was_testbench_passed,
           case when m = 0 then 'tb_pass' when m > 0 then 'tb_fail' else 'tb_stats_not_found' end
             as stage
    from parsed""",
)
def parse_testbench_lenient(spark, sf_dir):
    result = toolout.testbench_result("stdout")
    passed = F.col("was_testbench_passed")
    return (
        src.attempts(spark, sf_dir)
        .select("doc_id", result.alias("r"))
        .select("doc_id", "r.testbench_stats", "r.was_testbench_passed")
        .withColumn(
            "stage",
            F.when(passed, "tb_pass").when(~passed, "tb_fail").otherwise("tb_stats_not_found"),
        )
    )


BANNER = f"""concat(chr(10), 'Icarus Verilog version 1', {src.ID}, '.0 (devel) (s', lang, ')', chr(10),
  chr(10), 'Copyright (c) 2000-2024', chr(10), text, chr(10),
  'Icarus Verilog Preprocessor version 13.', {src.ID}, '.2 (devel)', chr(10),
  ' FLAGS DLL vvp.tgt', chr(10),
  'vvp.tgt: Icarus Verilog VVP Code Generator 13.0 (', source, ')', chr(10))"""
_BANNER_RE = (
    r"(?m)^\s*(?P<t>.*Icarus.+?)\s+([vV]ersion\s+)?(?P<f>(?P<n>\d+\.\d+(\.\d+)?).*)$"
)


@query(
    "txt_parse_tool_versions",
    f"""with b as (select doc_id, {BANNER} as stdout from documents)
    select doc_id, unnest(regexp_extract_all(stdout, '{_BANNER_RE}', 1)) as tool_name,
           unnest(regexp_extract_all(stdout, '{_BANNER_RE}', 4)) as version_num,
           unnest(regexp_extract_all(stdout, '{_BANNER_RE}', 3)) as full_version_id from b""",
)
def parse_tool_versions(spark, sf_dir):
    banners = src.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{BANNER} as stdout")
    return banners.select("doc_id", F.inline(toolout.tool_versions("stdout")))


SERVER_OUT = f"""case when doc_id % 4 = 0 then text
  else concat(text, ' server Version IS 0.1.', {src.ID}, case when doc_id % 3 = 0 then '.' else '' end,
              ' and more') end"""


@query(
    "txt_parse_server_version",
    rf"""with s as (select doc_id, {SERVER_OUT} as stdout from documents)
    select doc_id, nullif(regexp_extract(stdout, '(?i)version is ((\d+\.?)+)', 1), '') as version
    from s""",
)
def parse_server_version(spark, sf_dir):
    outputs = src.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SERVER_OUT} as stdout")
    return outputs.select("doc_id", toolout.server_version("stdout").alias("version"))


MODEL_TAG = f"""case event_type when 'click' then concat('tinyllama:', {src.text_of('event_id % 9')}, '.1b')
  when 'view' then concat('lama', {src.text_of('user_id')}, 'b:', {src.text_of('event_id % 70')}, 'b')
  when 'error' then 'no-size:latest' else concat('code:', {src.text_of('event_id % 13')}, 'b') end"""


@query(
    "txt_param_count",
    rf"""with m as (select event_id, {MODEL_TAG} as model_name from events)
    select event_id, model_name,
           try_cast(regexp_extract(model_name, '(\d+(\.\d+)?)b', 1) as double) as parameter_count
    from m""",
)
def param_count(spark, sf_dir):
    tags = src.table(spark, sf_dir, "events").selectExpr("event_id", f"{MODEL_TAG} as model_name")
    return tags.withColumn("parameter_count", toolout.parameter_count("model_name"))


@query(
    "txt_header_line",
    f"""with l as (select event_id, concat(event_type, ' ', {src.text_of('event_id')}) as label
                   from events)
    select event_id, {ora.header('label', '=')} as wide, {ora.header('label', '>', 53)} as narrow
    from l""",
)
def header_line(spark, sf_dir):
    labels = src.table(spark, sf_dir, "events").selectExpr(
        "event_id", f"concat(event_type, ' ', {src.text_of('event_id')}) as label"
    )
    return labels.select(
        "event_id",
        msg.header_line("label").alias("wide"),
        msg.header_line("label", 53, ">").alias("narrow"),
    )


def _rendered():
    return msg.render_message("role", "agent_name", "uuid", "text")


@query(
    "txt_render_message",
    f"with {src.MESSAGES_SQL} select conv_id, seq, {ora.rendered()} as rendered from messages",
)
def render_message(spark, sf_dir):
    return src.messages(spark, sf_dir).select("conv_id", "seq", _rendered().alias("rendered"))


@query(
    "txt_render_transcript",
    f"""with {src.LONG_MESSAGES_SQL}
    select conv_id, count(*) as message_count,
           string_agg({ora.rendered()}, chr(10) || chr(10) order by position) as transcript
    from messages group by conv_id""",
)
def render_transcript(spark, sf_dir):
    placed = history.with_positions(src.long_messages(spark, sf_dir), ["conv_id"])
    return history.transcript(placed, ["conv_id"], _rendered())


@query(
    "txt_command_summary",
    f"""with {src.attempts_sql('doc_id', 'stdout', 'stderr', 'execute_code', 'execute_late')}
    select doc_id, {ora.summary('execute_code', 'execute_late', 'stdout', 'stderr')} as summary
    from attempts""",
)
def command_summary(spark, sf_dir):
    return src.attempts(spark, sf_dir).select(
        "doc_id",
        toolout.command_summary("execute_code", "execute_late", "stdout", "stderr").alias(
            "summary"
        ),
    )


CODE = "case when doc_id % 3 = 0 then concat('`timescale 1 ns/1 ps', chr(10), text) else text end"
_SCALE = quoted("`timescale 1 ps/1 ps\n\n")


@query(
    "txt_timescale",
    f"""with c as (select doc_id, {CODE} as code from documents)
    select doc_id, case when code like '`timescale%' then code || chr(10)
                   else {_SCALE} || code || chr(10) end as scaled,
           {_SCALE} || code || chr(10) as always_scaled from c""",
)
def timescale(spark, sf_dir):
    codes = src.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{CODE} as code")
    return codes.select(
        "doc_id",
        toolout.with_timescale("code").alias("scaled"),
        toolout.with_timescale("code", always=True).alias("always_scaled"),
    )


ANSWER = f"""case doc_id % 5 when 0 then concat(text, ' apple. Apple, apple; apples')
  when 1 then concat(text, ' apple apple')
  when 2 then ' [1, 2, 3, 4,5,6,7,8, 9 ,10 ] '
  when 3 then '[1, 2, 3, 4, 5, 6, 7, 8, 9, 10] done'
  else concat('[1, 2, 3, 4, 5, 6, 7, 8, 9, ', {src.ID}, ']') end"""


@query(
    "txt_prompt_quality",
    f"""with a as (select doc_id, {ANSWER} as response from documents)
    select doc_id, len(regexp_extract_all(response, 'apple')) >= 3 as apple_test,
           coalesce(try_cast(case when regexp_matches(trim(response), '^\\[[0-9, ]*\\]$')
                                  then response end as integer[])
                    = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], false) as count_to_10
    from a""",
)
def prompt_quality(spark, sf_dir):
    answers = src.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{ANSWER} as response")
    return answers.select(
        "doc_id",
        *[msg.answer_passes("response", c).alias(c) for c in ("apple_test", "count_to_10")],
    )


@query(
    "dt_file_stamp",
    """select event_id, strftime(ts, '%Y-%m-%dL') as stamp_date,
        strftime(ts, '%Y-%m-%d_%H-%M-%SL') as stamp_datetime,
        substr(strftime(ts, '%Y-%m-%d_%H-%M-%S-%f'), 1, 23) || 'L' as stamp_datetime_ms,
        strftime(ts, '%Y-%m-%d_%H-%M-%S-%fL') as stamp_datetime_us from events""",
)
def file_stamp(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select(
        "event_id",
        *[
            times.file_stamp("ts", p).alias(f"stamp_{p}")
            for p in ("date", "datetime", "datetime_ms", "datetime_us")
        ],
    )


@query(
    "dt_duration_seconds",
    f"""with d as (
      select event_id, epoch_us(ts) - {src.EPOCH_MICROS} as us from events),
    p as (select event_id, us, us // 86400000000 as days, us % 86400000000 as r from d)
    select event_id, us / 1000000.0::double as execution_duration_sec,
      case when days = 0 then '' when days = 1 then '1 day, ' else days || ' days, ' end
      || (r // 3600000000) || ':' || lpad(cast((r // 60000000) % 60 as varchar), 2, '0') || ':'
      || lpad(cast((r // 1000000) % 60 as varchar), 2, '0')
      || case when r % 1000000 = 0 then '' else '.' || lpad(cast(r % 1000000 as varchar), 6, '0') end
      as execution_duration
    from p""",
)
def duration_seconds(spark, sf_dir):
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    micros = times.duration_micros(start, F.col("ts"))
    return src.table(spark, sf_dir, "events").select(
        "event_id",
        times.duration_seconds(micros).alias("execution_duration_sec"),
        times.duration_text(micros).alias("execution_duration"),
    )


@query(
    "json_message",
    f"with {src.MESSAGES_SQL} select conv_id, seq, {ora.message_json()} as json from messages",
)
def message_json(spark, sf_dir):
    columns = ["role", "agent_name", "uuid", "timestamp", "text", "metadata"]
    return src.messages(spark, sf_dir).select(
        "conv_id", "seq", msg.message_json(*columns).alias("json")
    )


@query(
    "json_stats_extract",
    f"{_PARSED} select doc_id, m as mismatch_sample_count, n as total_sample_count from parsed",
)
def stats_extract(spark, sf_dir):
    stats = toolout.testbench_result("stdout")["testbench_stats"]
    return (
        src.attempts(spark, sf_dir)
        .select("doc_id", toolout.read_stats(stats).alias("s"))
        .select("doc_id", "s.mismatch_sample_count", "s.total_sample_count")
    )


_SNAP_STAGE = (
    "case when conv_id % 4 = 0 and cycle_num = 2 then '80_tb_passed' "
    "when conv_id % 7 = 3 and cycle_num = 1 then 'exception' else '60_tb_failed' end"
)


_STATES_SQL = f"""with {src.MESSAGES_SQL},
    m as (select * replace (coalesce(agent_name, 'system_agent') as agent_name),
                 seq // 2 as cycle_num from messages),
    m2 as (select *, {ora.message_json()} as j from m),
    h as (select conv_id, cycle_num, agent_name,
                 string_agg(j, ',') over (partition by conv_id, agent_name order by seq) as h, seq
          from m2),
    c as (select conv_id, cycle_num, {_SNAP_STAGE} as exit_stage,
                 max(case when role = 'assistant' then text end) as code,
                 count(*) as n
          from m group by conv_id, cycle_num),
    k as (select *, coalesce(max(case when {src.ENDS_SQL} then 1 else 0 end) over (
             partition by conv_id order by cycle_num rows between unbounded preceding and 1 preceding
          ), 0) as pb from c),
    a as (select k.*,
            (select h from h where h.conv_id = k.conv_id and agent_name = 'designer_agent'
               and h.cycle_num <= k.cycle_num order by seq desc limit 1) as hd,
            (select h from h where h.conv_id = k.conv_id and agent_name = 'debugger_agent'
               and h.cycle_num <= k.cycle_num order by seq desc limit 1) as hb,
            (select h from h where h.conv_id = k.conv_id and agent_name = 'system_agent'
               and h.cycle_num <= k.cycle_num order by seq desc limit 1) as hs
          from k where pb = 0),
    e as (select concat('x', conv_id) as experiment_execution_uuid, cycle_num,
      '{{"phase":"' || case when exit_stage = '80_tb_passed' and cycle_num = 0 then 'init'
                           else 'retry' end
      || '","conversation_histories":{{' || concat_ws(',', '"designer_agent":[' || hd || ']',
                                                       '"debugger_agent":[' || hb || ']',
                                                       '"system_agent":[' || hs || ']')
      || '}},"last_attempted_solution_code":' || {ora.js('code')}
      || ',"last_compile_result":{{"return_code":' || n || '}},"last_execute_result":null'
      || ',"last_was_testbench_passed":' || (exit_stage = '80_tb_passed') || '}}' as exit_state
    from a)"""


_AGENTS = ["designer_agent", "debugger_agent", "system_agent"]


def _state_cycles(spark, sf_dir):
    """Per cycle the messages it added to each agent, its code and its results."""
    json = msg.message_json("role", "agent_name", "uuid", "timestamp", "text", "metadata")
    entry = F.struct("seq", json.alias("json"))

    def of_agent(agent):
        said = F.collect_list(F.when(F.col("agent_name") == agent, entry))
        return F.transform(F.array_sort(said), lambda e: e["json"]).alias(agent)

    cycle_rows = (
        src.messages(spark, sf_dir)
        .withColumn("agent_name", F.coalesce("agent_name", F.lit("system_agent")))
        .withColumn("cycle_num", int_div(F.col("seq"), 2))
        .groupBy("conv_id", "cycle_num")
        .agg(
            *[of_agent(a) for a in _AGENTS],
            F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("code"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            F.concat(F.lit("x"), F.col("conv_id").cast("string")).alias(history.EXPERIMENT),
            "cycle_num",
            F.expr(_SNAP_STAGE).alias("exit_stage"),
            *_AGENTS,
            "code",
            F.to_json(F.struct(F.col("n").alias("return_code"))).alias("compiled"),
            F.lit(None).cast("string").alias("executed"),
        )
    )
    return history.until_end(cycle_rows)


@query(
    "json_state_snapshot",
    f"""{_STATES_SQL}
    select *, coalesce(lag(exit_state) over (partition by experiment_execution_uuid
                                             order by cycle_num),
                       {quoted(history.EMPTY_STATE)}) as entry_state from e""",
)
def state_snapshot(spark, sf_dir):
    cycles = _state_cycles(spark, sf_dir)
    return history.state_snapshots(cycles, _AGENTS, "code", "compiled", "executed")


@query(
    "json_state_deltas",
    f"""{_STATES_SQL}
    select experiment_execution_uuid, cast(cycle_num as bigint) as cycle_num, exit_state from e
    qualify cycle_num = max(cycle_num) over (partition by experiment_execution_uuid)""",
)
def state_deltas(spark, sf_dir):
    """The last state of every experiment, restored from a log of changes in two batches."""
    cycles = _state_cycles(spark, sf_dir)
    log = states.StateLog(fresh_path(spark, "states"), _AGENTS)
    log.append(cycles.where("cycle_num < 2"), 0, "code", "compiled", "executed")
    log.append(cycles.where("cycle_num >= 2"), 1, "code", "compiled", "executed")
    return log.as_json(log.restore(log.last_cycles(spark)))
