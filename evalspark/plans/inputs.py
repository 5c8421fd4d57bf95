"""Evaluation tables derived from the given tables.

Row-wise derivations are SQL expressions that Spark and the oracle both understand, so both sides
start from the same input. Every row and the whole of every text is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.summary import rollup_cycles

EPOCH_MICROS = 1_704_067_200_000_000
NL = "chr(10)"
FENCE = "repeat(chr(96), 3)"


def text_of(sql: str) -> str:
    return f"cast({sql} as string)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ID = text_of("doc_id")

# Model answers: tagged fence, plain fence, two fences, bare module, prose, fence too short.
RESPONSE = f"""case doc_id % 6
  when 0 then concat('Sure:', {NL}, {FENCE}, 'verilog', {NL}, 'module m', {ID}, ';', {NL}, text,
                     {NL}, 'endmodule', {NL}, {FENCE}, ' bug FOUND')
  when 1 then concat({FENCE}, {NL}, text, {NL}, {FENCE}, {NL}, 'BUG NOT FOUND')
  when 2 then concat({FENCE}, 'v', {NL}, 'abcdefg', {NL}, {FENCE}, ' and ', {FENCE}, {NL},
                     'wire x', {ID}, ';', {NL}, {FENCE}, {NL}, text, 'Bug found, bug not found')
  when 3 then concat(text, ' module z', {ID}, '; assign a = b; endmodule Bug Found')
  when 4 then text
  else concat({FENCE}, 'v', {NL}, 'abc', {NL}, {FENCE}, {NL}, text, 'BUG NOT FOUND') end"""

# Results of the two commands of an attempt. A missing return code means the command timed out.
STDOUT = f"""case when doc_id % 9 = 0 then ''
  else concat('VCD info: dumpfile /home/some user/', lang, '/run_', {ID}, '/project/wave.vcd opened.',
              {NL}, text, {NL},
              case doc_id % 4
                when 0 then concat('HINT: total mismatched SAMPLES is 0 out of ',
                                   {text_of('n_chars')}, ' samples')
                when 1 then concat('Hint: Total mismatched samples is ', {text_of('doc_id % 17')},
                                   ' out of ', {text_of('n_chars')}, ' samples', {NL},
                                   'Total mismatched samples is 0 out of 1 samples')
                when 2 then concat('Hint: Total mismatched samples is 0 out of 200 samples', {NL})
                else 'Simulation finished' end) end"""
STDERR = f"""case when doc_id % 3 = 0 then ''
  else concat('C:', chr(92), 'Users', chr(92), 'u ', lang, chr(92), 'project', chr(92), 't.sv:',
              {ID}, ': syntax error') end"""
COMPILE_CODE = "case when doc_id % 29 = 0 then null when doc_id % 5 = 0 then 1 else 0 end"
COMPILE_LATE = "(doc_id % 29 = 0)"
EXECUTE_CODE = "case when doc_id % 13 = 0 then null when doc_id % 7 = 0 then 2 else 0 end"
EXECUTE_LATE = "(doc_id % 13 = 0)"
HEADER = f"case when doc_id % 10 = 0 then null else concat('module top', {ID}, '(input a);', {NL}) end"

ATTEMPT = {
    "doc_id": "doc_id",
    "text": "text",
    "header": HEADER,
    "response": RESPONSE,
    "stdout": STDOUT,
    "stderr": STDERR,
    "compile_code": COMPILE_CODE,
    "compile_late": COMPILE_LATE,
    "execute_code": EXECUTE_CODE,
    "execute_late": EXECUTE_LATE,
}


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation attempt per document: answer, command results, problem text."""
    return table(spark, sf_dir, "documents").selectExpr(
        *[f"{sql} as {name}" for name, sql in ATTEMPT.items()]
    )


def attempts_sql(*columns: str) -> str:
    picked = ", ".join(f"{ATTEMPT[c]} as {c}" for c in (columns or ATTEMPT))
    return f"attempts as (select {picked} from documents)"


# Cycles: eight per experiment, of which its variant allowed five to nine. Some end by an exception.
EXPERIMENT_ID = f"concat('e', {text_of('event_id - event_id % 8')})"
CYCLE = {
    "experiment_execution_uuid": EXPERIMENT_ID,
    "cycle_num": "event_id % 8",
    "llm_provider_name": f"concat('prov', {text_of('(event_id - event_id % 8) % 16')})",
    "configured_llm_name": f"concat('m', {text_of('(event_id - event_id % 8) % 24')})",
    "value": "value",
    "max_conversation_cycles": "cast(5 + (event_id - event_id % 8) % 40 / 8 as bigint)",
    "exit_stage": """case event_type
      when 'error' then case when event_id % 3 = 0 then 'exception' else '30_iverilog_compile_error' end
      when 'view' then '20_code_extraction_error' when 'signup' then '40_iverilog_execute_error'
      when 'click' then '60_tb_failed' else '80_tb_passed' end""",
}
MODEL_COLUMNS = ["experiment_execution_uuid", "llm_provider_name", "configured_llm_name"]


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        *[f"{sql} as {name}" for name, sql in CYCLE.items()]
    )


CYCLES_SQL = "cycles as (select {} from events)".format(
    ", ".join(f"{sql} as {name}" for name, sql in CYCLE.items())
)
ENDS_SQL = "exit_stage in ('80_tb_passed', 'exception')"
KEPT_SQL = f"""{CYCLES_SQL},
kept as (select * exclude (ended_before) from (
  select *, coalesce(max(case when {ENDS_SQL} then 1 else 0 end) over (
      partition by experiment_execution_uuid order by cycle_num
      rows between unbounded preceding and 1 preceding), 0) as ended_before
  from cycles) where ended_before = 0)"""
EXPERIMENTS_SQL = f"""{KEPT_SQL},
ended as (
  select experiment_execution_uuid, llm_provider_name, configured_llm_name,
         max(cycle_num) + 1 as used, max(max_conversation_cycles) as allowed,
         arg_max(exit_stage, cycle_num) as latest_exit_stage
  from kept group by all),
experiments as (
  select experiment_execution_uuid, latest_exit_stage,
         case when latest_exit_stage <> 'exception' then llm_provider_name end as llm_provider_name,
         case when latest_exit_stage <> 'exception' then configured_llm_name end
           as configured_llm_name,
         case when latest_exit_stage <> 'exception' then used end as used_cycle_count,
         case when latest_exit_stage <> 'exception' then allowed end as max_cycle_count,
         case when latest_exit_stage <> 'exception' then used > allowed end as is_beyond_limit,
         latest_exit_stage = '80_tb_passed' as was_testbench_passed
  from ended)"""


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_cycles(
        cycles(spark, sf_dir), keys=MODEL_COLUMNS, limit="max_conversation_cycles"
    )


# Messages: two neighbouring ones share a time stamp; system messages have no agent.
MESSAGE = {
    "conv_id": "conv_id",
    "seq": "turn",
    "role": "role",
    "agent_name": "case role when 'user' then 'designer_agent' when 'assistant' then "
    "'debugger_agent' end",
    "uuid": f"concat('u', {text_of('conv_id')}, '-', {text_of('turn')})",
    "text": "text",
    "metadata": f"case when turn % 3 = 0 then null else concat('{{\"eval_count\":', "
    f"{text_of('turn')}, '}}') end",
    "micros": f"{EPOCH_MICROS} + conv_id * 250000 + (turn - turn % 2) * 1500000",
}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .selectExpr(*[f"{sql} as {name}" for name, sql in MESSAGE.items()])
        .withColumn("timestamp", F.timestamp_micros("micros"))
        .drop("micros")
    )


MESSAGES_SQL = "messages as (select {}, make_timestamp({}) as timestamp from conversations)".format(
    ", ".join(f"{sql} as {name}" for name, sql in MESSAGE.items()), MESSAGE["micros"]
)

# Long conversations: two thousand events each, and time runs against the sequence numbers.
LONG_MESSAGE = {
    "conv_id": "event_id - event_id % 2000",
    "seq": "event_id % 2000",
    "role": "case event_type when 'click' then 'user' when 'error' then 'system' else 'assistant' end",
    "agent_name": "case event_type when 'click' then 'designer_agent' when 'view' then "
    "'debugger_agent' end",
    "uuid": f"concat('u', {text_of('event_id')})",
    "text": "concat(event_type, ' ', props)",
    "micros": f"{EPOCH_MICROS} - (event_id - event_id % 2) * 1000000",
}


def long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr(*[f"{sql} as {name}" for name, sql in LONG_MESSAGE.items()])
        .withColumn("timestamp", F.timestamp_micros("micros"))
        .drop("micros")
    )


LONG_MESSAGES_SQL = """messages as (
  select *, row_number() over (partition by conv_id order by timestamp, seq) - 1 as position
  from (select {}, make_timestamp({}) as timestamp from events))""".format(
    ", ".join(f"{sql} as {name}" for name, sql in LONG_MESSAGE.items()), LONG_MESSAGE["micros"]
)

# Source files: pages, half of them *.v and half *.sv.
FILE = {
    "file_name": f"concat('f', {text_of('page_id')}, case page_id % 2 when 0 then '.v' else '.sv' end)",
    "contents": "html",
}


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        *[f"{sql} as {name}" for name, sql in FILE.items()]
    )


FILES_SQL = "files as (select {} from pages)".format(
    ", ".join(f"{sql} as {name}" for name, sql in FILE.items())
)


def big(column: Column) -> Column:
    return column.cast("bigint")


def quoted(text: str) -> str:
    """A SQL string literal for the oracle."""
    return "'" + text.replace("'", "''") + "'"
