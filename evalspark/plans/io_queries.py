"""Queries over the readers, writers and the live stream: write, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators import summary
from evalspark.plans import inputs as src
from evalspark.plans import oracle_text as ora
from evalspark.operators.joins import join_on_same
from evalspark.plans.registry import query
from evalspark.schemas import AGENT_VARIANT_ROWS, AGENT_VARIANTS, CYCLE_STAGES
from evalspark.session import fresh_path
from evalspark.sources import compaction, drift, readers, sinks
from evalspark.streaming import live, rollup

_DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)
_NOTED = "doc_id, text, case when doc_id % 3 = 0 then lang end as note"


def _noted(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").selectExpr(*_NOTED.split(", ", 2))


@query("src_jsonl", f"select {_NOTED} from documents")
def jsonl(spark, sf_dir):
    path = fresh_path(spark, "jsonl")
    _noted(spark, sf_dir).write.json(path)
    return readers.read_jsonl(spark, path, _DOCUMENT)


_EVENT_ID, _USER_ID = src.text_of("event_id"), src.text_of("user_id")
#: Rows of a log whose writer changed over time, one of them broken.
DRIFTED_LINE = f"""case event_id % 7
    when 0 then concat('{{"event_id": ', {_EVENT_ID}, ', "user": {{"id": "', {_USER_ID}, '"}}, "extra": 1}}')
    when 1 then concat('{{"event_id": ', {_EVENT_ID}, ', "user": {{"id": ', {_USER_ID}, ', "zone": [1]}}, "value": null}}')
    when 2 then concat('{{"event_id": ', {_EVENT_ID}, '.5, "value": ', {_EVENT_ID}, '.25, "props": {{"k": true}}}}')
    when 3 then case when event_id % 11 = 0 then concat('{{"event_id": ', {_EVENT_ID}) else '[]' end
    else concat('{{"event_id": ', {_EVENT_ID}, ', "value": ', {_EVENT_ID}, '.75, "props": ', coalesce(props, 'null'),
        ', "event_type": "', event_type, '"}}') end"""
_DRIFT_SCHEMA = "event_id bigint, user struct<id: bigint>, value double, props map<string,bigint>, seen boolean"


@query(
    "src_jsonl_drift",
    f"""with lines as (select event_id, {DRIFTED_LINE} as line from events),
    parsed as (select event_id, case when json_valid(line) then line::json end as j from lines),
    fields as (select event_id, j, unnest(json_keys(j)) as k from parsed where json_type(j) = 'OBJECT'),
    inner_keys as (select event_id, k, json_extract(j, '$.' || k) as o from fields where k in ('user', 'props')),
    inner_fields as (select event_id, k as outer_k, o, unnest(json_keys(o)) as k from inner_keys
        where json_type(o) = 'OBJECT'),
    seen as (
        select event_id, '$' as path, coalesce(json_type(j), 'malformed') as t from parsed
        union select event_id, k, json_type(json_extract(j, '$.' || k)) from fields
        union select event_id, case outer_k when 'props' then 'props{{}}' else 'user.' || k end,
            json_type(json_extract(o, '$.' || k)) from inner_fields),
    kinds as (select event_id, path, case when t in ('BIGINT', 'UBIGINT') then 'integer' when t = 'DOUBLE' then 'number'
        when t = 'VARCHAR' then 'string' else lower(t) end as found from seen),
    counted as (select path, found, count(*) as row_count, min(event_id) as first_row from kinds group by all),
    given as (select * from (values
        ('$', 'struct<event_id:bigint,user:struct<id:bigint>,value:double,props:map<string,bigint>,seen:boolean>',
            ['object', 'null']),
        ('event_id', 'bigint', ['integer', 'null']), ('user', 'struct<id:bigint>', ['object', 'null']),
        ('user.id', 'bigint', ['integer', 'null']), ('value', 'double', ['integer', 'number', 'null']),
        ('props', 'map<string,bigint>', ['object', 'null']), ('props{{}}', 'bigint', ['integer', 'null']),
        ('seen', 'boolean', ['boolean', 'null'])) as g(path, expected, accepted)),
    status as (select coalesce(c.path, g.path) as path, expected, found,
            case when found is null then 'absent' when found = 'malformed' then 'malformed'
                when expected is null then 'new' when list_contains(accepted, found) then 'as given'
                else 'conflict' end as status,
            coalesce(row_count, 0) as row_count, first_row
        from counted c full join given g on c.path = g.path)
    select path, expected, found, status, row_count, first_row from status where status != 'as given'""",
)
def jsonl_drift(spark, sf_dir):
    """Where a log of events departs from its schema."""
    events = src.table(spark, sf_dir, "events")
    lines = events.select("event_id", F.expr(DRIFTED_LINE).alias("line"))
    return drift.schema_drift(lines, T.StructType.fromDDL(_DRIFT_SCHEMA), "event_id", "line")


@query(
    "src_parquet",
    "select event_id, event_type, value from events",
)
def parquet(spark, sf_dir):
    log = readers.read_parquet(spark, f"{sf_dir}/events.parquet")
    return log.select("event_id", "event_type", "value")


@query(
    "src_source_tree",
    "select source, unnest(string_split(text, chr(10))) as line from documents",
)
def source_tree(spark, sf_dir):
    """Documents written as a tree of text files, one folder per source; all lines of all files.

    A task writes its own files, so that no file outgrows a task's share, whatever the source.
    """
    folder = fresh_path(spark, "tree")
    documents = src.table(spark, sf_dir, "documents").select("text", "source")
    documents.write.partitionBy("source").option("maxRecordsPerFile", 1000).text(folder)
    files = readers.read_source_tree(spark, folder, extensions=("txt", "sv"))
    # a file ends with a line break, which starts no further line
    lines = F.split(F.regexp_replace("contents", r"\n\z", ""), "\n", -1)
    return files.select(
        F.regexp_extract("file_path", "source=([^/]+)/", 1).alias("source"),
        F.explode(lines).alias("line"),
    )


@query(
    "src_tree_size",
    "select cast(sum(octet_length(encode(text)) + 1) as bigint) as total_bytes from documents",
)
def tree_size(spark, sf_dir):
    folder = fresh_path(spark, "sized")
    src.table(spark, sf_dir, "documents").select("text", "lang").write.partitionBy("lang").text(
        folder
    )
    return readers.tree_size(spark, folder).select("total_bytes")


CONFIG = {
    "llm_class": "case event_type when 'click' then 'MockLlm' when 'view' then 'ChatGptLlm' "
    "when 'signup' then 'NoSuchLlm' else 'OllamaLlm' end",
    "configured_llm_name": "case when event_id % 50 = 0 then null else concat('m', "
    f"{src.text_of('event_id')}) end",
    "is_stable": "case when event_id % 3 = 0 then true end",
    "model_name": f"case event_id % 4 when 0 then null when 1 then concat('llama:', "
    f"{src.text_of('event_id % 70')}, 'b') when 2 then 'llama' else 'llama:latest' end",
    "option_seed": "cast(event_id as int)",
    "option_temperature": "value",
    "does_respond_to_test_queries": "case when event_id % 3 = 1 then false end",
    "response_delay_seconds": "case when event_id % 5 = 0 then value end",
}


@query(
    "src_model_configs",
    rf"""with c as (select {', '.join(f'{v} as {k}' for k, v in CONFIG.items())} from events),
    n as (select *, try_cast(regexp_extract(model_name, '(\d+(\.\d+)?)b', 1) as double) as billions
          from c)
    select llm_class, configured_llm_name, coalesce(is_stable, false) as is_stable,
      model_name, option_seed, option_temperature,
      case when llm_class = 'MockLlm' then coalesce(does_respond_to_test_queries, true) end
        as does_respond_to_test_queries,
      case when llm_class = 'MockLlm' then coalesce(response_delay_seconds, 0.01::double) end
        as response_delay_seconds,
      case when llm_class = 'OllamaLlm' then billions end as parameter_count_billions,
      case when llm_class = 'NoSuchLlm' then 'unknown class: NoSuchLlm'
           when configured_llm_name is null then 'no configured name'
           when llm_class <> 'MockLlm' and model_name is null then 'no model name'
           when llm_class = 'OllamaLlm' and model_name not like '%:%'
             then 'model name has no release tag'
           when llm_class = 'OllamaLlm' and billions is null
             then 'model name has no parameter count' end as problem
    from n""",
)
def model_configs(spark, sf_dir):
    """A config file with a line per event, written, read and checked; ``option_seed`` tells rows."""
    rows = src.table(spark, sf_dir, "events").selectExpr(
        *[f"{sql} as {name}" for name, sql in CONFIG.items()]
    )
    path = fresh_path(spark, "configs") + "/models.jsonl"
    sinks.append_jsonl(rows, path)
    checked = readers.read_model_configs(spark, path, require=False)
    return checked.drop("other_model_file_options")


_VARIANT_ROWS = ", ".join(f"({i}, '{v[0]}', '{v[4]}', {v[6]})" for i, v in enumerate(AGENT_VARIANT_ROWS))


@query(
    "src_rows_to_df",
    f"""with v(i, name, phrasing, wrap_in_md) as (values {_VARIANT_ROWS})
    select doc_id, name, phrasing, wrap_in_md from documents join v on doc_id % 7 = i""",
)
def rows_to_df(spark, sf_dir):
    """The configured variants as a table, joined to problems by the name assigned to each."""
    variants = readers.rows_to_table(spark, AGENT_VARIANT_ROWS, AGENT_VARIANTS)
    names = F.array(*[F.lit(v[0]) for v in AGENT_VARIANT_ROWS])
    assigned = src.table(spark, sf_dir, "documents").select(
        "doc_id", F.get(names, (F.col("doc_id") % 7).cast("int")).alias("name")
    )
    # the variants are a fixed list of seven rows
    return assigned.join(F.broadcast(variants), "name").select(
        "doc_id", "name", "phrasing", "wrap_in_md"
    )


# -- sinks -----------------------------------------------------------------------------------

_CYCLE_ROW = T.StructType(
    [
        T.StructField("experiment_execution_uuid", T.StringType()),
        T.StructField("cycle_num", T.LongType()),
        T.StructField("llm_provider_name", T.StringType()),
        T.StructField("configured_llm_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("max_conversation_cycles", T.LongType()),
        T.StructField("exit_stage", T.StringType()),
    ]
)


def _cycle_log(spark, sf_dir) -> str:
    """The cycles as a JSON-lines log, appended in two runs."""
    path = fresh_path(spark, "cycle_log") + "/log.jsonl"
    rows = src.cycles(spark, sf_dir)
    early = F.col("cycle_num") < 4
    sinks.append_jsonl(rows.where(early), path)
    sinks.append_jsonl(rows.where(~early), path)
    return path


@query("snk_jsonl_append", f"with {src.CYCLES_SQL} select * from cycles")
def jsonl_append(spark, sf_dir):
    return readers.read_jsonl(spark, _cycle_log(spark, sf_dir), _CYCLE_ROW)


@query("snk_jsonl_to_parquet", f"with {src.CYCLES_SQL} select * from cycles")
def jsonl_to_parquet(spark, sf_dir):
    """The log has a field more than the schema, which the copy keeps."""
    known = T.StructType([f for f in _CYCLE_ROW.fields if f.name != "exit_stage"])
    target = sinks.compact_jsonl(spark, _cycle_log(spark, sf_dir), known)
    copy = readers.read_parquet(spark, target)
    stage = F.col(sinks.UNKNOWN_FIELDS)["exit_stage"]
    return copy.withColumn("exit_stage", stage).drop(sinks.UNKNOWN_FIELDS)


@query(
    "snk_jsonl_incremental",
    f"with {src.CYCLES_SQL} select *, case when cycle_num < 3 then 1 else 2 end as run from cycles",
)
def jsonl_incremental(spark, sf_dir):
    """A log that grows between two runs; a third one finds nothing new."""
    work = fresh_path(spark, "growing")
    rows = src.cycles(spark, sf_dir)
    early = F.col("cycle_num") < 3
    for part in (early, ~early, None):
        if part is not None:
            sinks.append_jsonl(rows.where(part), f"{work}/log")
        compaction.compact_new(spark, f"{work}/log", _CYCLE_ROW, f"{work}/compact")
    found = compaction.read_compacted(spark, f"{work}/compact", _CYCLE_ROW)
    return found.drop(compaction.UNKNOWN_FIELDS).withColumn("run", F.col("run").cast("int"))


_SUMS = ", ".join(
    f"cast(sum(case when latest_exit_stage = '{s}' then 1 else 0 end) as bigint) as \"{s}\""
    for s in sorted(CYCLE_STAGES)
)


@query(
    "snk_summary_parquet",
    f"""with {src.EXPERIMENTS_SQL}, one as (
      select llm_provider_name, configured_llm_name, latest_exit_stage, count(*) as count
      from experiments group by all),
    two as (select llm_provider_name, configured_llm_name, {_SUMS},
                   cast(0 as bigint) as other from experiments group by all)
    select one.*, two.* exclude (llm_provider_name, configured_llm_name) from one join two
    on one.llm_provider_name is not distinct from two.llm_provider_name
    and one.configured_llm_name is not distinct from two.configured_llm_name""",
)
def summary_parquet(spark, sf_dir):
    """Both summaries written, read back and joined on the model."""
    folder = fresh_path(spark, "summary")
    one = summary.stages_by_model(src.experiments(spark, sf_dir), "latest_exit_stage")
    first = readers.read_parquet(spark, sinks.write_summary(one, folder, 1))
    two = summary.pivot_stages(first, "latest_exit_stage", CYCLE_STAGES)
    second = readers.read_parquet(spark, sinks.write_summary(two, folder, 2))
    return join_on_same(first, second, summary.MODEL_KEYS)


_LOG = f"""with {src.MESSAGES_SQL}, lines as (
  select conv_id, seq, agent_name, {ora.message_json()} as json, {ora.rendered()} as text
  from messages)"""


def _logs(spark, folder):
    schema = "conv_id bigint, seq bigint, agent string, json string, text string"
    everything = spark.read.schema(schema).json(f"{folder}/all")
    by_agent = spark.read.schema(schema).json(f"{folder}/by_agent")
    columns = ["conv_id", "seq", "agent", "json", "text"]
    return (
        everything.select(F.lit("all").alias("log"), *columns)
        .unionByName(by_agent.select(F.lit("by_agent").alias("log"), *columns))
    )


@query(
    "snk_conversation_overwrite",
    f"""{_LOG} select 'all' as log, conv_id, seq, agent_name as agent, json, text from lines
    union all select 'by_agent', conv_id, seq, agent_name, json, text from lines
    where agent_name is not null""",
)
def conversation_overwrite(spark, sf_dir):
    folder = fresh_path(spark, "conversations")
    rows = src.messages(spark, sf_dir)
    sinks.overwrite_conversations(rows.where(F.col("role") == "user"), ["conv_id"], folder)
    sinks.overwrite_conversations(rows, ["conv_id"], folder)
    return _logs(spark, folder)


@query(
    "snk_conversation_append",
    f"""{_LOG}, named as (select * replace (coalesce(agent_name, 'None') as agent_name) from lines)
    select 'all' as log, conv_id, seq, agent_name as agent, json, text from named
    union all select 'by_agent', conv_id, seq, agent_name, json, text from named""",
)
def conversation_append(spark, sf_dir):
    folder = fresh_path(spark, "conversations")
    rows = src.messages(spark, sf_dir)
    first = F.col("seq") < 3
    sinks.append_conversations(rows.where(first), ["conv_id"], folder)
    sinks.append_conversations(rows.where(~first), ["conv_id"], folder)
    return _logs(spark, folder)


@query(
    "snk_step_outputs",
    f"""with {src.attempts_sql('doc_id', 'stdout', 'stderr', 'execute_code')}
    select doc_id, 'cmd_execute_' || s || '_ret' || coalesce(cast(execute_code as varchar), 'None')
             as output_name, case s when 'stdout' then stdout else stderr end as content
    from attempts cross join (values ('stdout'), ('stderr')) as streams(s)""",
)
def step_outputs(spark, sf_dir):
    folder = fresh_path(spark, "steps")
    results = src.attempts(spark, sf_dir).select(
        "doc_id",
        F.lit("execute").alias("step"),
        F.col("execute_code").alias("return_code"),
        "stdout",
        "stderr",
    )
    sinks.write_step_outputs(results, ["doc_id"], folder)
    return spark.read.schema("doc_id bigint, content string, output_name string").json(folder)


@query(
    "snk_row_snapshot",
    f"""with {src.EXPERIMENTS_SQL} select experiment_execution_uuid, llm_provider_name,
      latest_exit_stage, used_cycle_count, was_testbench_passed, 8 as field_lines from experiments""",
)
def row_snapshot(spark, sf_dir):
    """Snapshots read back as JSON; one line per field shows the indentation."""
    folder = fresh_path(spark, "snapshots")
    sinks.write_row_snapshots(
        src.experiments(spark, sf_dir), ["experiment_execution_uuid"], folder
    )
    fields = (
        "llm_provider_name string, latest_exit_stage string, used_cycle_count bigint, "
        "was_testbench_passed boolean"
    )
    return (
        readers.read_parquet(spark, folder)
        .withColumn("row", F.from_json("snapshot", fields))
        .select(
            "experiment_execution_uuid",
            "row.*",
            (F.size(F.split("snapshot", "\n")) - 2).alias("field_lines"),
        )
    )


@query(
    "stm_live_exit_stages",
    f"""with {src.CYCLES_SQL} select llm_provider_name, configured_llm_name, exit_stage,
        count(*) as count from cycles group by all""",
)
def live_exit_stages(spark, sf_dir):
    """The log drained twice with one checkpoint: after the first rows and after the rest."""
    work = fresh_path(spark, "stream")
    rows = src.cycles(spark, sf_dir)
    early = F.col("cycle_num") < 4
    for part in (early, ~early):
        sinks.append_jsonl(rows.where(part), f"{work}/log")
        log = live.stream_log(spark, f"{work}/log", _CYCLE_ROW)
        counts = live.drain_counts(log, "exit_stage", f"{work}/checkpoint", f"{work}/counts")
    return counts


@query(
    "stm_experiment_rollup",
    f"""with {src.CYCLES_SQL},
    marked as (
      select *, {src.ENDS_SQL} as ends, coalesce(max(case when {src.ENDS_SQL} then 1 else 0 end) over (
          partition by experiment_execution_uuid order by cycle_num
          rows between unbounded preceding and 1 preceding), 0) = 1 as late
      from cycles)
    select experiment_execution_uuid,
           case when exit_stage <> 'exception' then llm_provider_name end as llm_provider_name,
           case when exit_stage <> 'exception' then configured_llm_name end as configured_llm_name,
           case when late then 'late' else 'closed' end as kind, cycle_num, exit_stage,
           case when not late and exit_stage <> 'exception' then cycle_num + 1 end as used_cycle_count
    from marked where late or ends""",
)
def experiment_rollup(spark, sf_dir):
    """Ended experiments and late cycles of a log that is drained twice with one checkpoint."""
    work = fresh_path(spark, "rollup")
    rows = src.cycles(spark, sf_dir)
    early = F.col("cycle_num") < 4
    for part in (early, ~early):
        sinks.append_jsonl(rows.where(part), f"{work}/log")
        log = live.stream_log(spark, f"{work}/log", _CYCLE_ROW)
        events = rollup.drain_rollup(log, f"{work}/checkpoint", f"{work}/events")
    return events
