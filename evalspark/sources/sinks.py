"""Writers for logs, summaries, conversations and command outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.messages import message_json, render_message
from evalspark.sources.readers import read_jsonl, sibling

JSON_KEEPS_NULLS = {"ignoreNullFields": "false"}
UNKNOWN_FIELDS = "unknown_fields"


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(**JSON_KEEPS_NULLS).json(path)


def compact_jsonl(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    extension: str = ".pq",
    partitions: int | None = None,
) -> str:
    """Rewrite a JSON-lines log as Parquet beside it; a missing log raises.

    Fields that the schema does not have are kept in the map column ``unknown_fields``.
    ``partitions`` sets the number of files (without a shuffle); by default one per input split.
    """
    if extension not in (".pq", ".parquet"):
        raise ValueError(f"unknown extension: {extension}")
    log = read_jsonl(spark, path, schema, rest=UNKNOWN_FIELDS)
    target = sibling(path, extension)
    (log if partitions is None else log.coalesce(partitions)).write.mode("overwrite").parquet(target)
    return target


def write_summary(df: DataFrame, folder: str, kind: int) -> str:
    """Write summary 1 or 2."""
    target = f"{folder}/experiment_summary_type_{kind}.pq"
    df.write.mode("overwrite").parquet(target)
    return target


def _log_lines(messages: DataFrame, keys: list[str], agent: Column, by_agent: bool) -> DataFrame:
    """The messages in order, within each agent's log if these are apart; rendered after the move.

    The range partitioning cuts also within a conversation.
    """
    order = [*(["_agent"] if by_agent else []), *keys, "timestamp", "seq"]
    as_json = message_json("role", "agent_name", "uuid", "timestamp", "text", "metadata")
    named = messages.withColumn("_agent", agent)
    if by_agent:
        named = named.where("_agent is not null and _agent <> ''")
    return (
        named.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*keys, "seq", F.col("_agent").alias("agent"), as_json.alias("json"),
                _banner().alias("text"))
    )


def _banner() -> Column:
    # a log takes every message: one overlong agent name must not fail the whole job
    return render_message("role", "agent_name", "uuid", "text", strict=False)


def _write_conversations(
    messages: DataFrame, keys: list[str], folder: str, agent: Column, mode: str
) -> None:
    for name, by_agent in (("all", False), ("by_agent", True)):
        lines = _log_lines(messages, keys, agent, by_agent).write.mode(mode)
        if by_agent:
            lines = lines.partitionBy("agent")
        lines.options(**JSON_KEEPS_NULLS).json(f"{folder}/{name}")


def overwrite_conversations(messages: DataFrame, keys: list[str], folder: str) -> None:
    """Write conversations in order: ``all`` with every message, ``by_agent`` split per agent.

    Messages without an agent are in ``all`` only.
    """
    _write_conversations(messages, keys, folder, F.col("agent_name"), "overwrite")


def append_conversations(messages: DataFrame, keys: list[str], folder: str) -> None:
    """As above but appending, and messages without an agent go to a log named ``None``."""
    agent = F.coalesce(F.col("agent_name"), F.lit("None"))
    _write_conversations(messages, keys, folder, agent, "append")


def step_outputs(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per stream of each command result: output_name, content."""

    def stream(name: str) -> Column:
        label = F.concat(
            F.lit("cmd_"),
            F.col("step"),
            F.lit(f"_{name}_ret"),
            F.coalesce(F.col("return_code").cast("string"), F.lit("None")),
        )
        return F.struct(label.alias("output_name"), F.col(name).alias("content"))

    return results.select(
        *keys, F.explode(F.array(stream("stdout"), stream("stderr"))).alias("_s")
    ).select(*keys, "_s.*")


def write_step_outputs(results: DataFrame, keys: list[str], folder: str) -> None:
    """One folder per step, stream and return code, which are few."""
    step_outputs(results, keys).write.mode("overwrite").partitionBy("output_name").options(
        **JSON_KEEPS_NULLS
    ).json(folder)


def row_snapshots(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and the whole row as indented JSON."""
    options = {"pretty": "true", "ignoreNullFields": "false"}
    return df.select(*keys, F.to_json(F.struct(*df.columns), options).alias("snapshot"))


def write_row_snapshots(df: DataFrame, keys: list[str], folder: str) -> None:
    """Snapshots as a table keyed by experiment; a file per experiment would not scale."""
    row_snapshots(df, keys).write.mode("overwrite").parquet(folder)
