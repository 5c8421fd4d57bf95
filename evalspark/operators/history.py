"""Conversation histories and cycle sequences.

A conversation may be arbitrarily long. Nothing here hands a whole conversation to one task: work
is done in blocks of consecutive messages, and only one small row per block is looked at per conversation. Only what
is asked for as one value, the history of a chosen prompt or a transcript, is put together as one.
Windows over an experiment are small, since it has few cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.strings import ColumnOrName, as_col, int_div
from evalspark.operators.joins import EXPERIMENT, join_on_same
from evalspark.schemas import END_STAGES, PASS_STAGE
from evalspark.session import fresh_path

OFFSET_BLOCK = 1024
#: Messages of a block of histories.
HISTORY_BLOCK = 256
EMPTY_STATE = (
    '{"phase":"init","conversation_histories":{},"last_attempted_solution_code":null,'
    '"last_compile_result":null,"last_execute_result":null,"last_was_testbench_passed":false}'
)


def ordered_conversation(messages: DataFrame, keys: list[str], timestamp: str, seq: str) -> DataFrame:
    """Messages by conversation and time; ``seq`` breaks ties.

    The range partitioning of the sort cuts between single messages, also inside a conversation.
    """
    return messages.orderBy(*keys, timestamp, seq)


def order_by_all(df: DataFrame) -> DataFrame:
    return df.orderBy(*df.columns)


def _block(seq: str, size: int) -> Column:
    return int_div(F.col(seq), size)


def _message() -> Column:
    return F.struct(F.col("text").alias("content"), F.col("role").alias("role"))


def with_positions(
    messages: DataFrame, keys: list[str], timestamp: str = "timestamp", seq: str = "seq"
) -> DataFrame:
    """Add ``position``: the number of messages before, in their conversation, by time and ``seq``.

    The messages are put in order once, in parts that also cut within a conversation, and written;
    a position is the sum of the parts before and the place in its own part.
    """
    spark = messages.sparkSession
    path = fresh_path(spark, "ordered")
    ordered = messages.repartitionByRange(*keys, timestamp, seq)
    ordered.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    in_part = Window.partitionBy(*keys, "_part").orderBy(timestamp, seq)
    placed = parts.withColumn("_place", F.row_number().over(in_part) - 1)
    return join_on_same(placed, starts, [*keys, "_part"]).select(
        *messages.columns, (F.col("_before") + F.col("_place")).cast("bigint").alias("position")
    )


def message_blocks(placed: DataFrame, keys: list[str], block: int = HISTORY_BLOCK) -> DataFrame:
    """The conversations cut into blocks of consecutive messages, each message in one of them.

    ``placed`` are messages with positions. A row has ``block_no``, ``block_size`` and ``messages``,
    the block's messages as (content, role) in order.
    """
    entry = F.struct("position", _message().alias("message"))
    grouped = placed.groupBy(*keys, _block("position", block).alias("block_no")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    return grouped.select(
        *keys,
        "block_no",
        F.size("entries").alias("block_size"),
        F.col("entries.message").alias("messages"),
    )


def prompt_heads(prompts: DataFrame, block: int = HISTORY_BLOCK) -> DataFrame:
    """Prompts (with ``position``) and where their history ends: ``block_no`` and ``tail``.

    The history of a prompt is all blocks before ``block_no`` and the first ``tail`` messages of
    that one. So the histories of all prompts take a row each, whatever their length.
    """
    place = F.col("position") - _block("position", block) * block
    return prompts.withColumns(
        {"block_no": _block("position", block), "tail": (place + 1).cast("int")}
    )


def expand_histories(heads: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The heads that are asked for with their ``messages``, all up to and including the prompt.

    Each head meets the blocks of its history by number and no others, so one long conversation is
    spread over its blocks. A row is as long as its history.
    """
    asked = heads.select(
        *keys,
        "position",
        F.col("block_no").alias("_last"),
        "tail",
        F.explode(F.sequence(F.lit(0).cast("bigint"), "block_no")).alias("block_no"),
    )
    met = join_on_same(asked, blocks, [*keys, "block_no"])
    told = F.when(
        F.col("block_no") == F.col("_last"), F.slice("messages", F.lit(1), F.col("tail"))
    ).otherwise(F.col("messages"))
    entry = F.struct("block_no", told.alias("messages"))
    return (
        met.groupBy(*keys, "position")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(*keys, "position", F.flatten(F.col("entries.messages")).alias("messages"))
    )


def chat_history(
    placed: DataFrame, prompts: DataFrame, keys: list[str], block: int = HISTORY_BLOCK
) -> DataFrame:
    """For each chosen prompt all messages up to and including it, as (content, role).

    ``placed`` are messages with positions, ``prompts`` the keys and positions that are asked for.
    A row is as long as its history, whatever that is; for all prompts of long conversations keep
    blocks and heads, as ``chains`` does.
    """
    heads = prompt_heads(prompts.select(*keys, "position"), block)
    return expand_histories(heads, message_blocks(placed, keys, block), keys)


def transcript(placed: DataFrame, keys: list[str], rendered: Column) -> DataFrame:
    """The text of each conversation: its messages in order, separated by a blank line.

    ``placed`` are messages with positions, which by themselves are the transcript as a table.
    """
    entry = F.struct(F.col("position"), rendered.alias("text"))
    return (
        placed.select(*keys, entry.alias("entry"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select(
            *keys,
            F.size("entries").cast("bigint").alias("message_count"),
            F.array_join(F.col("entries.text"), "\n\n").alias("transcript"),
        )
    )


def with_offsets(
    messages: DataFrame, keys: list[str], seq: str, size: ColumnOrName, block: int = OFFSET_BLOCK
) -> DataFrame:
    """Add the position of each message and the total size of the messages before it.

    Two levels: block totals are summed up per conversation, then messages within their block.
    Also adds ``block_no`` and ``lead_size``, the size of a leading system message (null when
    there is none).
    """
    sized = messages.withColumn("size", as_col(size).cast("bigint")).withColumn(
        "block_no", _block(seq, block)
    )
    totals = sized.groupBy(*keys, "block_no").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("size").alias("_size"),
        F.min_by(F.col("role") == "system", F.col(seq)).alias("_opens_with_system"),
        F.min_by("size", seq).alias("_first_size"),
    )
    in_conversation = Window.partitionBy(*keys).orderBy("block_no")
    before = in_conversation.rowsBetween(Window.unboundedPreceding, -1)
    has_lead = F.first("_opens_with_system").over(in_conversation)
    starts = totals.select(
        *keys,
        "block_no",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_size_before"),
        F.when(has_lead, F.first("_first_size").over(in_conversation)).alias("lead_size"),
    )
    in_block = Window.partitionBy(*keys, "block_no").orderBy(seq)
    inner_before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_on_same(sized, starts, [*keys, "block_no"])
        .withColumn("position", F.col("_n_before") + F.row_number().over(in_block) - 1)
        .withColumn(
            "start_offset",
            F.col("_size_before") + F.coalesce(F.sum("size").over(inner_before), F.lit(0)),
        )
        .drop("_n_before", "_size_before")
    )


def truncate_context(
    messages: DataFrame,
    keys: list[str],
    budget: int | ColumnOrName,
    seq: str = "seq",
    size: ColumnOrName | None = None,
    block: int = OFFSET_BLOCK,
    max_budget: int | None = None,
) -> DataFrame:
    """For each user prompt the part of its history that fits into the budget with it.

    The oldest messages go first; a leading system message and the prompt itself always stay, and
    at least one history message is tried. ``over_budget`` marks prompts that never fit. A budget
    column (by model, say) needs ``max_budget``; a prompt with a larger budget raises.

    The first kept message is the first whose start offset reaches a threshold. Thresholds are
    looked up in buckets of one budget's width; the answer lies in the bucket of the threshold or
    the next one, so the first message of each bucket is also listed in the bucket before.
    """
    if isinstance(budget, int):
        width, own_budget = budget, F.lit(budget)
    elif max_budget is not None:
        width = max_budget
        too_large = F.raise_error(F.lit("a budget is above max_budget")).cast("bigint")
        own_budget = F.when(as_col(budget) <= width, as_col(budget)).otherwise(too_large)
    else:
        raise ValueError("a budget column needs max_budget")
    if width < 1:
        raise ValueError("budget must be positive")
    size = F.length("text") if size is None else as_col(size)
    in_block = Window.partitionBy(*keys, "block_no").orderBy(seq)
    placed = with_offsets(
        messages.withColumn("_budget", own_budget.cast("bigint")), keys, seq, size, block
    ).select(
        *keys,
        seq,
        "role",
        "size",
        "position",
        "start_offset",
        "lead_size",
        "_budget",
        F.lag("start_offset").over(in_block).alias("_previous"),
    )
    allowed = F.col("_budget")
    has_lead = F.col("lead_size").isNotNull() & (F.col("position") > 0)
    lead = F.when(has_lead, F.col("lead_size")).otherwise(F.lit(0))
    threshold = F.greatest(
        F.col("start_offset") + F.col("size") + lead - allowed,
        F.coalesce(F.col("lead_size"), F.lit(0)),
    )

    def bucket(offset: Column) -> Column:
        return int_div(offset, width)

    # Each message stands in the list as a candidate; a user prompt stands there once more to ask.
    # Its question is sorted behind the candidates with the same or a larger offset.
    own = bucket(F.col("start_offset"))
    # unknown across a block border, where listing one message more does no harm
    opens_bucket = F.coalesce(bucket(F.col("_previous")) < own, F.lit(True))
    is_lead = F.col("lead_size").isNotNull() & (F.col("position") == 0)
    candidate = [
        F.struct(
            (own - step).alias("bucket"),
            F.col("start_offset").alias("offset"),
            F.lit(0).alias("asks"),
            F.col("position").alias("found"),
        )
        for step in (0, 1)
    ]
    question = F.struct(
        bucket(threshold).alias("bucket"),
        threshold.alias("offset"),
        F.lit(1).alias("asks"),
        F.lit(None).cast("bigint").alias("found"),
    )
    listed = placed.withColumn(
        "_entry",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~is_lead, candidate[0]),
                    F.when(~is_lead & opens_bucket, candidate[1]),
                    F.when(F.col("role") == "user", question),
                )
            )
        ),
    ).select("*", "_entry.*")
    downwards = (
        Window.partitionBy(*keys, "bucket")
        .orderBy(F.desc("offset"), "asks", F.desc("found"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = listed.withColumn(
        "_first_kept", F.last("found", ignorenulls=True).over(downwards)
    ).where("asks = 1")

    fits = (F.col("size") + lead) <= allowed
    first_kept = F.when(fits, F.least(F.col("_first_kept"), F.col("position")))
    has_history = F.col("position") > 0
    # without a system message one history message has to remain
    bare = has_history & ~has_lead & (first_kept == F.col("position"))
    ok = F.coalesce(fits & ~bare, F.lit(False))
    kept = F.col("position") - first_kept + F.when(has_lead, 1).otherwise(0)
    return answered.select(
        *keys,
        seq,
        F.col("position").alias("history_count"),
        has_lead.alias("keeps_system"),
        F.when(ok, first_kept).alias("first_kept_position"),
        F.when(ok, kept).cast("bigint").alias("kept_count"),
        (~ok).alias("over_budget"),
    )


def last_attempts(cycles: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``last_<column>``: the values of the cycle before, null in the first cycle."""
    window = Window.partitionBy(EXPERIMENT).orderBy("cycle_num")
    return cycles.select("*", *[F.lag(F.col(c)).over(window).alias(f"last_{c}") for c in columns])


def until_end(cycles: DataFrame) -> DataFrame:
    """Cycles up to and including the one that ends the experiment: a pass or an exception."""
    earlier = (
        Window.partitionBy(EXPERIMENT)
        .orderBy("cycle_num")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = F.col("exit_stage").isin(*END_STAGES).cast("int")
    return (
        cycles.withColumn("_ended_before", F.coalesce(F.max(ends).over(earlier), F.lit(0)))
        .where("_ended_before = 0")
        .drop("_ended_before")
    )


def phase(cycle_num: ColumnOrName = "cycle_num") -> Column:
    """``init`` in the first cycle, ``retry`` after. Cycles count from 0, so no window is needed."""
    return F.when(as_col(cycle_num) == 0, "init").otherwise("retry")


def state_json(
    agents: list[str], last_code: str, last_compile: str, last_execute: str, passed: Column
) -> Column:
    """A state as a JSON object, from ``phase``, the messages of each agent and the last results."""

    def history(agent: str) -> Column:
        return F.when(
            F.size(F.col(agent)) > 0,
            F.concat(F.lit(f'"{agent}":['), F.array_join(F.col(agent), ","), F.lit("]")),
        )

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))

    def quoted(value: Column) -> Column:
        whole = F.to_json(F.struct(value.alias("v")))
        return F.when(value.isNotNull(), whole.substr(F.lit(6), F.length(whole) - 6))

    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            member("phase", quoted(F.col("phase"))),
            F.concat(
                F.lit('"conversation_histories":{'),
                F.concat_ws(",", *[history(a) for a in agents]),
                F.lit("}"),
            ),
            member("last_attempted_solution_code", quoted(F.col(last_code))),
            member("last_compile_result", F.col(last_compile)),
            member("last_execute_result", F.col(last_execute)),
            member("last_was_testbench_passed", passed.cast("string")),
        ),
        F.lit("}"),
    )


def state_snapshots(
    cycles: DataFrame,
    agents: list[str],
    last_code: str,
    last_compile: str,
    last_execute: str,
) -> DataFrame:
    """State before and after each cycle as JSON objects, ``entry_state`` and ``exit_state``.

    The first cycle starts from the empty state, each other one from the state the last one left.

    ``cycles`` has, per agent, a column of that name with the JSON messages the cycle added (an
    array, null or empty when the agent did not speak); the last_* columns hold the code (text)
    and the two command results (JSON) of the cycle. An agent is listed once it has spoken.
    """
    so_far = (
        Window.partitionBy(EXPERIMENT)
        .orderBy("cycle_num")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    passed = F.col("exit_stage").eqNullSafe(F.lit(PASS_STAGE))
    grown = cycles.select(
        EXPERIMENT,
        "cycle_num",
        F.when(passed, phase()).otherwise("retry").alias("phase"),
        *[F.flatten(F.collect_list(F.col(a)).over(so_far)).alias(a) for a in agents],
        last_code,
        last_compile,
        last_execute,
        passed.alias("last_was_testbench_passed"),
    )

    passed = F.col("last_was_testbench_passed")
    state = state_json(agents, last_code, last_compile, last_execute, passed)
    in_order = Window.partitionBy(EXPERIMENT).orderBy("cycle_num")
    before = F.coalesce(F.lag("exit_state").over(in_order), F.lit(EMPTY_STATE))
    return grown.select(EXPERIMENT, "cycle_num", state.alias("exit_state")).withColumn(
        "entry_state", before
    )
