"""Histories of all prompts of growing conversations, in space that grows with the messages.

A chain is a folder with two tables. ``blocks`` holds every message once, in blocks of consecutive
messages that are written and never changed; ``heads`` has a row per prompt with the block in which
its history ends and how much of that block belongs to it. A history is put together only for the
heads that are asked for.

Messages come in batches with rising numbers, as conversations go on. A batch has its own partition
of both tables and replaces it when it is run again, blocks first; so a run that ended early is
simply repeated. Only counts are read of what is already there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.history import (
    HISTORY_BLOCK,
    expand_histories,
    message_blocks,
    prompt_heads,
    with_positions,
)
from evalspark.operators.joins import join_on_same
from evalspark.sources.readers import read_if_there

_MESSAGES = "array<struct<content:string,role:string>>"


def _schemas(key_fields: list[T.StructField]) -> dict[str, T.StructType]:
    def table(rest: str) -> T.StructType:
        return T.StructType([*key_fields, *T.StructType.fromDDL(rest).fields])

    return {
        "blocks": table(
            f"block_no bigint, block_size int, block_chars bigint, messages {_MESSAGES}, batch bigint"
        ),
        "heads": table("position bigint, block_no bigint, tail int, tail_chars bigint, batch bigint"),
    }


class HistoryChain:
    """The chain in ``folder``; ``key_fields`` are the columns that identify a conversation."""

    def __init__(self, folder: str, key_fields: list[T.StructField], block: int = HISTORY_BLOCK):
        self.folder, self.block = folder.rstrip("/"), block
        self.keys = [f.name for f in key_fields]
        self.schemas = _schemas(key_fields)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        columns = [c for c in self.schemas[name].names if c != "batch"]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return read_if_there(spark, f"{self.folder}/{name}", self.schemas[name])

    def append(
        self, messages: DataFrame, batch: int, timestamp: str = "timestamp", seq: str = "seq"
    ) -> None:
        """Add a batch of messages that follow those of the batches with smaller numbers.

        ``messages`` has the keys, a time, a number that breaks ties, role and text; user messages
        are prompts. Running the last batch again replaces it; an earlier one cannot be run again.
        """
        spark, keys = messages.sparkSession, self.keys
        earlier = self._read(spark, "blocks")
        if not earlier.where(F.col("batch") > batch).isEmpty():
            raise ValueError(f"there are batches after {batch}")
        before = earlier.where(F.col("batch") < batch).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_blocks"), F.sum("block_size").alias("_messages")
        )
        placed = with_positions(messages, keys, timestamp, seq)  # numbers within the batch
        blocks = message_blocks(placed, keys, self.block)
        chars = F.aggregate(
            "messages",
            F.lit(0).cast("bigint"),
            lambda total, m: total + F.coalesce(F.length(m["content"]), F.lit(0)),
        )
        block_no = F.col("block_no") + F.coalesce("_blocks", F.lit(0))
        numbered = join_on_same(blocks.withColumn("block_chars", chars), before, keys, "left")
        self._write(numbered.withColumn("block_no", block_no), "blocks", batch)

        in_block = Window.partitionBy(*keys, "block_no").orderBy("position")
        length = F.coalesce(F.length("text"), F.lit(0))
        heads = (
            prompt_heads(placed, self.block)
            .select(
                *keys,
                "position",
                "block_no",
                "tail",
                F.sum(length).over(in_block).alias("tail_chars"),
                "role",
            )
            .where("role = 'user'")
        )
        position = F.col("position") + F.coalesce("_messages", F.lit(0))
        numbered = join_on_same(heads, before, keys, "left")
        self._write(
            numbered.withColumns({"block_no": block_no, "position": position}), "heads", batch
        )

    def blocks(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "blocks")

    def heads(self, spark: SparkSession) -> DataFrame:
        """All prompts: the keys, ``position``, ``block_no``, ``tail`` and the batch they came with."""
        return self._read(spark, "heads")

    def histories(self, asked: DataFrame) -> DataFrame:
        """The whole history of some heads: the keys, ``position`` and ``messages``."""
        blocks = self.blocks(asked.sparkSession).select(*self.keys, "block_no", "messages")
        return expand_histories(asked, blocks, self.keys)

    def last_heads(self, spark: SparkSession) -> DataFrame:
        """The last prompt of each conversation."""
        fields = F.struct("position", "block_no", "tail")
        return (
            self.heads(spark).groupBy(*self.keys).agg(F.max(fields).alias("_head"))
            .select(*self.keys, "_head.*")
        )

    def sizes(self, spark: SparkSession) -> DataFrame:
        """``message_count`` and ``char_count`` of the history of every prompt; no text is read."""
        in_order = Window.partitionBy(*self.keys).orderBy("block_no")
        before = in_order.rowsBetween(Window.unboundedPreceding, -1)
        totals = self.blocks(spark).select(
            *self.keys,
            "block_no",
            F.coalesce(F.sum("block_chars").over(before), F.lit(0)).alias("_before"),
        )
        return join_on_same(self.heads(spark), totals, [*self.keys, "block_no"]).select(
            *self.keys,
            "position",
            (F.col("position") + 1).alias("message_count"),
            (F.col("_before") + F.col("tail_chars")).alias("char_count"),
        )
