"""States of experiments as a log of changes, in space that grows with the messages.

The state after a cycle holds all messages so far, so one whole state per cycle is quadratic in the
cycles. A log is a folder with two tables instead. ``changes`` has a row per cycle: what the cycle
added, its code and results, and ``base_cycle``, the last cycle before or at it with a whole state.
``fulls`` has the messages of whole states, one for each doubling of an experiment's message count.
All whole states of an experiment together hold at most four times its messages, and a state is
restored from one whole state and at most as many messages after it.

Cycles come in batches that follow each other. A batch has its own partition of both tables and
replaces it when it is run again; whole states are written before the changes that lead to them, so
a run that ended early is simply repeated. Of earlier batches counts are read, and messages only
where a new whole state needs them. A cycle that is logged twice, that does not follow the earlier
ones or has no number raises. Null experiments are one experiment, a null or empty list of messages
adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.history import phase, state_json
from evalspark.operators.joins import EXPERIMENT, join_on_same
from evalspark.schemas import PASS_STAGE
from evalspark.sources.readers import read_if_there

#: Base of cycles before the first message.
NO_BASE = -1


def _bits(count: Column) -> Column:
    """Binary digits of a count, 0 for 0."""
    return F.when(count > 0, F.length(F.bin(count))).otherwise(0)


class StateLog:
    """The log in ``folder`` for messages of ``agents``; ``experiment`` is the type of the key."""

    def __init__(
        self, folder: str, agents: list[str], experiment: T.DataType = T.StringType()
    ) -> None:
        self.folder, self.agents = folder.rstrip("/"), agents
        key = T.StructField(EXPERIMENT, experiment)
        said = ", ".join(f"`{a}` array<string>" for a in agents)

        def table(rest: str) -> T.StructType:
            return T.StructType([key, *T.StructType.fromDDL(rest).fields])

        self.schemas = {
            "changes": table(
                f"cycle_num bigint, base_cycle bigint, n_messages bigint, {said}, phase string, "
                "code string, compiled string, executed string, passed boolean, batch bigint"
            ),
            "fulls": table(f"cycle_num bigint, {said}, batch bigint"),
        }

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        columns = [c for c in self.schemas[name].names if c != "batch"]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return read_if_there(spark, f"{self.folder}/{name}", self.schemas[name])

    def changes(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "changes")

    def fulls(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "fulls")

    def append(
        self, cycles: DataFrame, batch: int, code: str, compiled: str, executed: str
    ) -> None:
        """Add the cycles of a batch; running the last batch again replaces it.

        ``cycles`` has experiment, ``cycle_num``, ``exit_stage``, per agent the JSON messages that
        the cycle added, the code (text) and the two command results (JSON).
        """
        spark = cycles.sparkSession
        earlier = self.changes(spark)
        if not earlier.where(F.col("batch") > batch).isEmpty():
            raise ValueError(f"there are batches after {batch}")
        earlier = earlier.where(F.col("batch") < batch)
        ends = earlier.groupBy(EXPERIMENT).agg(
            F.sum("n_messages").alias("_messages"),
            F.max("cycle_num").alias("_last_cycle"),
            F.max("base_cycle").alias("_base"),
        )
        passed = F.col("exit_stage").eqNullSafe(F.lit(PASS_STAGE))
        none = F.array().cast("array<string>")
        added = cycles.select(
            EXPERIMENT,
            F.col("cycle_num").cast("bigint").alias("cycle_num"),
            *[F.coalesce(F.col(a), none).alias(a) for a in self.agents],
            F.when(passed, phase()).otherwise("retry").alias("phase"),
            F.col(code).alias("code"),
            F.col(compiled).alias("compiled"),
            F.col(executed).alias("executed"),
            passed.alias("passed"),
        )
        n_messages = sum((F.size(a) for a in self.agents), F.lit(0)).cast("bigint")
        # the places of cycles come from numbers alone; no text goes through the window
        in_order = Window.partitionBy(EXPERIMENT).orderBy("cycle_num")
        counted = join_on_same(
            added.select(EXPERIMENT, "cycle_num", n_messages.alias("n_messages")),
            ends,
            [EXPERIMENT],
            "left",
        )
        before = F.coalesce(F.lag("cycle_num").over(in_order), F.col("_last_cycle"))
        after = F.coalesce("_messages", F.lit(0)) + F.sum("n_messages").over(
            in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        wrong = F.col("cycle_num").isNull() | (before >= F.col("cycle_num"))
        message = F.concat(
            F.lit("cycle "),
            F.coalesce(F.col("cycle_num").cast("string"), F.lit("null")),
            F.lit(" does not follow the cycle before"),
        )
        numbered = counted.select(
            EXPERIMENT,
            F.when(wrong, F.raise_error(message)).otherwise(F.col("cycle_num")).alias("cycle_num"),
            "n_messages",
            (_bits(after) > _bits(after - F.col("n_messages"))).alias("is_full"),
            "_base",
        )
        base = F.last(F.when(F.col("is_full"), F.col("cycle_num")), ignorenulls=True).over(in_order)
        places = numbered.select(
            EXPERIMENT,
            "cycle_num",
            "n_messages",
            F.coalesce(base, "_base", F.lit(NO_BASE)).alias("base_cycle"),
        )
        # fixed first, as both tables are made from it
        pending = f"{self.folder}/pending"
        columns = [c for c in self.schemas["changes"].names if c != "batch"]
        joined = join_on_same(added, places, [EXPERIMENT, "cycle_num"])
        joined.select(*columns).write.mode("overwrite").parquet(pending)
        new = spark.read.schema(self.schemas["changes"]).parquet(pending)
        whole = self.fulls(spark).where(F.col("batch") < batch)
        self._write(self._new_fulls(new, earlier, whole), "fulls", batch)
        self._write(new, "changes", batch)

    def _new_fulls(self, new: DataFrame, earlier: DataFrame, whole: DataFrame) -> DataFrame:
        """The messages at the cycles of `new` that are their own base."""
        wanted = new.where("cycle_num = base_cycle").select(
            EXPERIMENT, F.col("cycle_num").alias("_full")
        )
        # earlier messages: the last whole state of the experiment and the changes after it
        touched = wanted.select(EXPERIMENT).distinct()
        last_base = join_on_same(
            earlier.groupBy(EXPERIMENT).agg(F.max("base_cycle").alias("base_cycle")),
            touched,
            [EXPERIMENT],
        )
        last_base = last_base.where(F.col("base_cycle") > NO_BASE)
        pieces = self._pieces(last_base, earlier, whole)
        told = pieces.select(EXPERIMENT, "_at", *self.agents).unionAll(
            new.where("n_messages > 0").select(
                EXPERIMENT, F.col("cycle_num").alias("_at"), *self.agents
            )
        )
        meeting = join_on_same(told, wanted, [EXPERIMENT]).where("_at <= _full")
        return self._together(meeting, [EXPERIMENT, "_full"]).withColumnRenamed(
            "_full", "cycle_num"
        )

    def _pieces(self, based: DataFrame, changes: DataFrame, fulls: DataFrame) -> DataFrame:
        """`based` with the messages of each row's whole state and of the changes after it.

        ``_at`` is the cycle of a piece. Changes after a whole state share its ``base_cycle``, so
        both are plain joins on equal keys.
        """
        keys = [EXPERIMENT, "base_cycle"]
        whole = fulls.select(
            EXPERIMENT,
            F.col("cycle_num").alias("base_cycle"),
            F.col("cycle_num").alias("_at"),
            *self.agents,
        )
        after = changes.where("cycle_num > base_cycle and n_messages > 0").select(
            *keys, F.col("cycle_num").alias("_at"), *self.agents
        )
        return join_on_same(based, whole.unionAll(after), keys)

    def _together(self, pieces: DataFrame, keys: list[str]) -> DataFrame:
        """One row per key with the messages of its pieces, in the order of their cycles."""
        parts = F.array_sort(F.collect_list(F.struct("_at", *self.agents)))
        grouped = pieces.groupBy(*keys).agg(parts.alias("_parts"))
        return grouped.select(
            *keys, *[F.flatten(F.col("_parts")[a]).alias(a) for a in self.agents]
        )

    def restore(self, asked: DataFrame) -> DataFrame:
        """The state after each of the cycles in `asked` (experiment, ``cycle_num``).

        Columns: the two keys, the messages of every agent so far, ``phase``, ``code``,
        ``compiled``, ``executed``, ``passed``. Cycles that the log does not have give no row.
        """
        spark = asked.sparkSession
        keys = [EXPERIMENT, "cycle_num"]
        changes = self.changes(spark)
        wanted = asked.select(EXPERIMENT, F.col("cycle_num").cast("bigint").alias("cycle_num"))
        rows = join_on_same(
            changes.select(
                *keys, "base_cycle", "phase", "code", "compiled", "executed", "passed"
            ),
            wanted.distinct(),
            keys,
        )
        based = rows.select(*keys, "base_cycle").where(F.col("base_cycle") > NO_BASE)
        pieces = self._pieces(based, changes, self.fulls(spark)).where("_at <= cycle_num")
        found = join_on_same(rows, self._together(pieces, keys), keys, "left")
        none = F.array().cast("array<string>")
        return found.select(
            *keys,
            *[F.coalesce(F.col(a), none).alias(a) for a in self.agents],
            "phase",
            "code",
            "compiled",
            "executed",
            "passed",
        )

    def last_cycles(self, spark: SparkSession) -> DataFrame:
        """The last cycle of each experiment; no message is read."""
        return self.changes(spark).groupBy(EXPERIMENT).agg(F.max("cycle_num").alias("cycle_num"))

    def as_json(self, restored: DataFrame) -> DataFrame:
        """Restored states as JSON objects in ``exit_state``."""
        state = state_json(self.agents, "code", "compiled", "executed", F.col("passed"))
        return restored.select(EXPERIMENT, "cycle_num", state.alias("exit_state"))
