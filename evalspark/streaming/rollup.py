"""Live roll-up of a growing log of cycles: experiments close as soon as they end.

Each experiment has a small state, its last cycle and whether it has ended. Its first pass or
exception closes it with one row. What is logged for it afterwards is reported as late and changes
nothing. An experiment that is not heard of for some time is reported with what is known, and its
state goes, as does that of closed experiments.

A batch of the stream is one shuffle in DataFrame operations: its cycles are sorted behind the
states of their experiments, and running aggregates say what each cycle means and what the state is
then. States are a table of changes in the checkpoint folder, a part for each batch; every
``WHOLE``-th part has the states of all experiments, and older parts are not read any more.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.joins import EXPERIMENT
from evalspark.operators.summary import MODEL_KEYS
from evalspark.schemas import END_STAGES

CLOSED, LATE, EXPIRED = "closed", "late", "expired"
DAY_MS = 86_400_000
#: Batches from one whole table of states to the next.
WHOLE = 32
_CYCLE = [
    T.StructField("cycle_num", T.LongType()),
    T.StructField("exit_stage", T.StringType()),
    *[T.StructField(k, T.StringType()) for k in MODEL_KEYS],
]
_STATE = T.StructType(
    [*_CYCLE, T.StructField("ended", T.BooleanType()), T.StructField("seen_ms", T.LongType())]
)
#: A part has what a batch reports and the states that it changes. A row without an experiment has
#: the time of the batch.
_PART = T.StructType(
    [
        T.StructField(EXPERIMENT, T.StringType()),
        *_CYCLE,
        T.StructField("kind", T.StringType()),
        T.StructField("state", _STATE),
    ]
)
_REPORT = T.StructType(
    [
        T.StructField(EXPERIMENT, T.StringType()),
        *[T.StructField(k, T.StringType()) for k in MODEL_KEYS],
        T.StructField("kind", T.StringType()),
        T.StructField("cycle_num", T.LongType()),
        T.StructField("exit_stage", T.StringType()),
        T.StructField("used_cycle_count", T.LongType()),
    ]
)


def cycles_of(log: DataFrame) -> DataFrame:
    """The cycles of a log. A null stage counts as "end"; rows without a key or number are left out."""
    return log.where(F.col(EXPERIMENT).isNotNull() & F.col("cycle_num").isNotNull()).select(
        EXPERIMENT,
        F.col("cycle_num").cast("bigint").alias("cycle_num"),
        F.coalesce(F.col("exit_stage"), F.lit("end")).alias("exit_stage"),
        *MODEL_KEYS,
    )


def advance(
    states: DataFrame, cycles: DataFrame, now_ms: int, idle_ms: int, whole: bool = False
) -> DataFrame:
    """The part of a batch: its cycles, and experiments that are due, with their kind and new state.

    Cycles are taken in the order of their numbers, those that end an experiment behind others of
    the same number. With ``whole`` the states that did not change come too.
    """
    cycle = [f.name for f in _CYCLE]
    new = cycles.select(
        EXPERIMENT,
        *cycle,
        F.col("exit_stage").isin(*END_STAGES).alias("ended"),
        F.lit(None).cast("bigint").alias("seen_ms"),
    )
    in_order = Window.partitionBy(EXPERIMENT).orderBy(
        F.asc_nulls_last("seen_ms"), "cycle_num", "ended", "exit_stage", *MODEL_KEYS
    )
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    taken = states.select(EXPERIMENT, *cycle, "ended", "seen_ms").unionByName(new).select(
        "*",
        F.coalesce(F.max("ended").over(before), F.lit(False)).alias("ended_before"),
        F.lead(F.lit(True)).over(in_order).isNull().alias("is_last"),
        F.first(F.when(F.col("ended"), F.struct(*cycle)), ignorenulls=True).over(so_far).alias("end"),
        F.max(F.struct(*cycle)).over(so_far).alias("furthest"),
    )
    is_new = F.col("seen_ms").isNull()
    due = F.col("is_last") & (F.col("seen_ms") + idle_ms <= now_ms)
    kept = F.col("is_last") & (is_new | (F.lit(whole) & ~due))
    last = F.coalesce("end", "furthest")
    kind = F.when(is_new & F.col("ended_before"), LATE).when(is_new & F.col("ended"), CLOSED)
    state = F.struct(
        *[last[c].alias(c) for c in cycle],
        F.col("end").isNotNull().alias("ended"),
        F.coalesce("seen_ms", F.lit(now_ms)).alias("seen_ms"),
    )
    return taken.select(
        EXPERIMENT,
        *cycle,
        kind.when(due & ~F.col("ended"), EXPIRED).alias("kind"),
        F.when(kept, state).alias("state"),
    ).where("kind is not null or state is not null")


def _report(part: DataFrame) -> DataFrame:
    normal = F.col("exit_stage") != "exception"
    counted = normal & (F.col("kind") != LATE)
    return part.where("kind is not null").select(
        EXPERIMENT,
        *[F.when(normal, F.col(k)).alias(k) for k in MODEL_KEYS],
        "kind",
        "cycle_num",
        "exit_stage",
        F.when(counted, F.col("cycle_num") + 1).alias("used_cycle_count"),
    )


def take_batch(cycles: DataFrame, batch: int, checkpoint: str, target: str, idle_ms: int) -> None:
    """Take in the cycles of one batch. One that is run again replaces what it wrote."""
    spark = cycles.sparkSession

    def part(*batches: int) -> DataFrame:
        return spark.read.schema(_PART).parquet(*[f"{checkpoint}/parts/{b}" for b in batches])

    now_ms, gone_ms = int(time.time() * 1000), 0
    known = spark.createDataFrame([], _PART)
    if batch > 0:
        known = part(*range((batch - 1) // WHOLE * WHOLE, batch))
        last_ms = part(batch - 1).where(F.col(EXPERIMENT).isNull()).first()["state"]["seen_ms"]
        # what was due in the last batch is gone; no two batches are of the same time
        now_ms, gone_ms = max(now_ms, last_ms + 1), last_ms - idle_ms
    states = known.where(F.col(EXPERIMENT).isNotNull()).select(EXPERIMENT, "state.*")
    states = states.where(F.col("seen_ms") > gone_ms)
    clock = spark.createDataFrame([(None,) * 6 + ((None,) * 5 + (now_ms,),)], _PART)
    advanced = advance(states, cycles, now_ms, idle_ms, whole=batch % WHOLE == 0)
    advanced.unionByName(clock).write.mode("overwrite").parquet(f"{checkpoint}/parts/{batch}")
    _report(part(batch)).write.mode("overwrite").parquet(f"{target}/batch={batch}")


def live_rollup(
    log: DataFrame, checkpoint: str, target: str, idle_ms: int = DAY_MS, **trigger
) -> StreamingQuery:
    """Start to report on a stream of cycles: closed and expired experiments, and late cycles.

    ``read_reports`` reads what it wrote to ``target``. As in the batch roll-up, a null stage counts
    as "end" and an experiment that ended by an exception has neither model nor count. Rows without
    an experiment or a cycle number are left out. What has expired starts anew if it is heard of
    again. ``trigger`` is that of the stream.
    """
    return (
        cycles_of(log)
        .writeStream.foreachBatch(lambda df, batch: take_batch(df, batch, checkpoint, target, idle_ms))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_reports(spark: SparkSession, target: str) -> DataFrame:
    batches = T.StructType([*_REPORT, T.StructField("batch", T.LongType())])
    return spark.read.schema(batches).parquet(target).drop("batch")


def drain_rollup(log: DataFrame, checkpoint: str, target: str, idle_ms: int = DAY_MS) -> DataFrame:
    """Take in what is in the log now; all events so far are the Parquet table at ``target``.

    State and progress are in the checkpoint folder: a restart neither loses nor repeats an event.
    Experiments that are due are reported with the next rows that arrive.
    """
    live_rollup(log, checkpoint, target, idle_ms).awaitTermination()
    return read_reports(log.sparkSession, target)
