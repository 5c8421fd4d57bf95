"""Live outcome counts over a growing log of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.summary import MODEL_KEYS


def stream_log(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def live_stage_counts(log: DataFrame, stage: str) -> DataFrame:
    """Running counts; the state has one row per model and stage."""
    return log.groupBy(*MODEL_KEYS, stage).agg(F.count(F.lit(1)).alias("count"))


def drain_counts(log: DataFrame, stage: str, checkpoint: str, target: str) -> DataFrame:
    """Count what is in the log now; the complete result is the Parquet table at ``target``.

    Progress and state are in the checkpoint folder, so a restart neither loses nor recounts rows.
    A batch replaces the table, so one that is run again after a failure does no harm.
    """

    def replace(counts: DataFrame, _: int) -> None:
        counts.write.mode("overwrite").parquet(target)

    query = (
        live_stage_counts(log, stage)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return log.sparkSession.read.parquet(target)
