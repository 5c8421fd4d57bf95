"""Incremental compaction of a growing JSON-lines log.

A log is a folder to which whole files are added. Its compacted form is a folder with a Parquet table
``data`` and a ``manifest``, both with a part for each run. A run takes the files that no manifest
lists, writes their rows, and lists them in a manifest of one file as its last step. Readers see the
data of listed runs only, so a run that ended early shows nothing and is written over by the next.
Each file is read by one run, however often the log is compacted. One run at a time, please.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.sources.readers import read_if_there, read_jsonl

MANIFEST = "path string, length bigint, run_rows bigint, run bigint"
UNKNOWN_FIELDS = "unknown_fields"


@dataclass(frozen=True)
class Run:
    """What a run has done; ``number`` is None if there was nothing new."""

    number: int | None
    files: int
    rows: int


def log_files(spark: SparkSession, log: str) -> DataFrame:
    """(path, length) of the files of a log; their content is not read."""
    return spark.read.format("binaryFile").load(log).select("path", "length")


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    return read_if_there(spark, f"{target}/manifest", MANIFEST)


def compact_new(
    spark: SparkSession, log: str, schema: T.StructType, target: str, partitions: int | None = None
) -> Run:
    """Take in the files that were added since the last run; a missing log raises.

    A listed file that is gone is no concern, one that has another length raises: its rows are in
    ``data`` as they were. Broken lines raise, and nothing is published; fields that the schema does
    not have are kept in the map column ``unknown_fields``. Spark leaves empty files out; they are
    neither read nor listed.
    """
    known = read_manifest(spark, target)
    files = log_files(spark, log)
    changed = (
        files.join(known.withColumnRenamed("length", "_listed"), "path")
        .where("length <> _listed")
        .select("path")
        .first()
    )
    if changed is not None:
        raise ValueError(f"a file has changed since it was taken in: {changed.path}")
    # the driver has listed these paths to plan the scan of the log; they are what it reads next
    new = files.join(known.select("path"), "path", "left_anti").collect()
    if not new:
        return Run(None, 0, 0)
    number = (known.agg(F.max("run")).first()[0] or 0) + 1
    seen = Observation()
    rows = read_jsonl(spark, [f.path for f in new], schema, rest=UNKNOWN_FIELDS)
    rows = rows if partitions is None else rows.coalesce(partitions)
    # counted by the job that writes
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").parquet(f"{target}/data/run={number}")
    n = seen.get["rows"]
    listed = [(f.path, f.length, n) for f in new]
    one = spark.createDataFrame(listed, "path string, length bigint, run_rows bigint").coalesce(1)
    one.write.mode("overwrite").parquet(f"{target}/manifest/run={number}")
    return Run(number, len(new), n)


def read_compacted(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of all published runs, with ``unknown_fields`` and the number of the ``run``."""
    fields = T.StructType(
        [
            *schema.fields,
            T.StructField(UNKNOWN_FIELDS, T.MapType(T.StringType(), T.StringType())),
            T.StructField("run", T.LongType()),
        ]
    )
    runs = [r.run for r in read_manifest(spark, target).select("run").distinct().collect()]
    data = read_if_there(spark, f"{target}/data", fields)
    return data.where(F.col("run").isin(runs) if runs else F.lit(False))
