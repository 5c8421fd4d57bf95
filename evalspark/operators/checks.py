"""Input assertions. Each has a report form (a DataFrame) and a raising form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.strings import bind


def assert_columns(df: DataFrame, expected: list[str] | set[str]) -> DataFrame:
    """Check the column set at plan time, without running a job."""
    if set(df.columns) != set(expected):
        missing, extra = set(expected) - set(df.columns), set(df.columns) - set(expected)
        raise ValueError(f"columns differ: missing {sorted(missing)}, extra {sorted(extra)}")
    return df


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once. Reads only the key and counts before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def key_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row on both inputs of a join: row counts, and a key that repeats on either side.

    Reads the key columns only and counts them before its one shuffle by key, so that a key with
    many repeats costs no more than any other. Null keys count as rows but never as repeats.
    """
    both = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_count"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_count"),
        F.min(F.when(F.col("l") > 1, F.col(key))).alias("left_repeat"),
        F.min(F.when(F.col("r") > 1, F.col(key))).alias("right_repeat"),
    )


def row_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: both counts and whether they agree, from one aggregate over both inputs."""
    sides = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sides.agg(
        F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("left_count"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("right_count"),
    ).withColumn("ok", F.col("left_count") == F.col("right_count"))


def assert_row_parity(left: DataFrame, right: DataFrame) -> None:
    counts = row_parity(left, right).first()
    if not counts["ok"]:
        raise ValueError(f"row counts differ: {counts['left_count']} and {counts['right_count']}")


def extraction_ok(extracted: Column, source: Column, ratio: float = 0.75) -> Column:
    """Code was extracted, and is longer than the given share of its source."""
    return bind(
        extracted,
        lambda code: F.coalesce(
            (code != "") & (F.length(code) > F.lit(ratio) * F.length(source)), F.lit(False)
        ),
    )


def name_report(df: DataFrame, column: str = "name") -> DataFrame:
    """How many rows each name has, and whether a lookup by that name would succeed."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.withColumn("ok", F.col("row_count") == 1)


def named_one(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """The single row of that name; none or several raise."""
    found = df.where(F.col(column) == name)
    count = found.limit(2).count()
    if count != 1:
        raise ValueError(f"{'no' if count == 0 else 'more than one'} row named {name!r}")
    return found
