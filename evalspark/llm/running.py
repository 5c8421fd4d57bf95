"""Running totals within groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.joins import join_on_same
from evalspark.session import fresh_path


def written(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def totals_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: dict[str, Column],
    of_group: DataFrame | None = None,
) -> DataFrame:
    """Adds the columns `values` (name -> what to add up): the totals of the rows before, by `order`.

    Rows are put in order once, in parts that also cut within a group, and written; a total is that
    of the group's earlier parts and of the rows before in the part. `of_group` has one row per group
    with columns to add, which travel with the totals of the parts. Null keys are a group.
    """
    keys = list(keys)
    ordered = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parts = written(ordered, "running")
    sums = parts.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    # a row for each group and part
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    starts = sums.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), zero).alias(f"_start_{n}") for n in values],
    )
    if of_group is not None:
        starts = join_on_same(starts, of_group, keys)
    inner = (
        Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = parts.withColumns(
        {f"_inner_{n}": F.coalesce(F.sum(v).over(inner), zero) for n, v in values.items()}
    )
    added = [c for c in (of_group.columns if of_group is not None else []) if c not in keys]
    return join_on_same(inside, starts, [*keys, "_part"]).select(
        *df.columns,
        *added,
        *[(F.col(f"_start_{n}") + F.col(f"_inner_{n}")).alias(n) for n in values],
    )
