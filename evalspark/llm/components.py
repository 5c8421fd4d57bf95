"""Connected components of a graph that is given as a table of links.

Alternating large-star and small-star steps: every node links its larger neighbours, then its
smaller ones, to the smallest it knows, until each component is a star. The minimum per node is a
partial aggregate, the rest are joins on node ids, so a node with very many links is no special case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import fresh_path


def _write(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _are_stars(links: DataFrame) -> bool:
    """Whether every node either has one link to a smaller node or is itself such an end."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("end"))
    ends = ends.unionAll(links.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("end").alias("end"))
    return seen.where("up + end > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link to another; links are columns `u`, `v` (bigint).

    `component` is the smallest node that can be reached. Nulls and links of a node with itself are
    ignored; an empty table gives an empty one.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = _write(
        links.where("u is not null and v is not null and u != v").select(high, low).distinct(),
        "links",
    )
    while not _are_stars(links):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        )
        large = _write(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            large.join(least, "u")
            .where("v != least")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionAll(least.select("u", F.col("least").alias("v")))
            .distinct()
        )
        links = _write(small, "links")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    own = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionAll(own)
