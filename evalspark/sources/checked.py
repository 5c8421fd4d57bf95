"""Writes that check what they write, in one pass.

The counts of the checks are observed by the job that writes; no row is read a second time for them.
A checked table is a folder with ``data`` and, written last, ``report``: a table whose report is not
there was not finished, or a check that must hold has failed, and readers do not see it. The rows are
observed where they are written, with no shuffle between, so a task that runs again counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.checks import assert_columns
from evalspark.sources.readers import read_if_there

REPORT = "rule string, row_count bigint, failed_count bigint, first_failed string"


def write_checked(
    df: DataFrame,
    path: str,
    rules: dict[str, Column],
    key: str,
    keep: dict[str, Column] | None = None,
    columns: list[str] | None = None,
    row_count: int | None = None,
    must_hold: tuple[str, ...] = (),
) -> DataFrame:
    """Write ``df`` and give the report: a row per rule with the rows looked at and those that fail.

    ``keep`` are rules that drop the rows they fail for, as they fail them first; ``rules`` are
    looked at for the rows that remain, and drop none. A rule that is null fails. ``first_failed``
    is the smallest ``key`` of a failing row, as text; null keys are counted but not named.
    ``columns`` is the expected column set, ``row_count`` the expected number of rows written, and
    ``must_hold`` names rules; if one of these does not agree, ValueError is raised and what was
    written stays unpublished. A table that is written again is unpublished until it is whole.
    """
    keep = keep or {}
    both = set(keep) & set(rules)
    unknown = set(must_hold) - set(keep) - set(rules)
    if both or unknown or {"rows", "written"} & (set(keep) | set(rules)):
        raise ValueError(f"rule names: repeated {sorted(both)}, unknown {sorted(unknown)}")
    if columns is not None:
        assert_columns(df, columns)
    spark = df.sparkSession
    # readers lose the old table before its rows go
    spark.createDataFrame([], REPORT).coalesce(1).write.mode("overwrite").parquet(f"{path}/report")

    flags = {name: F.coalesce(rule, F.lit(False)) for name, rule in (keep | rules).items()}
    prefix = "_rule"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    places = {name: f"{prefix}{i}" for i, name in enumerate(flags)}
    flagged = df.select("*", *[flags[n].alias(p) for n, p in places.items()])
    named, rest = F.col(f"`{key}`").cast("string"), F.lit(True)
    seen = []
    for name, place in places.items():
        looked_at, fails = rest, rest & ~F.col(place)
        order = F.when(fails, F.col(f"`{key}`"))
        seen += [
            F.count(F.when(looked_at, 1)).alias(f"{place}_rows"),
            F.count(F.when(fails, 1)).alias(f"{place}_failed"),
            F.min(F.when(order.isNotNull(), F.struct(order.alias("k"), named.alias("s")))).alias(
                f"{place}_first"
            ),
        ]
        if name in keep:
            rest = rest & F.col(place)
    observation = Observation()
    observed = flagged.observe(
        observation, F.count(F.when(rest, 1)).alias("written"), F.count(F.lit(1)).alias("rows"), *seen
    )
    observed.where(rest).drop(*places.values()).write.mode("overwrite").parquet(f"{path}/data")
    counts = observation.get
    report = [("rows", counts["rows"], 0, None), ("written", counts["written"], 0, None)]
    for name, place in places.items():
        first = counts[f"{place}_first"]
        report.append(
            (name, counts[f"{place}_rows"], counts[f"{place}_failed"], first and first["s"])
        )
    broken = [f"{n}: {k} rows, first {f}" for n, _, k, f in report if n in must_hold and k]
    if row_count is not None and counts["written"] != row_count:
        broken.append(f"{counts['written']} rows instead of {row_count}")
    if broken:
        raise ValueError("; ".join(broken))
    published = spark.createDataFrame(report, REPORT)
    published.coalesce(1).write.mode("overwrite").parquet(f"{path}/report")
    return read_report(spark, path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return read_if_there(spark, f"{path}/report", REPORT)


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table whose checks held."""
    if read_report(spark, path).isEmpty():
        raise ValueError(f"no checked table at {path}")
    return spark.read.parquet(f"{path}/data")
