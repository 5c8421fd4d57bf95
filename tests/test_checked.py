"""Checks that ride along with a write."""

import pytest
from pyspark.sql import functions as F

from evalspark.sources.checked import read_checked, read_report, write_checked

SCHEMA = "id bigint, v int, _rule string"
ROWS = [(10, 5, "a"), (9, -1, None), (2, None, "b"), (None, -3, "c"), (3, 7, "d"), (3, 7, "d"), (11, 0, "e")]


def rules(**named):
    return {name: F.expr(rule) for name, rule in named.items()}


def keep():
    return rules(has_value="v is not null")


def some():
    return rules(positive="v > 0", small="v < 7")


def report_of(report):
    return {r.rule: (r.row_count, r.failed_count, r.first_failed) for r in report.collect()}


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_counts_are_those_of_the_rows(spark, df, tmp_path):
    report = write_checked(df, str(tmp_path / "t"), some(), "id", keep(), columns=["id", "v", "_rule"], row_count=6)
    assert report_of(report) == {
        "rows": (7, 0, None),
        "written": (6, 0, None),
        "has_value": (7, 1, "2"),
        "positive": (6, 3, "9"),  # by number, and a null key is counted
        "small": (6, 2, "3"),
    }
    found = read_checked(spark, str(tmp_path / "t"))
    assert found.columns == df.columns
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in df.collect() if r.v is not None)


@pytest.mark.parametrize("wrong", [{"row_count": 7}, {"must_hold": ("positive",)}, {"must_hold": ("has_value",)}])
def test_a_failed_check_publishes_nothing(spark, df, tmp_path, wrong):
    path = str(tmp_path / "t")
    write_checked(df, path, some(), "id", keep())
    with pytest.raises(ValueError, match="rows"):
        write_checked(df, path, some(), "id", keep(), **wrong)
    with pytest.raises(ValueError, match="no checked table"):
        read_checked(spark, path)
    write_checked(df, path, some(), "id", keep(), must_hold=())
    assert read_checked(spark, path).count() == 6


def test_a_job_that_fails_publishes_nothing(spark, df, tmp_path):
    path = str(tmp_path / "t")
    write_checked(df, path, some(), "id")
    late = df.withColumn("v", F.when(F.col("id") == 11, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        write_checked(late.withColumn("v", F.col("v").cast("int")), path, some(), "id")
    with pytest.raises(ValueError, match="no checked table"):
        read_checked(spark, path)


def test_names_and_columns(spark, df, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="columns differ"):
        write_checked(df, path, some(), "id", columns=["id"])
    with pytest.raises(ValueError, match="repeated"):
        write_checked(df, path, some(), "id", some())
    with pytest.raises(ValueError, match="unknown"):
        write_checked(df, path, some(), "id", must_hold=("other",))
    assert read_report(spark, path).count() == 0


def test_empty_and_without_rules(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    report = write_checked(empty, str(tmp_path / "t"), some(), "id", keep(), row_count=0)
    assert report_of(report)["positive"] == (0, 0, None)
    assert read_checked(spark, str(tmp_path / "t")).count() == 0
    full = spark.createDataFrame(ROWS, SCHEMA)
    assert report_of(write_checked(full, str(tmp_path / "u"), {}, "id"))["written"] == (7, 0, None)


def test_one_job_reads_the_rows_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(1000).selectExpr("id", "cast(id as int) as v").mapInArrow(counting, "id bigint, v int")
    write_checked(df, str(tmp_path / "t"), some(), "id", keep())
    assert read.value == 1000
