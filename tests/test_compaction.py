"""Incremental compaction: each file once, nothing of a run that ended early, and changed files."""

import pytest

from evalspark.sources import compaction, sinks

ROW = "k string, n bigint"


@pytest.fixture
def log(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    path, target = str(tmp_path / "log"), str(tmp_path / "compact")

    class Log:
        def add(self, rows, fields=ROW):
            sinks.append_jsonl(spark.createDataFrame(rows, fields).coalesce(1), path)

        def run(self):
            return compaction.compact_new(spark, path, schema, target)

        def rows(self):
            found = compaction.read_compacted(spark, target, schema).collect()
            return sorted(((r.k, r.n, r.run, r.unknown_fields) for r in found), key=str)

    made = Log()
    made.path, made.target = path, target
    return made


def test_each_file_is_read_once(log, spark):
    log.add([("a", 1), (None, None)])
    assert log.run() == compaction.Run(1, 1, 2)
    assert log.run() == compaction.Run(None, 0, 0)
    log.add([("b", 2)])
    log.add([("b", 2)])
    assert log.run() == compaction.Run(2, 2, 2)
    assert log.rows() == sorted(
        [("a", 1, 1, None), (None, None, 1, None), ("b", 2, 2, None), ("b", 2, 2, None)], key=str
    )
    listed = compaction.read_manifest(spark, log.target).collect()
    assert len({r.path for r in listed}) == len(listed) == 3 and {r.run_rows for r in listed} == {2}


def test_a_run_that_ended_early_shows_nothing(log, spark, tmp_path):
    log.add([("a", 1)])
    log.run()
    log.add([("b", 2)])
    # rows of a second run are there, its manifest is not
    spark.createDataFrame([("half", 0)], ROW).write.parquet(f"{log.target}/data/run=2")
    assert log.rows() == [("a", 1, 1, None)]
    assert log.run().number == 2
    assert log.rows() == [("a", 1, 1, None), ("b", 2, 2, None)]


def test_broken_lines_publish_nothing(log, tmp_path):
    log.add([("a", 1)])
    log.run()
    (tmp_path / "log" / "part-broken.json").write_text('{"k": "x", "n":\n')
    with pytest.raises(Exception):
        log.run()
    assert log.rows() == [("a", 1, 1, None)]


def test_changed_and_removed_files(log, tmp_path):
    log.add([("a", 1)])
    log.run()
    log.add([("b", 2)])
    first, = [p for p in (tmp_path / "log").glob("part-*.json") if '"a"' in p.read_text()]
    text = first.read_text()
    first.write_text(text + text)
    with pytest.raises(ValueError, match="changed"):
        log.run()


def test_unknown_fields_and_empty_files(log, tmp_path):
    log.add([("a", 1, "more")], ROW + ", extra string")
    (tmp_path / "log" / "part-empty.json").write_text("")
    assert log.run() == compaction.Run(1, 1, 1)
    assert log.rows() == [("a", 1, 1, {"extra": "more"})]


def test_a_missing_log(log):
    with pytest.raises(Exception):
        log.run()
    assert log.rows() == []
