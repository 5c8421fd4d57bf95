"""New fields, conflicts and broken rows of a log, against a plain version."""

import json
import random
from collections import defaultdict

from pyspark.sql import types as T

from evalspark.sources.drift import schema_drift

SCHEMA = (
    "a bigint, b struct<x: string, y: array<double>>, c array<struct<z: boolean>>, d map<string,bigint>,"
    " t timestamp, `odd.name` string, gone boolean"
)


def report(spark, rows, key="int", **options):
    df = spark.createDataFrame(rows, f"n {key}, value string, path string").repartition(3)
    found = schema_drift(df, T.StructType.fromDDL(SCHEMA), "n", **options).collect()
    return {(r.path, r.found): (r.status, r.row_count, r.first_row) for r in found}


def with_clash(lines):
    return [(i, line, "clash") for i, line in enumerate(lines)]


def test_drift(spark):
    rows = with_clash(
        [
            '{"a": 1, "b": {"x": "s", "y": [1, 2.5, null]}, "c": [{"z": true}], "d": {"k": 1}, "t": "2024-01-01"}',
            '{"a": "1", "b": {"x": 3, "y": [true, true], "w": 0}, "c": [{"z": 1}, {"v": {"deep": 1}}, 7]}',
            '{"a": 1.5, "b": null, "d": {"k": "v", "l": 2}, "odd.name": "fine", "other`s": []}',
            '{"a": 1, "a": 2}',
            "{broken",
            "[1]",
            None,
            "",
            " \t",
            '{"a": 92233720368547758089}',
        ]
    )
    assert report(spark, rows) == {
        ("$", "malformed"): ("malformed", 2, 3),
        ("$", "array"): ("conflict", 1, 5),
        ("a", "string"): ("conflict", 1, 1),
        ("a", "number"): ("conflict", 2, 2),
        ("b.x", "integer"): ("conflict", 1, 1),
        ("b.w", "integer"): ("new", 1, 1),
        ("b.y[]", "boolean"): ("conflict", 1, 1),
        ("c[]", "integer"): ("conflict", 1, 1),
        ("c[].z", "integer"): ("conflict", 1, 1),
        ("c[].v", "object"): ("new", 1, 1),
        ("d{}", "string"): ("conflict", 1, 2),
        ("`other``s`", "array"): ("new", 1, 2),
        ("gone", None): ("absent", 0, None),
    }
    every = report(spark, rows, everything=True)
    assert every["d{}", "integer"] == ("as given", 2, 0)
    assert every["`odd.name`", "string"] == ("as given", 1, 2)
    assert every["b", "null"] == ("as given", 1, 2)


def test_empty_null_keys_and_long_rows(spark):
    empty = report(spark, [], key="string")
    assert len(empty) == 14 and {*empty.values()} == {("absent", 0, None)}
    long = json.dumps({"b": {"y": list(range(50_000))}, **{f"f{i}": i for i in range(500)}})
    found = report(spark, [(None, long, ""), ("k", long, ""), ("k", long, "")], key="string")
    assert found["f499", "integer"] == ("new", 3, "k")
    assert ("b.y[]", "integer") not in found


def plain(lines):
    """Counts of (path, kind) of fields a and b.* and of unknown fields, by the json module."""
    kinds = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}
    seen = defaultdict(list)
    for i, line in enumerate(lines):
        row = json.loads(line)
        at = {("$", "object")} | {(k, kinds.get(type(v), "null")) for k, v in row.items()}
        if isinstance(row.get("b"), dict):
            at |= {(f"b.{k}", kinds.get(type(v), "null")) for k, v in row["b"].items()}
        for place in at:
            seen[place].append(i)
    return {place: (len(where), where[0]) for place, where in seen.items()}


def test_against_plain(spark):
    draw = random.Random(7)
    values = [1, 2.5, "x", True, None, {}]
    lines = []
    for _ in range(300):
        row = {k: draw.choice(values) for k in draw.sample(["a", "e", "f", "g"], draw.randint(0, 4))}
        if draw.random() < 0.5:
            row["b"] = {k: draw.choice(values) for k in draw.sample(["x", "u", "v"], 2)}
        lines.append(json.dumps(row))
    found = report(spark, with_clash(lines), everything=True)
    assert {k: v[1:] for k, v in found.items() if v[0] != "absent"} == plain(lines)


def test_rows_are_parsed_once_and_counted_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "{}", "")], "n int, value string, path string")
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        found = schema_drift(df, T.StructType.fromDDL(SCHEMA), "n")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    assert plan.count("parseJson") == 1
    assert "partial_count" in plan and "Join" not in plan and "Python" not in plan
