"""Joins and unions of evaluation tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.outcomes import failed
from evalspark.operators.checks import key_report


def join_on_same(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join on keys that may be null; a null key meets a null key. The keys come out once."""
    other = {k: f"_other_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(other)
    same = [left[k].eqNullSafe(renamed[o]) for k, o in other.items()]
    return left.join(renamed, reduce(and_, same), how).drop(*other.values())


def join_one_to_one(
    left: DataFrame, right: DataFrame, key: str, same_count: bool = False
) -> DataFrame:
    """Inner join that first checks that no key repeats on either side.

    ``same_count`` also demands equal row counts. All is checked in one job over the key columns.
    With it passed, no key can be hot and the join cannot multiply rows.
    """
    report = key_report(left, right, key).first()
    for side in ("left", "right"):
        if report[f"{side}_repeat"] is not None:
            raise ValueError(f"key {key} repeats on the {side} side: {report[f'{side}_repeat']!r}")
    if same_count and report["left_count"] != report["right_count"]:
        raise ValueError(
            f"row counts differ: {report['left_count']} and {report['right_count']}"
        )
    return left.join(right, key, "inner")


def _literal(value: object, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.MapType) and value is not None:
        pairs = [F.lit(x) for item in value.items() for x in item]
        return F.create_map(*pairs).cast(data_type)
    return F.lit(value).cast(data_type)


def with_each(df: DataFrame, rows: Iterable[tuple | dict], schema: T.StructType) -> DataFrame:
    """Every row of ``df`` with every row of a short configured list.

    The list goes into the plan as an array that is exploded in place: narrow, no join and no
    shuffle, however the rows of ``df`` are spread. A list too long to write into a plan is a table:
    cross join it.
    """
    rows = list(rows)
    names = schema.fieldNames()
    as_tuples = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) for r in rows]
    listed = F.array(
        *[
            F.struct(
                *[_literal(v, f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]
            )
            for row in as_tuples
        ]
    )
    if not rows:
        listed = F.lit([]).cast(T.ArrayType(schema))
    return df.select("*", F.explode(listed).alias("_each")).select(
        *[F.col(f"`{c}`") for c in df.columns], "_each.*"
    )


def attach_experiments(cycles: DataFrame, experiments: DataFrame) -> DataFrame:
    """Cycle rows with the columns of their experiment, null where it has no row.

    An experiment has one row, and few cycles, so no key is hot.
    """
    return cycles.join(experiments, EXPERIMENT, "left")


EXPERIMENT = "experiment_execution_uuid"
_STEPS = ("compile", "execute")
_OUTCOME = ("return_code", "stdout", "stderr")


def _step_columns(found: dict[str, Column]) -> list[Column]:
    """The prefixed columns of each step from its outcome struct (null if it did not run)."""
    return [
        column
        for step, outcome in found.items()
        for column in (
            *[outcome[f].alias(f"{step}_result_{f}") for f in _OUTCOME],
            F.when(outcome.isNotNull(), ~failed(outcome["return_code"])).alias(
                f"was_{step}_success"
            ),
        )
    ]


def attach_results(
    cycles: DataFrame, results: DataFrame, key: Sequence[str] = (EXPERIMENT, "cycle_num")
) -> DataFrame:
    """Rows with the compile and execute results of their key as prefixed columns.

    Each step is a left join of its rows as they are: nothing is aggregated, so no text is sorted
    before it moves, and every row moves once. A step logged twice for a key raises; a job over the
    key columns alone looks for that first.
    """
    key = list(key)
    steps = results.where(F.col("step").isin(*_STEPS))
    again = steps.groupBy(*key, "step").count().where("count > 1").select(*key, "step").first()
    if again is not None:
        raise ValueError(f"a result is there more than once: {again.asDict()}")
    joined = cycles
    for step in _STEPS:
        outcome = F.struct(*_OUTCOME).alias(f"_{step}")
        joined = joined.join(results.where(F.col("step") == step).select(*key, outcome), key, "left")
    return joined.select(*cycles.columns, *_step_columns({s: F.col(f"_{s}") for s in _STEPS}))


def union_ragged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all inputs; a column one of them lacks is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
