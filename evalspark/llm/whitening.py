"""Whitening of embeddings, with the principal components from FEAST contour integration.

Vectors become whole numbers; the fit uses every distinct vector once. One pass over them gives
their number and sums, a second the covariance: whole numbers are centred on the rounded mean before
they are multiplied, so the sums of products are exact and no order of adding matters, and what
rounding left over is taken off at the end. The matrix, one row per dimension, is cut into intervals
by counts of inertia, and a task per interval solves it by contour integration. Each vector is then
projected by itself. The identity error comes from a pass over the whitened fit list.

Rows with a null vector, or a null or non-finite entry, are dropped. Vectors of one table have one
length: the most frequent, the longer of equally frequent ones; others are dropped as well. Repeated
rows all stay, and null keys are keys like others. Components whose variance is 0, up to rounding,
have no whitened form and are left out: with n distinct vectors there are n - 1 at most. So an empty
table, one vector, or equal ones give no rows. An entry that does not fit a bigint raises, as does a
deviation. Only key and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.llm import feast
from evalspark.llm.running import written

#: Steps of an entry for each unit, and what is added to it.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Variance, as a part of the total, under which a component is rounding.
LEAST = 1e-12
ROWS = 4096


def scaled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): the usable vectors in whole numbers."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").alias("key"), entries.alias("entries"))
    infinite = F.lit(float("inf"))

    def unusable(c):
        return c.isNull() | F.isnan(c) | (F.abs(c) == infinite)

    usable = rows.where(F.col("entries").isNotNull() & ~F.exists("entries", unusable))
    steps = F.transform("entries", lambda c: F.floor(SCALE * c) + F.lit(OFFSET).cast("bigint"))
    return usable.select("key", steps.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time, with their vectors as the rows of a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, -1)


def _summed(df: DataFrame, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows `x` of a matrix of numbers that `values` makes of some rows.

    Each task adds up its own; Spark adds the tasks' entries by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, 0):
            total = values(x) if total is None else total + values(x)
        if total is not None:
            for row, entries in enumerate(total):
                columns = [pa.array([row] * len(entries)), pa.array(range(len(entries))), pa.array(entries)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "place", "value"])

    schema = StructType.fromDDL("row bigint, place bigint, value double")
    parts = df.select("x").mapInArrow(run, schema)
    rows = parts.groupBy("row", "place").agg(F.sum("value").alias("value")).collect()  # a matrix
    if not rows:
        return None
    out = np.zeros((1 + max(r.row for r in rows), 1 + max(r.place for r in rows)))
    for r in rows:
        out[r.row, r.place] = r.value
    return out


def components(df: DataFrame, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `wanted` eigenvalues and their vectors, as columns; each interval is one task."""
    spark = df.sparkSession
    matrix = covariance / (np.trace(covariance) or 1.0)
    parts = feast.intervals(*feast.tridiagonal(matrix), wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                values, vectors = feast.solve(matrix, part["low"], part["high"], part["count"])
                columns = [pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["value", "vector"])

    jobs = spark.createDataFrame(parts, "low double, high double, count int").repartition(len(parts))
    solved = jobs.mapInArrow(run, "value double, vector array<double>").collect()  # a matrix at most
    solved = sorted(solved, key=lambda r: -r.value)[:wanted]
    return (
        np.array([r.value for r in solved]) * np.trace(covariance),
        np.array([r.vector for r in solved]).T,
    )


@dataclass(frozen=True)
class Whitening:
    """What the fit has found; `vectors` has a column for each component."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ (self.vectors / np.sqrt(self.values))


def fit(distinct: DataFrame, wanted: int = COMPONENTS, least: float = LEAST) -> Whitening | None:
    """The whitening of a table of distinct vectors `x`; None if they do not vary."""
    n = distinct.count()
    if not n:
        return None
    places = distinct.select(F.posexplode("x").alias("place", "value"))
    by_place = places.groupBy("place").agg(F.sum("value").alias("sum")).collect()  # one a dimension
    sums = np.array([r["sum"] for r in sorted(by_place, key=lambda r: r.place)], dtype=np.int64)
    if not len(sums):
        return None
    shift = (sums + n // 2) // n
    rest = (sums - n * shift) / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = (x - shift).astype(np.float64)  # whole numbers, so their sums are exact
        return centred.T @ centred

    covariance = _summed(distinct, products) / n - np.outer(rest, rest)
    trace = float(np.trace(covariance))
    if not trace > 0:
        return None
    values, vectors = components(distinct, covariance, min(wanted, len(sums)))
    real = values > least * trace
    values, vectors = values[real], vectors[:, real]
    found = Whitening(n, sums, values, vectors, values / trace, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        white = np.column_stack([np.ones(len(x)), found.project(x)])
        return white.T @ white

    seen = _summed(distinct, moments) / n
    spread = seen[1:, 1:] - np.outer(seen[0, 1:], seen[0, 1:])
    error = float(np.abs(spread - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, found.explained, error)


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS
) -> DataFrame:
    """(key, n, deviation, component, whitened, explained, identity_error): a row per vector and component."""
    spark = df.sparkSession
    usable = scaled(df, key, vector)
    lengths = usable.groupBy(F.size("x").alias("length")).count()  # one row for each length
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    kind = usable.schema["key"].dataType
    schema = (
        StructType()
        .add("key", kind)
        .add("deviation", "long")
        .add("whitened", StructType.fromDDL("a array<double>")["a"].dataType)
    )
    found = None
    if most is not None:
        usable = usable.where(F.size("x") == most.length)
        distinct = written(usable.select("x").distinct(), "distinct")
        found = fit(distinct, wanted)
    if found is None:
        return spark.createDataFrame(
            [],
            f"key {kind.simpleString()}, n bigint, deviation bigint, component int, "
            "whitened double, explained double, identity_error double",
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1):
            apart = found.deviations(x)
            if (apart.astype(np.float64) ** 2).sum(axis=1).max(initial=0) >= 2.0**63:
                raise OverflowError("a deviation does not fit a bigint")
            white = found.project(x)
            ends = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
            columns = [
                part.column(0),
                pa.array((apart**2).sum(axis=1)),
                pa.ListArray.from_arrays(ends, pa.array(white.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = usable.mapInArrow(run, schema)
    explained = F.array(*[F.lit(float(e)) for e in found.explained])
    each = rows.select("key", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "key",
        F.lit(found.n).cast("bigint").alias("n"),
        "deviation",
        (F.col("place") + 1).cast("int").alias("component"),
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
