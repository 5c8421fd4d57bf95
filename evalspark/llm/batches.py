"""Runs a function over the texts of a table, a bounded amount of text at a time.

Spark partitions the work; a task holds one Arrow batch and calls the function with slices of it, so
its memory follows the slice size and the longest text, not the table. No row is moved or dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters handed to the function at once (a longer text comes alone).
SLICE_CHARS = 1 << 21

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<tinyint>": pa.list_(pa.int8()),
    "array<string>": pa.list_(pa.string()),
}


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts with about `limit` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list], list]],
    fields: dict[str, str],
    keep: Sequence[str] = (),
    with_kept: bool = False,
) -> DataFrame:
    """Adds computed columns to every row: a struct `kept` of the columns `keep` and a struct `out`.

    `make()` runs once per task and gives the function; that takes a list of texts (null: None) and
    returns one sequence per entry of `fields` (name -> Spark type). With `with_kept` it also gets
    the kept columns of these rows, as Arrow arrays. Both structs keep their own names, so columns
    of the table cannot clash with computed ones.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    source = df.select(kept.alias("kept"), F.col(f"`{text}`").alias("text"))
    schema = (
        StructType()
        .add("kept", source.schema["kept"].dataType)
        .add("out", StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items())))
    )
    kinds = [ARROW[t] for t in fields.values()]
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                carried = batch.column(0).slice(a, b - a)
                args = (texts[a:b], carried.flatten()) if with_kept else (texts[a:b],)
                columns = [
                    c if isinstance(c, pa.Array) else pa.array(c, type=t)
                    for c, t in zip(function(*args), kinds, strict=True)
                ]
                out = pa.StructArray.from_arrays(columns, names=names)
                yield pa.RecordBatch.from_arrays([carried, out], names=["kept", "out"])

    return source.mapInArrow(run, schema)
