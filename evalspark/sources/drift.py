"""What a JSON log holds beside its given schema, over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_GIVEN, NEW, CONFLICT, MALFORMED, ABSENT = "as given", "new", "conflict", "malformed", "absent"
ROOT = "$"
#: Kinds of JSON values by the type that a variant has for them.
KINDS = {
    "BIGINT": "integer",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "ARRAY": "array",
    "OBJECT": "object",
}
_SEEN = "array<struct<path:string,found:string>>"


def accepted_kinds(kind: T.DataType) -> list[str]:
    """Kinds of JSON values that a column of this type takes; a null is always taken."""
    if isinstance(kind, T.VariantType):
        return sorted({*KINDS.values()})
    if isinstance(kind, T.IntegralType):
        return ["integer", "null"]
    if isinstance(kind, T.NumericType):
        return ["integer", "null", "number"]
    if isinstance(kind, T.BooleanType):
        return ["boolean", "null"]
    if isinstance(kind, T.ArrayType):
        return ["array", "null"]
    if isinstance(kind, (T.StructType, T.MapType)):
        return ["null", "object"]
    return ["null", "string"]


def _step(path: str, name: str) -> str:
    plain = name.isascii() and name.replace("_", "a").isalnum()
    shown = name if plain else "`" + name.replace("`", "``") + "`"
    return shown if path == ROOT else f"{path}.{shown}"


def _step_column(path: str, name: Column) -> Column:
    quoted = F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    shown = F.when(F.rlike(name, F.lit("^[A-Za-z0-9_]+$")), name).otherwise(quoted)
    return shown if path == ROOT else F.concat(F.lit(f"{path}."), shown)


def given_paths(kind: T.DataType, path: str = ROOT) -> list[tuple[str, T.DataType]]:
    """Every place of a schema with its type; ``[]`` and ``{}`` are the values of arrays and maps."""
    found = [(path, kind)]
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            found += given_paths(field.dataType, _step(path, field.name))
    elif isinstance(kind, T.ArrayType):
        found += given_paths(kind.elementType, f"{path}[]")
    elif isinstance(kind, T.MapType):
        found += given_paths(kind.valueType, f"{path}{{}}")
    return found


def _kind(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return names[F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)]


def _below(value: Column, kind: T.DataType, path: str) -> Column:
    """Array of (path, found) of what is inside a variant, as far down as its given type goes."""
    nothing = F.array().cast(_SEEN)

    def seen(at: Column, item: Column) -> Column:
        return F.struct(at.alias("path"), _kind(item).alias("found"))

    if isinstance(kind, T.StructType):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        own = F.transform(
            F.map_entries(fields), lambda e: seen(_step_column(path, e["key"]), e["value"])
        )
        inner = [
            _below(F.try_element_at(fields, F.lit(f.name)), f.dataType, _step(path, f.name))
            for f in kind.fields
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        ]
        return F.concat(F.coalesce(own, nothing), *inner)
    if isinstance(kind, T.ArrayType):
        items, under, at = F.try_variant_get(value, "$", "array<variant>"), kind.elementType, f"{path}[]"
    elif isinstance(kind, T.MapType):
        items = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        under, at = kind.valueType, f"{path}{{}}"
    else:
        return nothing
    each = F.transform(items, lambda x: F.concat(F.array(seen(F.lit(at), x)), _below(x, under, at)))
    return F.coalesce(F.array_distinct(F.flatten(each)), nothing)


def schema_drift(
    lines: DataFrame, schema: T.StructType, key: str, text: str = "value", everything: bool = False
) -> DataFrame:
    """(path, expected, found, status, row_count, first_row): where a log departs from ``schema``.

    Every row of JSON text is looked at, in one pass and one small shuffle. A row counts once per path
    and kind of value; ``first_row`` is the smallest ``key`` of these rows, null keys last. Status:
    ``new`` for a field that the schema does not have (what is inside it is not listed), ``conflict``
    for a value that its type does not take, ``malformed`` for text that is not JSON or has a field
    twice, ``absent`` for a place of the schema that no row has. ``everything`` lists what is as given
    too. Ranges of numbers and formats of times are not checked. Null and blank texts are left out;
    without rows all places are absent. Other columns are not read.
    """
    given = given_paths(schema)
    rows = lines.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # json white space only; a bare filter on the stored column, so it may be pushed to the scan
    rows = rows.where(F.rlike("text", F.lit(r"[^ \t\r\n]")))
    parsed = rows.select("key", F.try_parse_json("text").alias("row"))
    whole = F.struct(
        F.lit(ROOT).alias("path"), F.coalesce(_kind(F.col("row")), F.lit(MALFORMED)).alias("found")
    )
    all_seen = F.array_distinct(F.concat(F.array(whole), _below(F.col("row"), schema, ROOT)))
    counted = (
        parsed.select("key", F.inline(all_seen))
        .groupBy("path", "found")
        .agg(F.count("*").alias("row_count"), F.min("key").alias("first_row"))
    )
    key_type = rows.schema["key"].dataType
    known = F.array(
        *[
            F.struct(
                F.lit(path).alias("path"),
                F.lit(kind.simpleString()).alias("expected"),
                F.array(*[F.lit(k) for k in accepted_kinds(kind)]).alias("accepted"),
            )
            for path, kind in given
        ]
    )
    places = lines.sparkSession.range(1).select(F.inline(known))
    entry = F.struct("found", "row_count", "first_row")
    # at most one entry per kind of value is gathered for a path
    found = (
        counted.withColumns({"expected": F.lit(None).cast("string"), "accepted": F.lit(None).cast("array<string>")})
        .unionByName(
            places.withColumns(
                {
                    "found": F.lit(None).cast("string"),
                    "row_count": F.lit(None).cast("bigint"),
                    "first_row": F.lit(None).cast(key_type),
                }
            )
        )
        .groupBy("path")
        .agg(
            F.max("expected").alias("expected"),
            F.max("accepted").alias("accepted"),
            F.collect_list(F.when(F.col("found").isNotNull(), entry)).alias("entries"),
        )
    )
    listed = found.select("path", "expected", "accepted", F.inline_outer("entries"))
    status = (
        F.when(F.col("found").isNull(), ABSENT)
        .when(F.col("found") == MALFORMED, MALFORMED)
        .when(F.col("expected").isNull(), NEW)
        .when(F.array_contains("accepted", F.col("found")), AS_GIVEN)
        .otherwise(CONFLICT)
    )
    report = listed.select(
        "path",
        "expected",
        "found",
        status.alias("status"),
        F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
        "first_row",
    )
    return report if everything else report.where(F.col("status") != AS_GIVEN)
