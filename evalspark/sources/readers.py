"""Readers. Schemas are always given, so no read infers one from leading rows."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.toolout import parameter_count
from evalspark.operators.checks import assert_columns
from evalspark.operators.joins import join_one_to_one
from evalspark.operators.projections import build_problems
from evalspark.schemas import (
    MODEL_CLASSES,
    MODEL_CONFIGS,
    PROBLEM_DESCRIPTIONS,
    PROBLEM_SOLUTIONS,
)

CORRUPT = "_corrupt_record"


def read_jsonl(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    keep_corrupt: bool = False,
    rest: str | None = None,
) -> DataFrame:
    """Newline-delimited JSON. Broken lines raise, or are kept in ``_corrupt_record``.

    A field that the schema does not have raises too, or is kept: ``rest`` names a map column for
    such fields, null where there are none.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if keep_corrupt:
        fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    else:
        fields, options = schema, {"mode": "FAILFAST"}
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    unknown = F.array_except(F.json_object_keys("value"), names)
    parsed = F.from_json("value", fields, options)
    everything = F.from_json("value", "map<string,string>")
    others = F.map_filter(everything, lambda name, _: F.array_contains(unknown, name))
    if rest is None:
        message = F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))
        refused = F.raise_error(message).cast(fields)
        parsed = F.when(F.size(unknown) > 0, refused).otherwise(parsed)
    found = lines.select(
        parsed.alias("_row"), *([F.when(F.size(unknown) > 0, others).alias(rest)] if rest else [])
    )
    return found.select("_row.*", *([rest] if rest else []))


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or one without rows if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_source_tree(
    spark: SparkSession, folder: str, extensions: Iterable[str] = ("v", "sv")
) -> DataFrame:
    """One row per source file below the folder: file_path, file_name, contents."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .text(folder, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("value").alias("contents"),
        )
    )


def tree_size(spark: SparkSession, folder: str) -> DataFrame:
    """Total bytes of all files below the folder, from file listings; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.count(F.lit(1)).alias("file_count"),
    )


def rows_to_table(
    spark: SparkSession, rows: Iterable[dict | tuple], schema: T.StructType
) -> DataFrame:
    """A table from configured rows; missing fields are null."""
    names = schema.fieldNames()
    tuples = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) for r in rows]
    return spark.createDataFrame(tuples, schema)


def config_problem() -> Column:
    """Why a model config row is not valid; null when it is."""
    name, model = F.col("llm_class"), F.col("model_name")
    return (
        F.when(
            name.isNull() | ~name.isin(MODEL_CLASSES),
            F.concat(F.lit("unknown class: "), F.coalesce(name, F.lit("None"))),
        )
        .when(F.col("configured_llm_name").isNull(), "no configured name")
        .when((name != "MockLlm") & model.isNull(), "no model name")
        .when((name == "OllamaLlm") & ~model.contains(":"), "model name has no release tag")
        .when(
            (name == "OllamaLlm") & parameter_count(model).isNull(),
            "model name has no parameter count",
        )
    )


def validated_configs(configs: DataFrame, *keys: str) -> DataFrame:
    """Config rows with defaults filled in, parameter count, and the problem found, if any."""
    return configs.select(
        *keys,
        "llm_class",
        "configured_llm_name",
        F.coalesce("is_stable", F.lit(False)).alias("is_stable"),
        "model_name",
        "option_seed",
        "option_temperature",
        "other_model_file_options",
        F.when(
            F.col("llm_class") == "MockLlm",
            F.coalesce("does_respond_to_test_queries", F.lit(True)),
        ).alias("does_respond_to_test_queries"),
        F.when(
            F.col("llm_class") == "MockLlm", F.coalesce("response_delay_seconds", F.lit(0.01))
        ).alias("response_delay_seconds"),
        F.when(F.col("llm_class") == "OllamaLlm", parameter_count("model_name")).alias(
            "parameter_count_billions"
        ),
        config_problem().alias("problem"),
    )


def require_valid_configs(configs: DataFrame) -> DataFrame:
    """The validated rows; any invalid one raises when read."""
    checked = validated_configs(configs)
    return checked.where(
        F.when(F.col("problem").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.col("problem")).cast("boolean")
        )
    ).drop("problem")


def _yaml_rows(spark: SparkSession, path: str) -> list[dict]:
    """The objects of a YAML list. Such a file is written by hand; it is read by the driver."""
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("reading YAML needs PyYAML; JSON lines need nothing") from missing
    rows = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    unknown = {key for row in rows for key in row} - set(MODEL_CONFIGS.fieldNames())
    if unknown:
        raise ValueError(f"unknown config fields: {sorted(unknown)}")
    return [_typed(row) for row in rows]


def _typed(row: dict) -> dict:
    """YAML writes whole numbers without a point, and options with values of any type."""
    row = dict(row)
    for name in ("option_temperature", "response_delay_seconds"):
        if row.get(name) is not None:
            row[name] = float(row[name])
    options = row.get("other_model_file_options")
    if options is not None:
        row["other_model_file_options"] = {k: str(v) for k, v in options.items()}
    return row


def read_model_configs(spark: SparkSession, path: str, require: bool = True) -> DataFrame:
    """Model configs from a YAML list or a JSON-lines file (one object per line).

    A config with a problem raises, or else the column ``problem`` says what is wrong.
    """
    if path.endswith((".yaml", ".yml")):
        found = rows_to_table(spark, _yaml_rows(spark, path), MODEL_CONFIGS)
    else:
        found = read_jsonl(spark, path, MODEL_CONFIGS)
    return require_valid_configs(found) if require else validated_configs(found)


def read_problems(spark: SparkSession, descriptions: str, solutions: str) -> DataFrame:
    """Problems from the two JSON-lines files, with all the checks of the loader."""
    described = read_jsonl(spark, descriptions, PROBLEM_DESCRIPTIONS)
    solved = read_jsonl(spark, solutions, PROBLEM_SOLUTIONS)
    return problems_from(described, solved)


def problems_from(described: DataFrame, solved: DataFrame) -> DataFrame:
    assert_columns(described, PROBLEM_DESCRIPTIONS.fieldNames())
    assert_columns(solved, PROBLEM_SOLUTIONS.fieldNames())
    return build_problems(join_one_to_one(described, solved, "task_id", same_count=True))


def sibling(path: str, extension: str) -> str:
    """The path with another extension."""
    return str(PurePosixPath(path).with_suffix(extension)) if "://" not in path else (
        path.rsplit(".", 1)[0] + extension
    )
