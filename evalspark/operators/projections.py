"""Row-wise reshaping: no shuffle in any of these."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.strings import ColumnOrName, as_col, strip
from evalspark.functions.times import duration_seconds, duration_text

# Fixed value: the marker between a problem's prompt and its solution.
BREAK_MARKER = "\n\n\t// BREAK between verilog_eval 'prompt' and 'canonical_solution'\n\n"


def keep_columns(df: DataFrame, names: list[str] | set[str]) -> DataFrame:
    """The named columns that exist, in source order; other names are ignored."""
    wanted = set(names)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields become ``outer<sep>inner`` columns; arrays are joined by ", "."""

    def walk(fields: list[T.StructField], path: str, label: str) -> list[Column]:
        out: list[Column] = []
        for field in fields:
            source, name = f"{path}`{field.name}`", f"{label}{field.name}"
            if isinstance(field.dataType, T.StructType):
                out += walk(field.dataType.fields, f"{source}.", f"{name}{sep}")
            elif isinstance(field.dataType, T.ArrayType):
                texts = F.transform(F.col(source), lambda x: x.cast("string"))
                out.append(F.array_join(texts, ", ").alias(name))
            else:
                out.append(F.col(source).alias(name))
        return out

    return df.select(*walk(df.schema.fields, "", ""))


def build_problems(joined: DataFrame) -> DataFrame:
    """Problem rows from descriptions joined with solutions (see ``join_one_to_one``)."""
    return joined.select(
        F.concat(F.lit("ve_"), F.col("task_id")).alias("problem_id"),
        F.col("detail_description").alias("problem_description"),
        F.col("prompt").alias("module_header"),
        F.col("test").alias("testbench_code"),
        F.concat(
            strip(F.col("prompt")),
            F.lit(BREAK_MARKER),
            strip(F.col("canonical_solution")),
            F.lit("\n"),
        ).alias("canonical_solution"),
        F.lit("systemverilog").alias("code_language"),
        F.create_map().cast("map<string,string>").alias("other_data"),
    )


def data_flags(solution: ColumnOrName, testbench: ColumnOrName) -> Column:
    """Array of flags naming the data a problem has."""
    return F.array_compact(
        F.array(
            F.when(as_col(solution).isNotNull(), "has_canonical_solution"),
            F.when(as_col(testbench).isNotNull(), "has_testbench_code"),
        )
    )


def problem_label(problem_id: ColumnOrName, flags: Column) -> Column:
    return F.concat(
        F.lit("SimpleCodeGenProblem("),
        F.array_join(F.concat(F.array(as_col(problem_id)), flags), ", "),
        F.lit(")"),
    )


def qualify_vcd_paths(code: ColumnOrName, folder: ColumnOrName) -> Column:
    """Put the folder in front of every quoted ``name.vcd``; null code stays null."""
    literal = F.regexp_replace(as_col(folder), r"([\\$])", r"\\$1")
    return F.regexp_replace(
        as_col(code), F.lit(r'(?U)"(\w+\.vcd)"'), F.concat(F.lit('"'), literal, F.lit('/$1"'))
    )


def metadata_json(response: ColumnOrName, body_field: str) -> Column:
    """Metadata of a full response struct: everything but the message body, as JSON."""
    return F.to_json(as_col(response).dropFields(body_field), {"ignoreNullFields": "false"})


def config_options(
    options: ColumnOrName, seed: ColumnOrName, temperature: ColumnOrName
) -> Column:
    """Free options with seed and temperature laid over them where those are set."""
    named = {"seed": as_col(seed).cast("string"), "temperature": as_col(temperature).cast("string")}

    def is_overridden(key: Column) -> Column:
        return functools.reduce(
            operator.or_, [(key == name) & value.isNotNull() for name, value in named.items()]
        )

    free = F.coalesce(as_col(options), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(free, lambda key, _: ~is_overridden(key))
    explicit = F.create_map(*[c for name, value in named.items() for c in (F.lit(name), value)])
    return F.map_concat(kept, F.map_filter(explicit, lambda _, value: value.isNotNull()))


def has_solution_and_testbench(problems: DataFrame) -> DataFrame:
    return problems.where(
        F.col("canonical_solution").isNotNull() & F.col("testbench_code").isNotNull()
    )


def command_as_row(results: DataFrame, micros: ColumnOrName) -> DataFrame:
    """Command results with their duration as text and as seconds."""
    duration = as_col(micros)
    return results.withColumn("execution_duration", duration_text(duration)).withColumn(
        "execution_duration_sec", duration_seconds(duration)
    )
