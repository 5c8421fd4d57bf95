"""Line dedup with a log-template tree of fixed depth, in DataFrame operations only.

A line goes down the tree by its number of tokens and its leading tokens, digits generalised. The
rest of it is cut into a few fields, and a leaf holds templates in which one field at most is
variable: `*`. Lines that agree in all but one field therefore share a template. A template that
occurs in two or more documents recurs; its lines stay in the document that has it first (the
smallest key) and are dropped from all others.

All copies of a line first become one row, templates are counted with partial aggregates, and only
hashes travel; a text is moved once, to meet the numbers of its dropped lines.

In lines with fewer than `min_variable` tokens no field is variable, and lines with fewer than
`min_tokens` are their own template, digits included; blank lines have none. A null text has no lines and stays null; an empty one stays
empty. Rows equal in key and text are one document, rows of one key with other texts too, as far as
recurrence goes; a null key counts as a document of its own, before all others. Other columns stay
as they are, whatever their names; temporary columns are wrapped in structs beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import fresh_path

BLANKS = " \t\r\f\v"
NO_KEY = -(1 << 63)


@dataclass(frozen=True)
class Tree:
    """Shape of the template tree."""

    leading: int = 2
    fields: int = 4
    min_tokens: int = 5
    min_variable: int = 10


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("bigint"), F.lit(NO_KEY))


def _document(key: str, text: str) -> list[Column]:
    """What tells one document from another."""
    return [_key(F.col(f"`{key}`")).alias("doc"), F.xxhash64(f"`{text}`").alias("version")]


def lines(df: DataFrame, key: str, text: str, tree: Tree) -> DataFrame:
    """(doc, version, line, template, w0, w1...) of every line that is not blank.

    `template` is the line without variable fields; the others are the templates with one.
    """
    split = df.select(*_document(key, text), F.posexplode(F.split(f"`{text}`", "\n", -1)))
    trimmed = split.select(
        "doc", "version", F.col("pos").alias("line"), F.trim("col", F.lit(BLANKS)).alias("bare")
    ).where("bare <> ''")
    # nothing is filtered by its tokens: Spark would push that down and cut every line twice
    plain = F.regexp_replace("bare", "[0-9]+", "0")
    tokens = trimmed.select("*", F.split(plain, r"[ \t\r\f\x0B]+").alias("t"))
    n, k = F.size("t"), tree.leading
    leaf = F.xxhash64(n, F.slice("t", 1, k))
    behind = F.greatest(n - k, F.lit(0))
    start = [F.lit(k) + F.floor(behind * i / tree.fields).cast("int") for i in range(tree.fields)]
    start.append(F.lit(k) + behind)
    rest = [
        F.xxhash64(F.slice("t", a + 1, b - a)).alias(f"f{i}")
        for i, (a, b) in enumerate(zip(start, start[1:]))
    ]
    hashed = tokens.select(
        "doc", "version", "line", "bare", leaf.alias("leaf"), n.alias("n"), *rest
    )
    fields = [f"f{i}" for i in range(tree.fields)]
    wild = [
        F.xxhash64("leaf", F.lit(i), *[f for f in fields if f != star])
        for i, star in enumerate(fields)
    ]
    return hashed.select(
        "doc",
        "version",
        "line",
        F.when(F.col("n") < tree.min_tokens, F.xxhash64(F.lit(-2), "bare"))
        .otherwise(F.xxhash64("leaf", F.lit(-1), *fields))
        .alias("template"),
        *[F.when(F.col("n") >= tree.min_variable, w).alias(f"w{i}") for i, w in enumerate(wild)],
    )


def first_documents(found: DataFrame, tree: Tree) -> DataFrame:
    """(template, first): the first document of the templates that each distinct line shares.

    Only for lines that occur, in one form or another, in more than one document.
    """
    wild = [f"w{i}" for i in range(tree.fields)]
    distinct = found.groupBy("template", *wild).agg(
        F.min("doc").alias("low"), F.max("doc").alias("high")
    )
    path = fresh_path(found.sparkSession, "templates")
    distinct.write.parquet(path)
    distinct = found.sparkSession.read.parquet(path)

    shares = distinct.select("template", "low", F.explode(F.array(*wild)).alias("wild"))
    shares = shares.where("wild is not null")
    merged = (
        shares.groupBy("wild")
        .agg(F.min("low").alias("first"), F.max("low").alias("last"))
        .where("first < last")
    )
    spread = (
        shares.join(merged, "wild").where("first < low").select("template", "first")
    )
    own = distinct.where("low < high").select("template", F.col("low").alias("first"))
    return spread.unionByName(own).groupBy("template").agg(F.min("first").alias("first"))


def drop_recurring(
    df: DataFrame, key: str = "doc_id", text: str = "text", tree: Tree = Tree()
) -> DataFrame:
    """For every row of `df`: struct `kept` of its columns, and struct `out` of

    n_lines (int), dropped (array of int: numbers of the dropped lines, from 0), lost_chars (int)
    and text (the lines that stay, joined).
    """
    spark = df.sparkSession
    path = fresh_path(spark, "lines")
    lines(df, key, text, tree).write.parquet(path)
    found = spark.read.parquet(path)
    # written, so that both sides of the join are dealt as they are and a hot template can be split
    path = fresh_path(spark, "first")
    first_documents(found, tree).write.parquet(path)
    first = spark.read.parquet(path)
    dropped = (
        found.select("doc", "version", "line", "template")
        .join(first, "template")
        .where("first < doc")
        .groupBy("doc", "version")
        .agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    )
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("kept"),
                      *_document(key, text), F.col(f"`{text}`").alias("text"))
    joined = whole.join(dropped, ["doc", "version"], "left")
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    rest = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    cleaned = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rest)
    return joined.select(
        "kept",
        F.struct(
            F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
            F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
            (F.length("text") - F.length(cleaned)).alias("lost_chars"),
            cleaned.alias("text"),
        ).alias("out"),
    )
