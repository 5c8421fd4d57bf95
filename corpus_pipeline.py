"""From raw documents to token ids: the stages of a training corpus, each on the output of the last.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
the documents, with whatever other columns came along. A stage's result is written to the shared
folder and read again, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, cleaning, decontaminate, line_templates, setsketch
from evalspark.llm.queries import BYTE_RANKS
from evalspark.session import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules, without the lines that fail."""
    judged = cleaning.clean(docs, keep=docs.columns)
    return with_text(judged.where("out.kept"), docs.columns, F.col("out.cleaned"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates, and documents of which nothing else is left.

    Each line stays in the first document that has it, so no line is lost with a document.
    """
    found = line_templates.drop_recurring(docs)
    left = found.where((F.size("out.dropped") == 0) | F.rlike("out.text", F.lit(r"[^\s]")))
    return with_text(left, docs.columns, F.col("out.text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest id, of each group of near duplicates."""
    return setsketch.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_leaks(docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the bytes they decode to."""
    vocabulary = bpe.load(spark, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    coded = bpe.round_trip(docs, vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """The struct `kept` of a document's columns as columns, with a new text and its length."""
    changed = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[changed.get(c, F.col(f"kept.`{c}`")).alias(c) for c in columns])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The perfect hash, the ring of registers and the encoder have no form in SQL; tests hold the
#: stages against plain versions.
ORACLE_SQL = None
