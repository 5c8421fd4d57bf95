"""Scoring a table of prompts with a Python responder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Responder = Callable[[Sequence[str], Sequence[list[dict]]], Sequence[str]]

ANSWER_LOG = "digest string, response string, error string, round bigint"


def score_prompts(
    prompts: DataFrame,
    responder: Responder,
    prompt: str = "prompt",
    history: str | None = None,
) -> DataFrame:
    """Add ``response`` and ``error``: the responder's answers, or why it failed on a row.

    The responder gets a batch of prompts and their histories (lists of {content, role}) and returns
    as many answers. Only these columns travel to it. If it fails on a batch, each half is asked
    again, down to the rows that fail: these are marked and do not fail the job, and the halves that
    succeed are not asked once more. Spread the prompts over enough partitions for a slow responder.
    """
    kind = pa.struct([("response", pa.string()), ("error", pa.string())])

    def answers_to(texts: list[str], past: list[list[dict]]) -> list[dict]:
        try:
            answers = list(responder(texts, past))
        except Exception as problem:  # noqa: BLE001 - the row carries the error
            if len(texts) == 1:
                return [{"response": None, "error": str(problem)}]
            half = len(texts) // 2
            return answers_to(texts[:half], past[:half]) + answers_to(texts[half:], past[half:])
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
        return [{"response": a, "error": None} for a in answers]

    @F.arrow_udf("struct<response:string,error:string>")
    def score(texts: pa.Array, past: pa.Array) -> pa.Array:
        earlier = [h or [] for h in past.to_pylist()]
        return pa.array(answers_to(texts.to_pylist(), earlier) if len(texts) else [], type=kind)

    none = F.lit(None).cast("array<struct<content:string,role:string>>")
    answered = score.asNondeterministic()(F.col(prompt), F.col(history) if history else none)
    return prompts.select("*", answered.alias("_scored")).select(
        *prompts.columns, "_scored.response", "_scored.error"
    )


def prompt_digest(prompt: str = "prompt", history: str | None = None) -> Column:
    """What identifies a question: the digest of its text and its history. Nulls are texts apart."""
    asked = F.struct(F.col(prompt).alias("p"), (F.col(history) if history else F.lit(None)).alias("h"))
    return F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}), 256)


def score_resumably(
    prompts: DataFrame,
    responder: Responder,
    log: str,
    prompt: str = "prompt",
    history: str | None = None,
    rounds: int = 1,
    partitions: int | None = None,
    retry_errors: bool = True,
) -> DataFrame:
    """Like ``score_prompts``, but answers are kept in the Parquet table ``log`` and not asked again.

    Prompts are known by digest: one that stands in several rows is asked once, and one that the log
    answers is not asked. What is left is asked in ``rounds`` jobs of about the same size, and each
    appends to the log when it is through, so a run that ends early loses one round at most and the
    next one goes on from there. Rows that failed are in the log too; they are asked again by the
    next run unless ``retry_errors`` is off. A log may serve any number of prompt tables. Runs that
    share one at the same time stay right but may ask twice.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], ANSWER_LOG).write.mode("append").parquet(log)  # if there is none yet
    columns = [prompt, *([history] if history else [])]
    wanted = (
        prompts.select(*columns, prompt_digest(prompt, history).alias("digest"))
        .groupBy("digest")
        .agg(*[F.first(c).alias(c) for c in columns])
    )

    def logged() -> DataFrame:
        spark.catalog.refreshByPath(log)
        return spark.read.schema(ANSWER_LOG).parquet(log)

    first = (logged().agg(F.max("round")).first()[0] or 0) + 1
    known = logged().where(F.col("round") < first)
    done = known if not retry_errors else known.where("error is null")
    for i in range(rounds):
        # digests are even, so rounds are; Spark looks at the prompts of one round only
        part = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), F.lit(rounds)) == i
        left = wanted.where(part).join(done.select("digest"), "digest", "left_anti")
        left = left.repartition(partitions, "digest") if partitions else left
        scored = score_prompts(left, responder, prompt, history)
        scored.select("digest", "response", "error", F.lit(first + i).cast("bigint").alias("round")).write.mode(
            "append"
        ).parquet(log)
    # an answer counts before a failure, a later entry before an earlier one
    last = F.max_by(F.struct("response", "error"), F.struct(F.col("error").isNull(), "round"))
    answers = logged().groupBy("digest").agg(last.alias("_answer"))
    own = prompts.withColumn("_digest", prompt_digest(prompt, history))
    return own.join(answers, own["_digest"] == answers["digest"], "left").select(
        *prompts.columns, "_answer.response", "_answer.error"
    )
