"""Roll-ups and summaries. All aggregate partially before their shuffle, so no key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.strings import int_div
from evalspark.schemas import CYCLE_STAGES, END_STAGES, PASS_STAGE

MODEL_KEYS = ["llm_provider_name", "configured_llm_name"]
OTHER_STAGES = "other"


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Row counts by the keys, sorted by all columns."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(*counted.columns)


def stages_by_model(experiments: DataFrame, stage: str = "exit_stage") -> DataFrame:
    """Summary 1: how often each model ended at each stage."""
    return count_by(experiments, *MODEL_KEYS, stage)


def observed_stages(summary: DataFrame, stage: str) -> list[str]:
    """The stage names that occur, in order. They become columns, so they have to be few."""
    return sorted(r[0] for r in summary.select(stage).distinct().collect() if r[0] is not None)


def pivot_stages(
    summary: DataFrame, stage: str = "exit_stage", stages: list[str] | None = None
) -> DataFrame:
    """Summary 2: one row per model, one column per stage in name order, zero where none ended.

    What ended at a stage outside the list, or at none, is counted in the last column, ``other``.
    """
    names = sorted(stages) if stages is not None else observed_stages(summary, stage)
    listed = F.when(F.col(stage).isin(names), F.col(stage)).otherwise(OTHER_STAGES)
    columns = [*names, OTHER_STAGES]
    pivoted = (
        summary.withColumn("_stage", listed)
        .groupBy(*MODEL_KEYS)
        .pivot("_stage", columns)
        .agg(F.sum("count"))
    )
    return pivoted.na.fill(0, columns)


def run_counters(
    experiments: DataFrame, stage: str = "exit_stage", valid: Column | None = None
) -> DataFrame:
    """One row of totals; with a validity condition also how many rows meet it."""
    is_exception = F.col(stage).eqNullSafe(F.lit("exception"))
    counters = [
        F.count(F.lit(1)).alias("total_experiment_count"),
        F.count_if(is_exception).alias("exception_count"),
        F.count_if(~is_exception).alias("nonexception_count"),
    ]
    if valid is not None:
        ok = F.coalesce(valid, F.lit(False))
        counters += [F.count_if(ok).alias("valid_count"), F.count_if(~ok).alias("invalid_count")]
    return experiments.agg(*counters)


def _stage_number(stage: Column, stages: list[str]) -> Column:
    number = F.array_position(F.array(*[F.lit(s) for s in stages]), stage)
    unknown = F.raise_error(F.concat(F.lit("unknown exit stage: "), stage)).cast("bigint")
    return F.when(number > 0, number - 1).otherwise(unknown)


def rollup_cycles(
    cycles: DataFrame,
    keys: list[str] | None = None,
    stages: list[str] | None = None,
    limit: str | None = None,
) -> DataFrame:
    """Cycles to experiments: used_cycle_count, latest_exit_stage, was_testbench_passed.

    An experiment ends at its first pass or exception; rows behind that do not count. With
    ``limit``, the column with the cycles an experiment was allowed, there are also that limit as
    ``max_cycle_count`` and ``is_beyond_limit``, which marks logs with more cycles; they count
    nevertheless. An experiment that ended by an exception has neither model nor counts.

    One aggregate does it all: stages travel as vocabulary numbers packed with the cycle number into
    one bigint, so the aggregate hashes fixed-width buffers and needs neither a sort nor a window.
    """
    keys = keys or ["experiment_execution_uuid"]
    stages = stages or CYCLE_STAGES
    base = len(stages)
    # a null stage counts as "end", the stage of a cycle that set none
    number = _stage_number(F.coalesce(F.col("exit_stage"), F.lit("end")), stages)
    limits = [F.col(limit).cast("bigint").alias("_limit")] if limit else []
    packed = cycles.select(
        *keys, (F.col("cycle_num").cast("bigint") * base + number).alias("_cycle"), *limits
    )
    ends = F.pmod("_cycle", F.lit(base)).isin(*[stages.index(s) for s in END_STAGES])
    rolled = packed.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(ends, F.col("_cycle"))), F.max("_cycle")).alias("_last"),
        *([F.max("_limit").alias("_limit")] if limit else []),
    )
    stage = F.get(
        F.array(*[F.lit(s) for s in stages]), F.pmod(F.col("_last"), F.lit(base)).cast("int")
    )
    found = rolled.withColumn("latest_exit_stage", stage)
    normal = F.col("latest_exit_stage") != "exception"
    used = int_div(F.col("_last"), base) + 1
    counts = {"used_cycle_count": used}
    if limit:
        counts |= {"max_cycle_count": F.col("_limit"), "is_beyond_limit": used > F.col("_limit")}
    return found.select(
        *[F.when(normal, F.col(k)).alias(k) if k in MODEL_KEYS else F.col(k) for k in keys],
        *[F.when(normal, c).alias(n) for n, c in counts.items()],
        "latest_exit_stage",
        (F.col("latest_exit_stage") == PASS_STAGE).alias("was_testbench_passed"),
    )


def distinct_agents(messages: DataFrame) -> DataFrame:
    return messages.where("agent_name is not null and agent_name <> ''").select(
        "agent_name"
    ).distinct()


def response_stability(
    responses: DataFrame,
    model: str = "configured_llm_name",
    prompt: str = "prompt",
    is_stable: str | None = None,
) -> DataFrame:
    """Per model and prompt: how often asked, number of different answers, whether just one.

    With a column that says which models are meant to be stable, ``is_as_promised`` is false where
    such a model gave several answers. Answers are compared by digest, so the two-step distinct
    count shuffles 64 characters per different answer instead of whole texts.
    """
    promise = F.col(is_stable) if is_stable else F.lit(False)
    counted = (
        responses.select(
            model, prompt, promise.alias("_promise"), F.sha2("response", 256).alias("_digest")
        )
        .groupBy(model, prompt)
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            F.count_distinct("_digest").alias("distinct_responses"),
            F.bool_or("_promise").alias("_promise"),
        )
        .withColumn("is_one_response", F.col("distinct_responses") == 1)
    )
    if is_stable is None:
        return counted.drop("_promise")
    kept = ~F.coalesce(F.col("_promise"), F.lit(False)) | F.col("is_one_response")
    return counted.withColumn("is_as_promised", kept).drop("_promise")
