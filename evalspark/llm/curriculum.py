"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

A source's target is its share of the mix, by weight, up to `most` times its words; what is above
goes to the other sources by weight. With sources in order of the weight at which they are full,
the level that they all reach is the largest of the levels that the full ones before leave, so one
running total and a maximum replace repeated rounds.

A source's documents stand in a fixed order, by digest, and are read from the start, again from the
start when they are through, until the target is reached; the last document is cut there. Where a
document's words begin, as a part of the target, is the demand met so far. Each source has a
schedule, its weight over the time of training, linear between knots. Its integral is the demand
met by a time; the inverse of that gives each use of a document its time. Rows are sorted by it.

Weights, schedules and their number are parameters; sources take them in turn, by code point of
their name, null last. The running totals never gather a source: a third of all documents may be
of one. Targets are rounded down to words. Null and empty texts have no words and are not used.
Rows that are equal in key and text are interchangeable: all are there, and the digests, so results,
do not depend on the run. Null keys are keys like others. An empty table, or one without words,
gives targets of 0. Only key, text and source are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.running import totals_before, written

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of all documents.
EPOCHS = 1.5
#: How often a document may be used.
MOST = 2
#: (time, weight) knots of the schedules: early, steady, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WORDS = r"[^\x20\x09-\x0D]+"


def _in_turn(values: Sequence, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def _pieces(knots: Sequence[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(demand met at the end, at the start, start, width, weight there, at the end), in parts of all."""
    if [t for t, _ in knots] != sorted({t for t, _ in knots}) or (knots[0][0], knots[-1][0]) != (0, 1):
        raise ValueError("knots go from time 0 to 1 in order")
    spans = [(t, u - t, a, b) for (t, a), (u, b) in zip(knots, knots[1:])]
    areas = [width * (a + b) / 2 for _, width, a, b in spans]
    if min(w for _, w in knots) < 0 or not sum(areas):
        raise ValueError("weights are not negative and not all 0")
    met, out = 0.0, []
    for (start, width, a, b), area in zip(spans, areas):
        if area:
            out.append((met + area, met, start, width, a, b))
        met += area
    return out


def time_of(part: Column, schedules: Sequence, rank: Column) -> Column:
    """The time by which a source has met this part of its demand."""
    choices = None
    for i, knots in enumerate(schedules):
        pieces = _pieces(knots)
        total = pieces[-1][0]
        demand = part * F.lit(total)
        time = None
        for upto, met, start, width, a, b in reversed(pieces):
            # the weight grows from a by (b - a) / width: a x + (b - a) x^2 / (2 width) = left
            left = F.greatest(demand - F.lit(met), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * F.lit(b - a) * left / F.lit(width), F.lit(0.0)))
            inside = F.lit(start) + F.coalesce(F.try_divide(2 * left, F.lit(a) + root), F.lit(0.0))
            time = inside if time is None else F.when(demand <= upto, inside).otherwise(time)
        choices = F.when(rank % len(schedules) == i, time) if choices is None else choices.when(
            rank % len(schedules) == i, time
        )
    return choices


def source_targets(
    sized: DataFrame, weights: Sequence[float], epochs: float, most: int
) -> DataFrame:
    """(source, source_size, rank, target): one row for each source of `sized` (source, size)."""
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    ranked = totals_before(
        sources, [], [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("bigint")}
    )
    weight = _in_turn([float(w) for w in weights], F.col("rank"))
    limit = (most * F.col("source_size")).alias("limit")
    weighed = ranked.select("*", weight.alias("weight"), limit)
    full_at = F.col("limit") / F.col("weight")
    before = written(
        totals_before(
            weighed,
            [],
            [full_at, F.col("rank")],
            {"full": F.col("limit"), "lighter": F.col("weight")},
        ),
        "levels",
    )
    all_weights = before.agg(F.sum("weight")).first()[0] or 1.0
    level = (F.lit(float(epochs * total)) - F.col("full")) / (F.lit(all_weights) - F.col("lighter"))
    highest = before.agg(F.max(level)).first()[0] or 0.0
    reached = F.least(F.col("limit").cast("double"), F.lit(highest) * F.col("weight"))
    return before.select("source", "source_size", "rank", reached.alias("target"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    epochs: float = EPOCHS,
    most: int = MOST,
    schedules: Sequence = SCHEDULES,
) -> DataFrame:
    """(key, hash, size, source, source_size, target, taken, uses), sorted by the time of the first use.

    `taken` counts the words used, and `uses` has an entry (time, epoch, words) for each use.
    """
    if epochs > most:
        raise ValueError("the mix needs documents more often than they may be used")
    own, words = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = df.select(
        own.alias("key"),
        F.col(f"`{source}`").alias("source"),
        F.regexp_count(F.coalesce(words, F.lit("")), F.lit(WORDS)).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", own.cast("string"), words).cast("binary")).alias("hash"),
    )
    # written first: ranges are chosen from a sample, which would count all words a second time
    sized = written(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    targets = written(source_targets(sized, weights, epochs, most), "targets")
    placed = totals_before(
        sized, ["source"], [F.col("hash"), F.col("row")], {"start": F.col("size")}, targets
    )
    wanted = F.floor("target")
    uses = []
    for epoch in range(most):
        begins = F.col("start") + epoch * F.col("source_size")
        taken = F.greatest(F.least(F.col("size"), wanted - begins), F.lit(0).cast("bigint"))
        part = F.coalesce(F.try_divide(begins.cast("double"), wanted.cast("double")), F.lit(0.0))
        time = time_of(part, schedules, F.col("rank"))
        use = F.struct(time.alias("time"), F.lit(epoch).alias("epoch"), taken.alias("words"))
        uses.append(F.when(taken > 0, use))
    used = placed.withColumn("uses", F.array_compact(F.array(*uses)))
    taken = F.aggregate("uses", F.lit(0).cast("bigint"), lambda sum_, use: sum_ + use["words"])
    mixed = used.select(
        "key", "hash", "size", "source", "source_size", "target", taken.alias("taken"), "uses"
    )
    return mixed.orderBy(F.get("uses", F.lit(0))["time"].asc_nulls_last(), "hash")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per use of a document, in the order of training: (time, key, hash, source, epoch, words)."""
    uses = mixed.select("key", "hash", "source", F.inline("uses"))
    return uses.select("time", "key", "hash", "source", "epoch", "words").orderBy(
        "time", "hash", "epoch"
    )
