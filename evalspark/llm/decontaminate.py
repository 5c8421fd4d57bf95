"""Benchmark decontamination by templates, in DataFrame operations only.

Texts become tokens in which numbers, units behind them and names inside sentences are typed
placeholders with the value they stand for. Windows of the placeholders' types and the other words
are hash-joined with the windows of the benchmark, so a question with other numbers or names still
matches. Along one occurrence the values of windows that differ from the item's are held against
each other: a value of the item must stand for one value of the document. Windows with a value that
stands for several do not count; windows that equal the item's always do.

Windows that hold placeholders are joined a second time by their plain lower-cased words, so a
verbatim copy matches however many numbers and names it has and in whatever case it is written.

Most windows of a document are in no item. Those whose first and last tokens are not the ends of any
window of the items are left out before they are hashed: a bitmap of the hashes of the ends, of a
bounded size, has no false negatives, and the join decides about the rest.

A document is contaminated by an item if it holds `min_windows` different windows of it, or, for
a short item, half of them. An item shorter than a window is one window, and documents have plain
windows of its length; if it has fewer than `min_words` words, all of scripts that put blanks
between words, it is found as a whole document only. Null and empty texts, of documents or items,
match nothing. Equal rows are one document; equal items of different ids all match. A null key of a
document is reported as null. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import fresh_path

WINDOW = 8
#: Six windows of eight words are thirteen words in a row.
MIN_WINDOWS = 6
#: Items of fewer words than this occur in any text.
MIN_WORDS = 3
#: Letters of scripts in which a sentence can be one token.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Characters of all items up to which their windows are copied to every executor. A window takes
#: some 100 bytes and there are fewer than one per two characters.
BROADCAST_CHARS = 2_000_000

#: Bits of the bitmap: eight per character of all items, within these limits.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 20

TYPED, PLAIN, INNER = range(3)
SIGNS = NUMBER, UNIT, NAME = "#", "%", "@"
#: A number with up to two separators inside is one value.
NUMBERS = "([0-9]+)(?:[.,]([0-9]+))?(?:[.,]([0-9]+))?"
UNITS = (
    "km|m|cm|mm|kg|g|mg|t|lb|lbs|oz|l|ml|ft|feet|inch|inches|miles?|mph|kmh|s|sec|seconds?|min"
    "|minutes?|h|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
)


def _signed(word: Column) -> Column:
    """Whether a lower-cased word starts with a sign: # and % come before the digits, @ behind them."""
    return (word < "A") & ((word < "0") | (word >= "@"))


def _bit(ends: Column) -> tuple[Column, Column]:
    """The number of the bigint, in as many as there can be, and the bit in it."""
    return F.shiftright(ends.bitwiseAND(MOST_BITS - 1), 6).cast("int"), ends.bitwiseAND(63).cast("int")


def windows(
    df: DataFrame,
    keep: dict[str, str],
    text: str,
    size: int,
    lengths: Sequence[int] = (),
    known: Sequence[int] | None = None,
) -> DataFrame:
    """One row per window: columns `keep` (new name -> column), `at`, `n`, `kind`, `ends`, `window`, `values`.

    A window of kind TYPED is the hash of its `n` typed tokens; `values` has the tokens behind its
    placeholders, in order, and is null if there are none. Those in which most tokens are
    placeholders are left out, as they would match anything. Windows with placeholders come again
    as PLAIN, the hash of their words. INNER windows are plain too, one of each of `lengths` at
    every place of a text that is longer. `ends` hashes the first and the last token; with the bitmap
    `known` windows are left out whose ends are not in it.
    """
    kept = [F.col(f"`{c}`").alias(n) for n, c in keep.items()]
    given, n_signs = F.col(f"`{text}`"), len(SIGNS)
    signed_text = F.greatest(*[F.contains(given, F.lit(s)) for s in SIGNS])
    plain = F.when(signed_text, F.translate(given, "".join(SIGNS), " " * n_signs)).otherwise(given)
    # a sign before each capital inside a sentence, around each number and before its unit
    named = F.regexp_replace(plain, r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", NAME)
    counted = F.regexp_replace(named, NUMBERS, f" {NUMBER}$1$2$3 ")
    marked = F.regexp_replace(counted, rf"(?<=[0-9] {{1,2}})(?=(?:{UNITS})(?!\p{{L}}))", UNIT)
    has_values = F.contains("marked", F.lit(NUMBER)) | F.contains("marked", F.lit(NAME))
    words = F.split(F.lower("marked"), rf"[^\p{{L}}\p{{M}}\p{{N}}{''.join(SIGNS)}]+")
    # no row is filtered here: Spark would push that below the extraction and compute it twice
    split = df.select(*kept, marked.alias("marked")).select(
        *keep, F.array_remove(words, "").alias("words"), has_values.alias("has_values")
    )
    # each token is hashed once, and a window hashes these
    types = F.transform(
        "words", lambda w: F.xxhash64(F.when(_signed(w), F.left(w, F.lit(1))).otherwise(w))
    )
    typed = split.select(
        "*",
        F.when(F.col("has_values"), types)
        .otherwise(F.transform("words", lambda w: F.xxhash64(w)))
        .alias("types"),
    )
    marks = [F.xxhash64(F.lit(s)) for s in SIGNS]

    def bare(word: Column, i: Column) -> Column:
        token = F.get("types", i)
        return F.when(token.isin(*marks), F.xxhash64(F.substr(word, F.lit(2)))).otherwise(token)

    typed = typed.withColumn(
        "bare", F.when(F.col("has_values"), F.transform("words", bare)).otherwise(F.col("types"))
    )
    bits = None if known is None else F.from_json(F.lit(json.dumps(list(known))), "array<bigint>")

    def ends(i: Column, tokens: str, n: Column) -> Column:
        return F.xxhash64(F.get(tokens, i - 1), F.get(tokens, i + n - 2))

    def may_match(places: Column, tokens: str, n: Column) -> Column:
        if bits is None:
            return places

        def has(i: Column) -> Column:
            at, bit = _bit(ends(i, tokens, n))
            return F.getbit(F.get(bits, at.bitwiseAND(len(known) - 1)), bit) == 1

        return F.filter(places, has)

    def window(i: Column, kind: int, tokens: str, n: Column, values: Column) -> Column:
        return F.struct(
            i.alias("at"),
            n.alias("n"),
            F.lit(kind).alias("kind"),
            ends(i, tokens, n).alias("ends"),
            F.xxhash64(F.slice(tokens, i, n)).alias("window"),
            values.alias("values"),
        )

    def signs(i: Column) -> Column:
        return F.exists(F.slice("types", i, size), lambda token: token.isin(*marks))

    def values(i: Column) -> Column:
        """The values in a window; null, without a look at its words, if it has none."""
        signed = F.when(F.col("has_values"), signs(i)).otherwise(F.lit(False))
        return F.when(signed, F.filter(F.slice("words", i, size), _signed))

    no_values, no_places = F.lit(None).cast("array<string>"), F.array().cast("array<int>")
    n = F.least(F.size("words"), F.lit(size))
    some = F.size("words") > 0
    places = F.when(some, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(no_places)
    valued = F.when(
        F.col("has_values"), F.filter(may_match(places, "bare", n), signs)
    ).otherwise(no_places)
    cut = [
        F.transform(
            may_match(places, "types", n), lambda i: window(i, TYPED, "types", n, values(i))
        ),
        F.transform(valued, lambda i: window(i, PLAIN, "bare", n, no_values)),
    ]
    for length in lengths:
        inner = F.when(
            F.size("words") > length, F.sequence(F.lit(1), F.size("words") - length + 1)
        ).otherwise(no_places)
        m = F.lit(length)
        cut.append(
            F.transform(
                may_match(inner, "bare", m), lambda i: window(i, INNER, "bare", m, no_values)
            )
        )
    found = typed.select(*keep, F.inline(F.concat(*cut)))
    return found.where("values is null or 2 * size(values) <= " + str(size))


def item_windows(benchmark: DataFrame, item: str, text: str, size: int, min_words: int) -> DataFrame:
    """(item, item_at, n, ends, window, item_values, id, inside, item_windows, item_typed) of the items.

    Rows of one place share their `id`, the typed window, or the plain one where that is left out.
    """
    asked = windows(benchmark, {"item": item, "item_text": text}, text, size)
    enough = (F.col("n") >= min_words) | F.rlike("item_text", F.lit(UNSPACED))
    asked = asked.select(
        "item",
        F.col("at").alias("item_at"),
        "n",
        "ends",
        "window",
        F.col("values").alias("item_values"),
        ((F.col("n") < size) & enough).alias("inside"),
        F.when(F.col("kind") == TYPED, F.col("window")).alias("typed"),
    )
    place, whole = Window.partitionBy("item", "item_at"), Window.partitionBy("item")
    shape = F.max("typed").over(Window.partitionBy("item", "item_at"))
    asked = asked.withColumn(
        "id", F.struct(F.coalesce(shape, "window"), shape.isNotNull().alias("typed"))
    )
    whole = Window.partitionBy("item")
    return asked.select(
        *[c for c in asked.columns if c != "typed"],
        F.size(F.collect_set("id").over(whole)).alias("item_windows"),
        F.size(F.collect_set("typed").over(whole)).alias("item_typed"),
    )


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    min_windows: int = MIN_WINDOWS,
    broadcast_chars: int = BROADCAST_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """(doc, item, n_windows, item_windows, n_changed): the items that each document holds.

    `n_changed` counts the values of the item that stand for another value in the document.
    """
    asked = item_windows(benchmark, item, item_text, size, min_words)
    chars = benchmark.agg(F.sum(F.length(f"`{item_text}`"))).first()[0] or 0
    n_bits = min(max(1 << (8 * chars).bit_length(), LEAST_BITS), MOST_BITS)
    at, bit = _bit(F.col("ends"))
    one = F.lit(1).cast("bigint")
    # not more rows than the bitmap has numbers, however large the benchmark is
    summary = (
        asked.groupBy(at.bitwiseAND(n_bits // 64 - 1).alias("at"))
        .agg(
            F.bit_or(F.call_function("shiftleft", one, bit)).alias("bits"),
            F.collect_set(F.when(F.col("inside"), F.col("n"))).alias("lengths"),
        )
        .collect()
    )
    lengths = sorted({n for r in summary for n in r.lengths})
    known = None
    if chars <= broadcast_chars:
        found_bits = {r["at"]: r.bits for r in summary}
        known = [found_bits.get(i, 0) for i in range(n_bits // 64)]
    asked = asked.drop("n", "ends")
    held = windows(df, {"doc": key}, text, size, lengths, known).drop("n", "ends")
    hits = held.join(F.broadcast(asked) if chars <= broadcast_chars else asked, "window")
    hits = hits.where((F.col("kind") != INNER) | F.col("inside"))

    of_item = ["doc", "item", "item_windows", "item_typed"]
    none = F.array().cast("array<string>")
    same = F.coalesce("item_values", none) == F.coalesce("values", none)
    other = F.when(~same, F.arrays_zip("item_values", "values"))
    occurrences = hits.groupBy(*of_item, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.when(same, F.col("id"))).alias("equal"),
        F.collect_set(F.when(~same, F.struct("id", other.alias("pairs")))).alias("differ"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(other)))).alias("pairs"),
    )

    def again(p: Column, i: Column) -> Column:
        """Whether the pair before has the same value of the item."""
        return (i > 0) & (p["item_values"] == F.get("pairs", i - 1)["item_values"])

    several = F.transform(F.filter("pairs", again), lambda p: p["item_values"])
    judged = occurrences.withColumn("several", F.array_distinct(several))
    consistent = F.filter(
        "differ",
        lambda w: ~F.arrays_overlap(
            F.transform(w["pairs"], lambda p: p["item_values"]), F.col("several")
        ),
    )
    kept = judged.withColumn("kept", consistent)
    pairs = F.array_distinct(F.flatten(F.transform("kept", lambda w: w["pairs"])))
    changed = F.filter(pairs, lambda p: p["item_values"] != p["values"])
    windows_of = F.concat("equal", F.transform("kept", lambda w: w["id"]))
    found = (
        kept.select(*of_item, windows_of.alias("found"), F.size(changed).alias("changed"))
        .where(F.size("found") > 0)
        .groupBy(*of_item)
        .agg(
            F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
            F.min("changed").alias("n_changed"),
        )
        .withColumn("n_windows", F.size("found"))
    )

    def enough(n: Column, of: str) -> Column:
        return n >= F.least(F.lit(min_windows), F.ceil(F.col(of) / 2))

    n_typed = F.size(F.filter("found", lambda w: w["typed"]))
    typed = (F.col("item_typed") > 0) & enough(n_typed, "item_typed")
    return found.where(typed | enough(F.col("n_windows"), "item_windows")).select(
        "doc", "item", "n_windows", "item_windows", "n_changed"
    )


def remove_leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of `df` that hold no item. Rows of one key stay or go together."""
    path = fresh_path(df.sparkSession, "leaks")
    found = leaks(df, benchmark, key, text, **options)
    found.select(F.col("doc").alias("leaked")).distinct().write.parquet(path)
    # written first, so that Spark knows its size when it chooses the join
    leaked = df.sparkSession.read.parquet(path)
    return df.join(leaked, df[f"`{key}`"].eqNullSafe(F.col("leaked")), "left_anti")
