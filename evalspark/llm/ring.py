"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed grid of slots. Every shard has virtual nodes on it, and a row belongs to the
first node clockwise of its slot. A shard takes rows up to its capacity; further rows go on
clockwise to the next node whose shard has room. The capacities add up to the number of rows and
differ by one at most, so the counts do too, and a row leaves its node's shard only if that is full.

How many rows a slot holds, and how its rows rank among themselves, is all that decides. So the ring
is filled from one count per slot, whose number is a parameter, and rows look up their place. Equal
rows are counted first and numbered afterwards, so many copies of one row do not meet in a task.

The place of a row follows from its key, size and checksum, so a key that many rows share is spread.
A null key is a value like others, a null text has no bytes. Rows equal in key, size and checksum
are interchangeable. An empty table gives an empty result. Only key and text are read, so other
columns cannot clash with results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import fresh_path

#: Bytes a row counts besides its text.
OVERHEAD = 16
#: Slots of the ring, as a power of two: the number of rows that the driver sees.
GRID_BITS = 16
PLACES = "slot_of_ring int, places array<struct<upto bigint, shard int, base bigint>>"


def nodes(shards: int, per_shard: int, grid_bits: int) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, in the order of the ring."""
    return sorted(
        (int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8]) >> (64 - grid_bits), s)
        for s in range(shards)
        for v in range(per_shard)
    )


def fill(
    ring: list[tuple[int, int]], counts: dict[int, int], shards: int
) -> dict[int, list[tuple[int, int, int]]]:
    """Where the rows of each slot go: slot -> [(rank up to which, shard, position of rank 0)].

    Every node first keeps what its shard has room for, then the rest goes on clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    placed = dict.fromkeys(counts, 0)
    places: dict[int, list[tuple[int, int, int]]] = {slot: [] for slot in counts}

    def put(slot: int, shard: int) -> None:
        rows = min(counts[slot] - placed[slot], room[shard] - filled[shard])
        if rows:
            places[slot].append((placed[slot] + rows, shard, filled[shard] - placed[slot]))
            placed[slot] += rows
            filled[shard] += rows

    home, node = {}, 0
    for slot in sorted(counts):
        while node < len(ring) and ring[node][0] < slot:
            node += 1
        home[slot] = node % len(ring)
        put(slot, ring[home[slot]][1])
    for slot, node in home.items():
        while placed[slot] < counts[slot]:
            node = (node + 1) % len(ring)
            put(slot, ring[node][1])
    return places


def assign(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    per_shard: int = 64,
    grid_bits: int = GRID_BITS,
) -> DataFrame:
    """One row per row of `df`: `key`, `size`, `text_crc32`, `shard` and `slot`.

    `slot` numbers the rows of a shard from 0 without a gap.
    """
    spark = df.sparkSession
    content = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(content) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    counted = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("copies"))
    hashed = counted.withColumn("hash", F.xxhash64("key", "size", "text_crc32"))
    placed = hashed.withColumn(
        "slot_of_ring", F.shiftrightunsigned("hash", 64 - grid_bits).cast("int")
    )
    path = fresh_path(spark, "ring")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)

    counts = placed.groupBy("slot_of_ring").agg(F.sum("copies")).collect()  # one row per slot
    places = fill(nodes(shards, per_shard, grid_bits), dict(map(tuple, counts)), shards)
    table = spark.createDataFrame(list(places.items()), PLACES)
    order = Window.partitionBy("slot_of_ring").orderBy("hash", "key", "size", "text_crc32")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn("first", upto - F.col("copies"))
        .join(F.broadcast(table), "slot_of_ring")
        .withColumn("rank", F.explode(F.expr("sequence(first, first + copies - 1)")))
        .withColumn("place", F.expr("filter(places, p -> rank < p.upto)[0]"))
        .select(
            "key",
            "size",
            "text_crc32",
            F.col("place.shard").alias("shard"),
            (F.col("place.base") + F.col("rank")).alias("slot"),
        )
    )
