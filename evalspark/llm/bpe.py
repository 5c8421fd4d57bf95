"""Byte-level BPE encoding and decoding.

A text is split by a pattern into pre-tokens, each encoded by itself. Two tiers: a minimal perfect
hash resolves pre-tokens that are tokens themselves; the others are merged with a heap of
neighbouring pairs over a linked list of their bytes. Equal to the tiktoken library with the same
ranks and pattern and no special tokens.

Null texts count as empty: no ids, no bytes. Any other column of the table is left alone.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.batches import map_texts
from evalspark.llm.phash import PerfectHash

#: Encoded pre-tokens a task remembers; beyond it, it starts anew.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Tokens and ranks of a rank file: a base64 token and its rank per line."""
    lines = Path(path).read_bytes().splitlines()
    return [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x.strip())]


class Vocabulary:
    """What tasks need of a rank file: its perfect hash, ranks and tokens. Bounded by the file."""

    def __init__(self, path: str, pattern: str) -> None:
        pairs = read_ranks(path)
        self.pattern = pattern
        self.ids = np.array([r for _, r in pairs], dtype=np.int64)
        self.hash = PerfectHash([t for t, _ in pairs])
        self.ranks = dict(pairs)
        self.tokens = {r: t for t, r in pairs}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always join the neighbours of lowest rank, the leftmost first.

    `end[i]` is where the part that starts at byte i ends, `before[i]` where the one before it
    starts. A heap entry is stale once its left part is gone or one of the two parts has grown.
    """
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get, bits = ranks.get, n.bit_length()
    low = (1 << bits) - 1
    # an entry holds rank, start and end of the joined part in one number
    heap = [
        (rank << bits | i) << bits | (i + 2)
        for i in range(n - 1)
        if (rank := get(piece[i : i + 2])) is not None
    ]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        stop, i = entry & low, entry >> bits & low
        middle = end[i]
        if middle < 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (rank := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank << bits | i) << bits | end[stop])
        if i and (rank := get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (rank << bits | before[i]) << bits | stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def unicode_spaces(pattern: str) -> str:
    """The pattern with white space as the Unicode property, which here `\\s` alone is not."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Encoder:
    """Encodes lists of texts; remembers the ids of pre-tokens, as packed integers, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.vocabulary = vocabulary
        self.split = regex.compile(unicode_spaces(vocabulary.pattern)).findall
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Adds distinct pre-tokens to the known ones."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = list(pieces)
        raw = [p.encode() for p in new]
        ranks, found = self.vocabulary.ranks, self.vocabulary.hash.lookup(raw)
        for piece, data, i in zip(new, raw, found):
            ids = (self.vocabulary.ids[i],) if i >= 0 else merge(data, ranks)
            self.known[piece] = np.array(ids, dtype=np.int32).tobytes()

    def encode(self, texts: Sequence[str | None]) -> pa.ListArray:
        """One list of ids per text."""
        pieces = [self.split(text or "") for text in texts]
        self.learn(set().union(*pieces))
        packed = [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        ends = np.cumsum([0, *map(len, packed)]) // 4
        flat = np.frombuffer(b"".join(packed), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))


def decode_ids(lists: pa.ListArray, tokens: dict[int, bytes]) -> list[bytes]:
    """Bytes of each list of ids."""
    values = list(map(tokens.__getitem__, lists.values.to_numpy().tolist()))
    bounds = lists.offsets.to_numpy().tolist()
    return [b"".join(values[a:b]) for a, b in zip(bounds, bounds[1:])]


def load(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The vocabulary, read by the driver; the file bounds its size."""
    return spark.sparkContext.broadcast(Vocabulary(path, pattern))


def encode(
    df: DataFrame, vocabulary: Broadcast, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` and `ids` (array of int) of every row; a null or empty text has none."""

    def make() -> Callable[[list], list]:
        encoder = Encoder(vocabulary.value)
        return lambda texts: [encoder.encode(texts)]

    return map_texts(df, text, make, {"ids": "array<int>"}, keep).select("kept.*", "out.ids")


def round_trip(
    df: DataFrame, vocabulary: Broadcast, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Like `encode`, with the bytes that the ids decode to in `decoded`."""

    def make() -> Callable[[list], list]:
        encoder, tokens = Encoder(vocabulary.value), vocabulary.value.tokens

        def run(texts: list) -> list:
            ids = encoder.encode(texts)
            return [ids, decode_ids(ids, tokens)]

        return run

    fields = {"ids": "array<int>", "decoded": "binary"}
    return map_texts(df, text, make, fields, keep).select("kept.*", "out.*")


def decode(
    df: DataFrame, vocabulary: Broadcast, ids: str = "ids", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` and `decoded` (binary) of every row; null ids decode to no bytes.

    An id outside the vocabulary raises KeyError.
    """
    source = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{ids}`").alias("ids")
    )
    schema = source.select("kept").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value.tokens
        for batch in batches:
            found = [
                b"".join(map(tokens.__getitem__, row or ())) for row in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, type=pa.binary())], names=["kept", "decoded"]
            )

    return source.mapInArrow(run, schema).select("kept.*", "decoded")
