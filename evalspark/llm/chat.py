"""Chat formatting at the level of tokens.

A turn becomes: start id, role, separator id, text, end id. Role and text are encoded by themselves
as ordinary text, and the three reserved ids, just above the vocabulary, are spliced in between, so
no text can make a control token. In the text form control strings stand for the reserved ids; a
`<|`, also one with backslashes between, gets one backslash more inside roles and texts, which is
undone when reading back. The loss mask covers exactly the text tokens of the chosen roles; it is
the prefix sum of +1 where such a text starts and -1 where it ends.

A turn is a row. Where it starts within its conversation is a prefix sum in two levels, over the
turns of a block of consecutive turn numbers and over the blocks, so that a long conversation is
split. Turns are ordered by number, a missing number first; turns of equal number by role and by a
hash of the text. A null role or text is empty, null conversation ids are one conversation; ids may
be numbers or strings. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.llm.batches import map_texts
from evalspark.llm.bpe import Encoder, Vocabulary
from evalspark.session import fresh_path

CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: Consecutive turn numbers that are added up together.
BLOCK_TURNS = 1024


def escape(text: str) -> str:
    """The text with one more backslash in every `<|`, `<\\|`, `<\\\\|` and so on."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def reserved(vocabulary: Vocabulary) -> tuple[int, int, int]:
    """Ids of start, separator and end."""
    first = int(vocabulary.ids.max()) + 1
    return first, first + 1, first + 2


class Formatter:
    """Ids, loss masks and sizes of turns."""

    def __init__(self, vocabulary: Vocabulary, loss_roles: Sequence[str]) -> None:
        self.encoder = Encoder(vocabulary)
        self.controls = [np.array([i], dtype=np.int32) for i in reserved(vocabulary)]
        self.loss_roles = frozenset(loss_roles)

    def turns(self, roles: Sequence[str], texts: Sequence[str]) -> list:
        safe = [*map(escape, roles), *map(escape, texts)]
        coded = self.encoder.encode(safe)
        values, bounds = coded.values.to_numpy(), coded.offsets.to_numpy()
        segments = [values[a:b] for a, b in zip(bounds, bounds[1:])]
        start, middle, end = self.controls
        ids, masks, n = [], [], len(roles)
        for i, role in enumerate(roles):
            head, body = segments[i], segments[n + i]
            ids.append(np.concatenate((start, head, middle, body, end)))
            edge = np.zeros(len(ids[-1]) + 1, dtype=np.int8)
            if role in self.loss_roles:
                edge[len(head) + 2] += 1
                edge[len(head) + 2 + len(body)] -= 1
            masks.append(np.cumsum(edge[:-1], dtype=np.int8))
        fixed = sum(map(len, CONTROLS))
        chars = [fixed + len(r) + len(t) for r, t in zip(safe[:n], safe[n:])]
        return [
            pa.array(ids, type=pa.list_(pa.int32())),
            pa.array(masks, type=pa.list_(pa.int8())),
            chars,
        ]


def format_turns(
    df: DataFrame,
    vocabulary: Broadcast,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per turn: `conv`, `place` (from 0), `ids`, `loss_mask`, `n_chars` of its text form,
    and `token_start` and `char_start`, its distance from the start of the conversation."""

    def make() -> Callable[..., list]:
        formatter = Formatter(vocabulary.value, loss_roles)

        def run(texts: list, kept: list) -> list:
            roles = [r or "" for r in kept[2].to_pylist()]
            return formatter.turns(roles, [t or "" for t in texts])

        return run

    source = df.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.col(f"`{text}`").alias("text"),
        F.xxhash64(f"`{text}`").alias("tie"),
    )
    fields = {"ids": "array<int>", "loss_mask": "array<tinyint>", "n_chars": "bigint"}
    made = map_texts(source, "text", make, fields, ("conv", "turn", "role", "tie"), True)
    # written, as both the turns and the totals of their blocks are read from it: encoded once
    path = fresh_path(df.sparkSession, "turns")
    made.select("kept.*", "out.*").write.parquet(path)
    turns = df.sparkSession.read.parquet(path).withColumn(
        "block", F.floor(F.col("turn") / block_turns)
    )
    sizes = {"place": F.lit(1), "token_start": F.size("ids"), "char_start": F.col("n_chars")}
    inside = Window.partitionBy("conv", "block").orderBy(
        F.col("turn").asc_nulls_first(), "role", "tie"
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    placed = turns.select(
        "*", *[F.coalesce(F.sum(c).over(before), zero).alias(n) for n, c in sizes.items()]
    )
    totals = turns.groupBy("conv", "block").agg(*[F.sum(c).alias(n) for n, c in sizes.items()])
    earlier = (
        Window.partitionBy("conv")
        .orderBy(F.col("block").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        F.col("conv").alias("of_conv"),
        F.col("block").alias("of_block"),
        *[F.coalesce(F.sum(n).over(earlier), zero).alias(f"{n}_before") for n in sizes],
    )
    same = F.col("conv").eqNullSafe(F.col("of_conv")) & F.col("block").eqNullSafe(
        F.col("of_block")
    )
    return placed.join(offsets, same).select(
        "conv",
        "ids",
        "loss_mask",
        "n_chars",
        *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in sizes],
    )


def read_turns(turns: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """What formatted turns say, from `ids` and `loss_mask` alone.

    `conv`, `place`, `role`, `text` and `loss_text` (unescaped) and `rendered`, the text form.
    """
    source = turns.select("conv", "place", "ids", "loss_mask")
    schema = StructType([source.schema["conv"], *StructType.fromDDL(
        "place bigint, role string, text string, loss_text string, rendered string"
    )])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = dict(vocabulary.value.tokens)
        controls = reserved(vocabulary.value)
        tokens |= {i: c.encode() for i, c in zip(controls, CONTROLS)}

        def said(ids: np.ndarray) -> str:
            return b"".join(map(tokens.__getitem__, ids.tolist())).decode()

        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column(2), batch.column(3)):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                middle = int(np.flatnonzero(ids == controls[1])[0])
                if ids[0] != controls[0] or ids[-1] != controls[2]:
                    raise ValueError("a turn starts and ends with its reserved ids")
                parts = (ids[1:middle], ids[middle + 1 : -1], ids[mask == 1])
                rows.append([*(unescape(said(p)) for p in parts), said(ids)])
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(list(c), pa.string()) for c in columns]],
                names=["conv", "place", "role", "text", "loss_text", "rendered"],
            )

    return source.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation the digests of what `read_turns` gave, in the order of its turns.

    A digest depends on everything before, so a conversation is read in order, turn by turn, without
    being held.
    """
    schema = StructType([turns.schema["conv"], *StructType.fromDDL(
        "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, nothing, kind = None, object(), None
        now = nothing
        for batch in batches:
            ended, kind = [], batch.schema.field(0).type
            columns = [c.to_pylist() for c in batch.columns]
            for conv, role, text, loss, size in zip(*columns):
                if conv != now:
                    if now is not nothing:
                        ended.append((now, *state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
            yield _rows(ended, kind)
        if now is not nothing:
            yield _rows([(now, *state)], kind)

    def _rows(ended: list, kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        plain = [(c, n, a.hexdigest(), k, b.hexdigest(), f) for c, n, a, k, b, f in ended]
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = list(zip(*plain)) if plain else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=names
        )

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "place")
    needed = ordered.select("conv", "role", "text", "loss_text", F.length("rendered").cast("bigint"))
    return needed.mapInArrow(run, schema)
