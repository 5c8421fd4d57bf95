"""Near-duplicate documents by SetSketch.

A document's set are its word shingles. Its sketch has one register per hash function: the smallest
of exponentially distributed values of its shingles, truncated to a whole power of a base close to
one. Registers of a union are the maxima of the registers, and two registers are equal about as
often as the sets overlap.

1. Documents with equal sets become one node, the smallest key among them.
2. Nodes with an equal band of registers belong to one family (connected components).
3. Within a family, the overlap of two nodes is estimated jointly from the registers that are
   greater, less and equal; pairs that may reach the threshold are verified on their full sets,
   those most alike first, unless they are connected already.
4. Verified links give the components.

A family of any size is worked on in blocks: first each block by itself together with some pivots of
the family, then only pairs of blocks whose nodes are not yet connected, until every pair of
unconnected nodes has been looked at. No task holds more than two blocks and the pivots.

Words are lower-cased (A-Z) runs of anything but the six ASCII white space characters. A null or
empty text, or one of white space, has no set, and is a component of its own. A text with fewer
words than a shingle has them all as its one shingle. Rows of one key are one document, also null
keys. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.batches import map_texts
from evalspark.llm.components import components
from evalspark.session import fresh_path

NO_KEY = -(1 << 63)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a task remembers; beyond it, it starts anew.
REMEMBERED = 1_000_000


@dataclass(frozen=True)
class Sketch:
    """Shape of the sketch and of the search.

    40 bands of 6 registers miss a pair at 0.85 with a probability below 1e-8.
    """

    words: int = 5
    percent: int = 85
    bands: int = 40
    band_registers: int = 6
    base: float = 1.001
    rate: float = 20.0
    #: below the threshold by this much, an estimate (standard error 0.023) rules a pair out
    margin: float = 0.12
    block: int = 400
    pivots: int = 32

    @property
    def registers(self) -> int:
        return self.bands * self.band_registers


# ---- sets and registers ----


class Shingler:
    """Sets of shingle hashes: sorted, distinct 64-bit numbers."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def sets(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        found = [(t or "").encode().lower().split() for t in texts]
        new = set().union(*found)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        for word in new:
            if word not in self.known:
                self.known[word] = xxhash.xxh3_64_intdigest(word)
        return [self._set(np.array([*map(self.known.__getitem__, f)], np.uint64)) for f in found]

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        size = min(self.words, len(words))
        n = len(words) - size + 1
        mixed = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            mixed = (mixed ^ words[i : i + n]) * STEP
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


class Sketcher:
    """Registers of sets."""

    def __init__(self, shape: Sketch) -> None:
        self.shape = shape
        rng = np.random.default_rng(20_240_601)
        m = shape.registers
        self.mask = rng.integers(0, 1 << 32, (m, 1), dtype=np.uint32)
        self.factor = rng.integers(0, 1 << 31, (m, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def smallest(self, shingles: np.ndarray) -> np.ndarray:
        """Per register the smallest 32-bit hash of the set."""
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.mask), np.uint32(0xFFFFFFFF))
        for a in range(0, len(low), 2048):
            hashed = (low[a : a + 2048][None, :] ^ self.mask) * self.factor
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x2C1B3C6D)
            np.minimum(least, hashed.min(axis=1), out=least)
        return least

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        uniform = (self.smallest(shingles).astype(np.float64) + 0.5) / 2.0**32
        value = -np.log1p(-uniform) / self.shape.rate
        level = np.floor(1 - np.log(value) / np.log(self.shape.base))
        return np.clip(level, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def slope(
    jaccard: np.ndarray | float,
    greater: np.ndarray,
    less: np.ndarray,
    equal: np.ndarray,
    share: np.ndarray,
    base: float,
) -> np.ndarray:
    """Derivative of the joint log-likelihood of the register comparisons by the overlap.

    `share` is the first set's size divided by the sum of both. The likelihood is concave, so its
    maximum lies above an overlap where this is positive.
    """
    tiny = 1e-12
    c = (base - 1) / base
    x, y = share - (1 - share) * jaccard, (1 - share) - share * jaccard
    x, y = np.maximum(x, tiny), np.maximum(y, tiny)
    log = np.log(base)
    p, q = -np.log1p(-c * x) / log, -np.log1p(-c * y) / log
    dp = -(1 - share) * c / (1 - c * x) / log
    dq = -share * c / (1 - c * y) / log
    same = np.maximum(1 - p - q, tiny)
    return greater * dp / p + less * dq / q - equal * (dp + dq) / same


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, base: float) -> float:
    """The overlap (Jaccard) of two sets of known size, by maximum likelihood."""
    share = n_a / (n_a + n_b)
    low, high = 0.0, min(n_a, n_b) / max(n_a, n_b)
    counts = ((a > b).sum(), (a < b).sum(), (a == b).sum())
    for _ in range(40):
        middle = (low + high) / 2
        if slope(middle, *counts, share, base) > 0:
            low = middle
        else:
            high = middle
    return (low + high) / 2


# ---- links within a block ----


class Forest:
    """Which nodes are connected so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        top = node
        while (up := self.parent.get(top, top)) != top:
            top = up
        while node != top:
            self.parent[node], node = top, self.parent.get(node, node)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def candidates(registers: np.ndarray, sizes: np.ndarray, shape: Sketch) -> list[tuple[int, int]]:
    """Pairs of rows that may reach the threshold, those with most equal registers first."""
    found = []
    wanted = shape.percent / 100
    for i in range(len(sizes) - 1):
        a, b = sizes[i], sizes[i + 1 :]
        js = np.flatnonzero(100 * np.minimum(a, b) >= shape.percent * np.maximum(a, b))
        if not len(js):
            continue
        other = registers[i + 1 + js]
        equal = (registers[i] == other).sum(axis=1)
        greater = (registers[i] > other).sum(axis=1)
        less = shape.registers - equal - greater
        share = a / (a + b[js])
        up = slope(wanted - shape.margin, greater, less, equal, share, shape.base) >= 0
        found += zip((-equal[up]).tolist(), [i] * int(up.sum()), (i + 1 + js[up]).tolist())
    return [(i, j) for _, i, j in sorted(found)]


def links(
    nodes: Sequence[int],
    labels: Sequence[int],
    sets: Sequence[np.ndarray],
    registers: np.ndarray,
    shape: Sketch,
) -> list[tuple[int, int]]:
    """Verified links that connect what is connected among these nodes.

    Nodes with one label are connected already.
    """
    forest = Forest()
    for node, label in zip(nodes, labels):
        forest.join(node, label)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    found = []
    for i, j in candidates(registers, sizes, shape):
        if forest.root(nodes[i]) == forest.root(nodes[j]):
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= shape.percent * int(sizes[i] + sizes[j] - common):
            forest.join(nodes[i], nodes[j])
            found.append((nodes[i], nodes[j]))
    return found


# ---- tables ----


def _written(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _node(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_KEY))


def sketches(df: DataFrame, key: str, text: str, shape: Sketch) -> DataFrame:
    """(key, n_shingles, fingerprint, sketch) of every row; the last two null without a set."""

    def make() -> Callable[[list], list]:
        shingler, sketcher = Shingler(shape.words), Sketcher(shape)

        def run(texts: list) -> list:
            sets = shingler.sets(texts)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return [
                [len(s) for s in sets],
                prints,
                [sketcher.registers(s).tobytes() if len(s) else None for s in sets],
            ]

        return run

    fields = {"n_shingles": "bigint", "fingerprint": "binary", "sketch": "binary"}
    out = map_texts(df, text, make, fields, (key,))
    return out.select(F.col(f"kept.`{key}`").alias("key"), "out.*")


def family_links(nodes: DataFrame, shape: Sketch) -> DataFrame:
    """(u, v): every node that shares a band of registers, with the smallest node of that band."""
    width = 2 * shape.band_registers
    bands = [
        F.xxhash64(F.lit(i), F.substring("sketch", 1 + width * i, width)) for i in range(shape.bands)
    ]
    placed = nodes.select("node", F.explode(F.array(*bands)).alias("band"))
    shared = (
        placed.groupBy("band")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
        .select("band", "low")
    )
    return (
        placed.join(shared, "band")
        .where("node != low")
        .select(F.col("node").alias("u"), F.col("low").alias("v"))
    )


def family_sets(df: DataFrame, members: DataFrame, key: str, text: str, shape: Sketch) -> DataFrame:
    """The rows of `members` with the full set of each node's text, as packed numbers."""

    def make() -> Callable[[list], list]:
        shingler = Shingler(shape.words)
        return lambda texts: [[s.tobytes() for s in shingler.sets(texts)]]

    texts = df.select(_node(key).alias("node"), F.col(f"`{text}`").alias("text"))
    chosen = texts.join(members, "node")
    out = map_texts(chosen, "text", make, {"shingles": "binary"}, members.columns)
    # a key with several texts has a set for each, and no set for an empty one
    return out.select("kept.*", "out.shingles").where(F.length("shingles") > 0)


def block_links(blocks: DataFrame, shape: Sketch) -> DataFrame:
    """(u, v): links found in each group of rows with one `task`; at most a tree per group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sketcher = Sketcher(shape)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        registers = np.stack([sketcher.registers(s) for s in sets])
        nodes = table.column("node").to_pylist()
        found = links(nodes, table.column("label").to_pylist(), sets, registers, shape)
        return pa.table(
            {"u": pa.array([a for a, _ in found], pa.int64()),
             "v": pa.array([b for _, b in found], pa.int64())}
        )

    grouped = blocks.select("task", "node", "label", "shingles").groupBy("task")
    return grouped.applyInArrow(run, "u bigint, v bigint")


def _labelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """`sets` with the component of each node so far as `label`."""
    known = components(found).withColumnsRenamed({"component": "label"})
    return sets.drop("label").join(known, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )


def verified_links(sets: DataFrame, shape: Sketch) -> DataFrame:
    """(u, v): links that connect what is connected, from (family, size, node, shingles).

    `size` is the number of nodes of the family.
    """
    n_blocks = F.ceil(F.col("size") / shape.block)
    placed = sets.withColumn("label", F.col("node")).withColumn("n_blocks", n_blocks)
    own = F.array(F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    chance = F.ceil(F.col("size") / shape.pivots)
    is_pivot = (F.col("n_blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), chance) == 0)
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)
    first = placed.withColumn("at", F.explode(F.when(is_pivot, everywhere).otherwise(own)))
    first = first.withColumn("task", F.xxhash64("family", "at"))
    found = _written(block_links(first, shape), "near")

    large = placed.where("n_blocks > 1")
    if large.isEmpty():
        return found
    # what is still unconnected: a label with a block's worth of nodes gets blocks of its own, the
    # rest is mixed; two blocks of one label need no look
    labelled = _written(_labelled(large, found), "labelled")
    of_label = labelled.groupBy("family", "label").agg(F.count("*").alias("n"))
    open_families = of_label.groupBy("family").agg(F.count("*").alias("labels")).where("labels > 1")
    mixed = F.sum(F.when(F.col("n") < shape.block, F.col("n")).otherwise(0))
    n_mixed = of_label.groupBy("family").agg(
        F.greatest(F.ceil(mixed / shape.block), F.lit(1)).alias("n_mixed")
    )
    blocked = (
        labelled.join(of_label, ["family", "label"])
        .join(open_families.select("family"), "family")
        .join(n_mixed, "family")
        .withColumn("pure", F.when(F.col("n") >= shape.block, F.col("label")))
        .withColumn(
            "at",
            F.pmod(
                F.xxhash64("node", F.lit(2)),
                F.when(F.col("pure").isNull(), F.col("n_mixed")).otherwise(
                    F.ceil(F.col("n") / shape.block)
                ),
            ),
        )
        .withColumn("block", F.xxhash64("family", F.coalesce("pure", F.lit(-1)), "at"))
        .select("family", "node", "label", "shingles", "pure", "block")
    )
    blocked = _written(blocked, "blocked")
    blocks = blocked.select("family", "pure", "block").distinct()
    other = blocks.select(
        "family", F.col("pure").alias("other_pure"), F.col("block").alias("other")
    )
    pairs = blocks.join(other, "family").where(
        "block <= other and (pure is null or other_pure is null or pure != other_pure)"
    )
    tasks = pairs.select(
        F.xxhash64("block", "other").alias("task"),
        F.explode(F.array_distinct(F.array("block", "other"))).alias("block"),
    )
    rest = blocked.join(tasks, "block")
    return found.unionAll(_written(block_links(rest, shape), "near"))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", shape: Sketch = Sketch()
) -> DataFrame:
    """(key, n_shingles, component) of every row: the smallest key reachable over links.

    Two documents are linked if their overlap is at least `percent` of their union.
    """
    rows = _written(sketches(df, key, text, shape), "sketches")
    with_set = rows.where("fingerprint is not null").withColumn("node", _node("key"))
    classes = with_set.groupBy("fingerprint").agg(F.min("node").alias("low"))
    classes = _written(classes, "classes")
    chosen = classes.select(F.col("low").alias("node"), "fingerprint")
    nodes = with_set.join(chosen, ["node", "fingerprint"]).select("node", "sketch")
    families = _written(components(family_links(nodes, shape)), "families")
    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    members = _written(
        families.join(sizes, "component").withColumnsRenamed({"component": "family"}), "members"
    )
    sets = _written(family_sets(df, members, key, text, shape), "sets")
    found = components(verified_links(sets, shape))
    named = _written(
        classes.join(found, classes["low"] == found["node"], "left").select(
            "fingerprint", F.coalesce("component", "low").alias("component")
        ),
        "named",
    )
    joined = rows.join(named, "fingerprint", "left")
    component = F.coalesce("component", _node("key"))
    return joined.select(
        "key", "n_shingles", F.nullif(component, F.lit(NO_KEY)).alias("component")
    )


def keep_first(
    df: DataFrame, key: str = "doc_id", text: str = "text", shape: Sketch = Sketch()
) -> DataFrame:
    """The rows of `df` whose key is the smallest of its component; rows of one key stay together."""
    found = near_duplicates(df, key, text, shape)
    # written first, so that Spark knows its size when it chooses the join
    others = _written(
        found.where("key is not null and not key <=> component").select(F.col("key").alias("copy")),
        "copies",
    )
    return df.join(others, df[f"`{key}`"] == others["copy"], "left_anti")
