"""Ranked lexical search of many queries at once, with what they share computed once.

Queries are taken in blocks of bounded text. For each block:

1. The documents are reduced to their postings of the block's terms, which are written: these
   accumulators serve every query, and the statistics are counted from them.
2. Shared term sets are mined. Terms that the same queries hold are one leaf. Each query lists its
   leaves, the most shared first, and pairs of neighbours that several queries have become a node
   that adds the two; nodes pair up again until no pair is shared. The nodes form a graph along
   which queries share partial sums.
3. Each task adds up the graph for some documents at a time, as columns of integers, and keeps the
   best of each query. The best of all tasks are ranked by query.

Scores are sums of integers, so any order of adding gives the same.

A term is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. A
null or empty text has no term: such a document is not counted and no result, such a query has no
result. Documents are rows, so a repeated row is ranked twice. Equal scores are ranked by key, null
last; keys are integers. Every row of `queries` is a query of its own, also under a repeated or null
key. An empty table on either side gives no rows. Only the named columns are read, so others cannot
clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StructType

from evalspark.session import fresh_path

LIMIT = 50
#: Characters of queries that are evaluated together; a longer query comes alone.
BLOCK_CHARS = 1_000_000
#: Bytes of a text whose terms are in memory at once, and entries of the accumulators of a task.
RUN_BYTES = 1 << 22
CELLS = 1 << 22

_SEPARATORS = bytes(i for i in range(128) if not chr(i).isalnum())
_PLAIN = bytes.maketrans(
    _SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz",
)


def term_runs(text: bytes, size: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    plain = text.translate(_PLAIN)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + size)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


@dataclass(frozen=True)
class SharedPlan:
    """Sums along a graph: node `leaves + i` adds the two nodes `sums[i]`, a query its `roots`."""

    leaf_of_term: np.ndarray
    leaves: int
    sums: list[tuple[int, int]]
    roots: list[list[int]]

    def additions(self) -> int:
        return len(self.sums) + sum(max(0, len(r) - 1) for r in self.roots)


def share(queries: Sequence[Sequence[int]], n_terms: int) -> SharedPlan:
    """Mines the term sets that queries (lists of distinct terms) share."""
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for q, terms in enumerate(queries):
        for t in terms:
            holders[t].append(q)
    leaf_of: dict[tuple[int, ...], int] = {}
    leaf_of_term = np.array(
        [leaf_of.setdefault(tuple(h), len(leaf_of)) for h in holders], dtype=np.int64
    )
    lists: list[list[int]] = [[] for _ in queries]
    # the most shared first, so that queries with the same frequent terms have the same neighbours
    for held, leaf in sorted(leaf_of.items(), key=lambda x: (-len(x[0]), x[1])):
        for q in held:
            lists[q].append(leaf)

    leaves, sums = len(leaf_of), []
    while True:
        counts = Counter(pair for nodes in lists for pair in zip(nodes, nodes[1:]))
        chosen = [_disjoint_pairs(nodes, counts) for nodes in lists]
        used = Counter(tuple(nodes[i : i + 2]) for nodes, at in zip(lists, chosen) for i in at)
        node_of = {}
        for pair, n in used.items():
            if n > 1:
                node_of[pair] = leaves + len(sums)
                sums.append(pair)
        if not node_of:
            return SharedPlan(leaf_of_term, leaves, sums, lists)
        lists = [_with_pairs(nodes, at, node_of) for nodes, at in zip(lists, chosen)]


def _disjoint_pairs(nodes: list[int], counts: Counter) -> list[int]:
    """Places of pairs that several queries have; of two that overlap the more frequent one."""
    at, i = [], 0
    while i + 1 < len(nodes):
        own = counts[nodes[i], nodes[i + 1]]
        after = counts[nodes[i + 1], nodes[i + 2]] if i + 2 < len(nodes) else 0
        if own > 1 and own >= after:
            at.append(i)
            i += 1
        i += 1
    return at


def _with_pairs(nodes: list[int], at: list[int], node_of: dict) -> list[int]:
    out, i, places = [], 0, set(at)
    while i < len(nodes):
        node = node_of.get(tuple(nodes[i : i + 2])) if i in places else None
        out.append(nodes[i] if node is None else node)
        i += 1 if node is None else 2
    return out


def weights(n_docs: int, found_in: np.ndarray) -> np.ndarray:
    """The weight of each term by the number of documents that hold it."""
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in found_in],
        dtype=np.int64,
    )


def _blocks(queries: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """(key, text) of all queries, as lists of bounded text; one such list is held at a time."""
    block, size = [], 0
    for key, text in queries.toLocalIterator():
        if block and size + len(text or b"") > limit:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text or b"")
    if block:
        yield block


def _postings(texts: DataFrame, term_ids: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs): each row's number of terms, and how often it has those of the block."""
    schema = StructType.fromDDL("doc bigint, n bigint, terms array<int>, tfs array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                held, total = Counter(), 0
                for terms in term_runs(text or b""):
                    total += len(terms)
                    held.update(map(term_ids.get, terms))
                held.pop(None, None)
                n.append(total)
                found.extend(held.items())
                ends.append(len(found))
            flat = np.array(found, dtype=np.int64).reshape(-1, 2)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(column, kind))
                for column, kind in ((flat[:, 0], pa.int32()), (flat[:, 1], pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *lists], names=schema.names
            )

    return texts.mapInArrow(run, schema)


class _Best:
    """The best documents of each query so far."""

    def __init__(self, n_queries: int, limit: int):
        self.limit, self.least = limit, np.ones(n_queries, dtype=np.int64)
        self.rows = np.empty((4, 0), dtype=np.int64)  # query, score, key, whether it is null
        self.waiting: list[np.ndarray] = []

    def add(self, scores: np.ndarray, keys: np.ndarray, null: np.ndarray) -> None:
        q, d = np.nonzero(scores >= self.least[:, None])
        self.waiting.append(np.stack([q, scores[q, d], keys[d], null[d]]))
        if sum(w.shape[1] for w in self.waiting) > 4 * len(self.least) * self.limit:
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.waiting], axis=1)
        self.waiting = []
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        starts = np.searchsorted(rows[0], rows[0])
        self.rows = rows = rows[:, np.arange(rows.shape[1]) - starts < self.limit]
        query, score = rows[0], rows[1]
        last = np.flatnonzero(np.diff(np.append(query, -1)))
        full = np.bincount(query, minlength=len(self.least))[query[last]] == self.limit
        self.least[query[last][full]] = score[last][full]
        return rows


def _best_of_tasks(
    postings: DataFrame, plan: SharedPlan, weight: np.ndarray, n_docs: int, n_terms: int, limit: int
) -> DataFrame:
    """(query, doc, score): for each task and query the best documents."""
    schema = StructType.fromDDL("query int, doc bigint, score bigint")
    n_nodes = plan.leaves + len(plan.sums)
    step = max(1, CELLS // n_nodes)

    def scores_of(batch: pa.RecordBatch) -> np.ndarray:
        n, terms, tfs = (batch.column(i) for i in (1, 2, 3))
        sizes = np.diff(terms.offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        length = np.array([50 + 50 * k * n_docs // n_terms for k in n.to_pylist()], dtype=np.int64)
        share_of_term = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[doc]))
        total = np.zeros((n_nodes, len(sizes)), dtype=np.int64)
        np.add.at(total, (plan.leaf_of_term[term], doc), share_of_term)
        for node, (a, b) in enumerate(plan.sums, plan.leaves):
            np.add(total[a], total[b], out=total[node])
        return np.stack([total[nodes].sum(axis=0) for nodes in plan.roots])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(plan.roots), limit)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                keys = part.column(0).fill_null(0).to_numpy()
                best.add(scores_of(part), keys, null)
        query, score, key, null = best.cut()
        columns = [
            pa.array(query, pa.int32()),
            pa.array(key, pa.int64(), mask=null.astype(bool)),
            pa.array(score, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return postings.mapInArrow(run, schema)


def search(
    df: DataFrame,
    queries: DataFrame,
    limit: int = LIMIT,
    key: str = "doc_id",
    text: str = "text",
    query: str = "item_id",
    query_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(query, rank, doc, score): the `limit` best documents of every query, if their score is above 0."""
    spark = df.sparkSession
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"the key {key} is not an integer")
    texts = df.select(
        F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text")
    )
    asked = queries.select(
        F.col(f"`{query}`").alias("query"), F.col(f"`{query_text}`").cast("binary").alias("text")
    )
    own = asked.schema["query"].dataType
    names = StructType().add("place", IntegerType()).add("query", own)
    found = []
    for block in _blocks(asked, block_chars):
        term_ids: dict[bytes, int] = {}
        wanted = [
            list({term_ids.setdefault(t, len(term_ids)): 0 for run in term_runs(x or b"") for t in run})
            for _, x in block
        ]
        if not term_ids:
            continue
        path = fresh_path(spark, "postings")
        _postings(texts, term_ids).write.parquet(path)
        postings = spark.read.parquet(path)
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        found_in = np.zeros(len(term_ids), dtype=np.int64)
        held = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
        for term, count in held.collect():  # a row for each term of the block at most
            found_in[term] = count
        weight = weights(n_docs, found_in)
        best = _best_of_tasks(
            postings.where(F.size("terms") > 0),
            share(wanted, len(term_ids)),
            weight,
            n_docs,
            n_terms,
            limit,
        )
        by_query = Window.partitionBy("place").orderBy(
            F.desc("score"), F.col("doc").asc_nulls_last()
        )
        ranked = best.withColumnRenamed("query", "place").withColumn(
            "rank", F.row_number().over(by_query)
        )
        keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], names)
        out = fresh_path(spark, "ranked")
        ranked.where(F.col("rank") <= limit).join(F.broadcast(keys), "place").select(
            "query", "rank", "doc", "score"
        ).write.parquet(out)
        found.append(out)
    if not found:
        kind = own.simpleString()
        return spark.createDataFrame([], f"query {kind}, rank int, doc bigint, score bigint")
    return spark.read.parquet(*found)
