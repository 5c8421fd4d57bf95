"""Ranked lexical search against scoring every pair of query and document."""

import math
import random
import re
from collections import Counter

import pytest

from evalspark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_definition(documents, queries, limit):
    """Sorted (query, rank, doc, score) lists, one per query with results."""
    held = [(key, Counter(terms(text))) for key, text in documents if terms(text)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    out = []
    for query, text in queries:
        scored = []
        for key, counts in held:
            m = 50 + 50 * counts.total() * n_docs // n_terms
            score = 0
            for t in set(terms(text)) & set(counts):
                df = sum(t in c for _, c in held)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(query, i, k, -s) for i, (s, _, _, k) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=str)


def found(documents, spark, rows, queries, **options):
    asked = spark.createDataFrame(
        [(q, t, 1, 2) for q, t in queries], "item_id bigint, text string, doc int, rank int"
    )
    result = lexical.search(documents(rows), asked, **options)
    assert dict(result.dtypes) == {"query": "bigint", "rank": "int", "doc": "bigint", "score": "bigint"}
    return sorted(map(tuple, result.collect()), key=str)


def made(n, seed, words="the of and cat dog Ünder straße 中文 x1 Y2 end-of it's"):
    pick = random.Random(seed)
    vocabulary = words.split()
    return [
        " ".join(pick.choices(vocabulary, range(1, len(vocabulary) + 1), k=pick.randrange(1, 30)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_by_definition(documents, spark, limit):
    rows = list(enumerate(made(120, 1))) + [(500, None), (501, ""), (502, "... \n"), (None, "cat CAT dog")]
    rows += [(k, "the rare one") for k in range(900, 960)]  # ties
    rows += [(7, "cat twice"), (7, "cat twice")]  # repeated rows
    queries = list(enumerate(made(15, 2))) + [(90, None), (91, " -- "), (92, "unknown"), (3, "rare cat")]
    queries += [(None, "rare"), (92, "rare the")]
    assert found(documents, spark, rows, queries, limit=limit) == by_definition(rows, queries, limit)


def test_blocks_of_queries(documents, spark):
    rows, queries = list(enumerate(made(60, 3))), list(enumerate(made(12, 4)))
    whole = found(documents, spark, rows, queries)
    assert found(documents, spark, rows, queries, block_chars=40) == whole
    assert found(documents, spark, rows, queries, block_chars=1) == whole


def test_long_texts_are_read_in_runs():
    text = "Ab c-d " * 50 + "x" * 100 + " end"
    expected = [t.encode() for t in terms(text)]
    for size in (1, 3, 10, 1000):
        assert [t for run in lexical.term_runs(text.encode(), size) for t in run] == expected


def test_empty_tables(documents, spark):
    assert found(documents, spark, [], [(1, "cat")]) == []
    assert found(documents, spark, [(1, "cat")], []) == []
    assert found(documents, spark, [(1, None)], [(1, "cat")]) == []


def test_string_keys_are_refused(spark):
    df = spark.createDataFrame([("a", "cat")], "doc_id string, text string")
    with pytest.raises(TypeError):
        lexical.search(df, spark.createDataFrame([(1, "cat")], "item_id bigint, text string"))


def test_shared_sums_equal_plain_sums():
    pick = random.Random(5)
    queries = [
        sorted({int(40 * pick.random() ** 2) for _ in range(pick.randrange(0, 25))}) for _ in range(30)
    ]
    plan = lexical.share(queries, 40)
    value = [pick.randrange(1000) for _ in range(40)]
    total = [0] * (plan.leaves + len(plan.sums))
    for term, leaf in enumerate(plan.leaf_of_term):
        total[leaf] += value[term]
    for node, (a, b) in enumerate(plan.sums, plan.leaves):
        assert a < node and b < node
        total[node] = total[a] + total[b]
    for terms_of, roots in zip(queries, plan.roots):
        assert sum(total[r] for r in roots) == sum(value[t] for t in terms_of)
    apart = sum(max(0, len(q) - 1) for q in queries)
    assert plan.additions() < 0.8 * apart
    assert lexical.share([], 0).additions() == 0
