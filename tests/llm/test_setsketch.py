"""Near duplicates against all pairs, and the sketch against true overlaps."""

import random
from collections import Counter

import numpy as np
import plain
import pytest

from evalspark.llm import setsketch as ss
from evalspark.llm.components import components

SHAPE = ss.Sketch()


def near_copies(rng, groups=12, size=9, words=120):
    """Texts in groups of copies that differ in some words, so that overlaps lie around 0.85."""
    vocabulary = [f"w{i}" for i in range(4_000)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("shape", [SHAPE, ss.Sketch(block=4, pivots=2)])
def test_components_of_all_pairs(documents, shape):
    rng = random.Random(11)
    texts = near_copies(rng) + [None, "", " \n ", "one two", "One  TWO", "one two three", "É a b c d", "é a b c d"]
    rows = [(1_000 - i, t) for i, t in enumerate(texts)]
    rows += [(2, texts[0]), (2, texts[20]), (3, texts[5].upper())]
    found = ss.near_duplicates(documents(rows), shape=shape).collect()
    assert Counter((r.key, r.n_shingles) for r in found) == Counter(
        (k, len(plain.shingles(t))) for k, t in rows
    )
    # key 2 has two texts, and so connects what is near to either
    expected = plain.near_components(rows)
    same_key = {expected[1_000], expected[980]} | {2}
    for r in found:
        want = expected[r.key]
        assert r.component == (min(same_key) if want in same_key else want), r.key


def test_large_family_in_blocks(documents):
    """Copies of a text that is not the smallest key: they meet only through it."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(5, 190, 6), 3):
            own[at] = f"x{k}-{at}"
        rows.append((k, " ".join(own)))
    shape = ss.Sketch(block=8, pivots=4)
    found = {r.key: r.component for r in ss.near_duplicates(documents(rows), shape=shape).collect()}
    assert found == plain.near_components(rows)


def test_keep_first(documents):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (9, "other text of six words"), (None, None)]
    kept = ss.keep_first(documents(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "9", "None"]
    assert kept[0].kept == "k"
    assert ss.keep_first(documents(rows).limit(0)).count() == 0


def test_null_keys(documents):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "x y z")]
    found = sorted(str((r.key, r.component)) for r in ss.near_duplicates(documents(rows)).collect())
    assert found == ["(1, None)", "(2, 2)", "(None, None)"]


def test_registers():
    sketcher = ss.Sketcher(SHAPE)
    rng = np.random.default_rng(1)
    errors = []
    for overlap in (0.2, 0.5, 0.85, 0.95):
        for n in (60, 500, 6_000):
            common = round(2 * n * overlap / (1 + overlap))
            pool = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:common], pool[n:]])
            x, y = sketcher.registers(a), sketcher.registers(b)
            assert (ss.merge(x, y) == sketcher.registers(np.union1d(a, b))).all()
            errors.append(ss.estimate(x, y, n, n, SHAPE.base) - common / (2 * n - common))
    assert np.abs(errors).max() < 0.12 and abs(np.mean(errors)) < 0.03


def test_candidates_keep_what_may_reach_the_threshold():
    rng = np.random.default_rng(2)
    sketcher = ss.Sketcher(SHAPE)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [base]
    for _ in range(40):
        changed = base.copy()
        changed[:30] = rng.integers(0, 1 << 63, 30).astype(np.uint64)
        sets.append(np.sort(changed))
    registers = np.stack([sketcher.registers(s) for s in sets])
    pairs = ss.candidates(registers, np.array([400] * 41), SHAPE)
    assert {(0, j) for j in range(1, 41)} <= set(pairs)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(400 + i, 401 + i) for i in range(40)] + [(900, 1_000 + i) for i in range(200)]
    links += [(5, None), (7, 7)]
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in links:
        if b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "u bigint, v bigint")
    found = [tuple(r) for r in components(df).select("node", "component").collect()]
    assert sorted(found) == sorted((n, root(n)) for n in parent)
    assert components(df.limit(0)).count() == 0
