"""Mixing along a curriculum against rounds of resharing, streams word by word and integrals by steps."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalspark.llm import curriculum
from evalspark.llm.running import totals_before

SCHEMA = "doc_id bigint, text string, source string, size string, target int, hash int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, s, "x", 1, 2, 3) for k, t, s in rows], SCHEMA)


def targets(sizes, weights=(3, 1, 2), epochs=1.5, most=2):
    """By rounds, as defined: shares by weight, the full ones stop and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    share, full = dict.fromkeys(names, 0.0), set()
    left = epochs * sum(sizes.values())
    while left > 1e-9:
        open_ = [s for s in names if s not in full]
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in open_:
            share[s] += unit * weight[s]
            if share[s] >= most * sizes[s]:
                left += share[s] - most * sizes[s]
                share[s] = most * sizes[s]
                full.add(s)
    return share


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def rows_of(n):
    text = "word " * 7
    rows = [(i, text[: i % 36], ("b", "a", None, "é", "z")[i % 7 % 5]) for i in range(n)]
    rows += [(1000 + i, "long text here " * 3, "hot") for i in range(2 * n)]
    rows += [(5, None, "a"), (6, "", None), (7, "\x0b\x85 \xa0x", "only"), (8, None, "no words")]
    return rows + [(None, "no key", "a"), (9, "copy of a row", "b"), (9, "copy of a row", "b")]


@pytest.mark.parametrize("options", [{}, {"weights": (1, 50), "epochs": 2.9, "most": 3}])
def test_by_definition(spark, options):
    rows = rows_of(80)
    found = curriculum.mix(table(spark, rows), **options).collect()
    sizes, streams = defaultdict(int), defaultdict(list)
    for key, text, source in rows:
        sizes[source] += words(text)
        plain = ":".join(str(x) for x in (key, text) if x is not None)
        streams[source].append((hashlib.md5(plain.encode()).hexdigest(), key, words(text)))
    share = targets(sizes, **options)
    most = options.get("most", 2)
    expected = []
    for source, stream in streams.items():
        taken = defaultdict(int)
        left = int(share[source] + 1e-6)
        for _ in range(most):
            for i, (_, _, size) in enumerate(sorted(stream, key=lambda x: x[0])):
                taken[i] += min(size, left)
                left -= min(size, left)
        assert left == 0
        expected += [
            (str(source), str(key), size, taken[i])
            for i, (_, key, size) in enumerate(sorted(stream, key=lambda x: x[0]))
        ]
    assert sorted((str(r.source), str(r.key), r.size, r.taken) for r in found) == sorted(expected)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(share[r.source], rel=1e-12)
        assert r.taken == sum(u["words"] for u in r.uses) <= most * r.size
        assert all(0 <= u["time"] <= 1 for u in r.uses)
    firsts = [r.uses[0]["time"] for r in found if r.uses]
    assert firsts == sorted(firsts) and all(not r.uses for r in found[len(firsts) :])


def test_reruns_agree(spark):
    df = table(spark, rows_of(60))
    first = sorted(map(str, curriculum.mix(df).collect()))
    assert sorted(map(str, curriculum.mix(df.repartition(5)).collect())) == first


KNOTS = [
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.0), (0.3, 2.0), (0.5, 2.0), (1.0, 0.0)),
    ((0.0, 0.0), (0.4, 0.0), (0.6, 1.0), (1.0, 3.0)),
    ((0.0, 2.0), (0.5, 0.0), (1.0, 0.0)),
]


@pytest.mark.parametrize("knots", KNOTS)
def test_times_invert_the_integral(spark, knots):
    steps = 20000

    def weight(t):
        for (a, x), (b, y) in zip(knots, knots[1:]):
            if t <= b:
                return x + (y - x) * (t - a) / (b - a)

    met, integral = [0.0], 0.0
    for i in range(steps):
        integral += weight((i + 0.5) / steps) / steps
        met.append(integral)
    parts = spark.createDataFrame([(i / 50,) for i in range(51)], "part double")
    time = curriculum.time_of(F.col("part"), [knots], F.lit(0).cast("bigint"))
    for part, t in parts.select("part", time).collect():
        assert 0 <= t <= 1
        assert met[round(t * steps)] / integral == pytest.approx(part, abs=2e-3)


def test_schedules_are_checked():
    for knots in ([(0.0, 1.0)], [(0.0, 1.0), (0.5, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0, -1.0), (1, 2.0)]):
        with pytest.raises((ValueError, IndexError)):
            curriculum._pieces(knots)


def test_early_sources_come_early(spark):
    rows = [(i, "some five words in here", "abc"[i % 3]) for i in range(300)]
    mixed = curriculum.mix(table(spark, rows))
    order = curriculum.training_order(mixed).collect()
    assert [r.time for r in order] == sorted(r.time for r in order)
    total = sum(r.taken for r in mixed.collect())
    assert sum(r.words for r in order) == total
    mean = {s: sum(r.time for r in order if r.source == s) / sum(r.source == s for r in order) for s in "abc"}
    assert mean["a"] < mean["b"] < mean["c"]


def test_empty_tables(spark):
    assert curriculum.mix(table(spark, [])).collect() == []
    found = curriculum.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken, r.uses) for r in found] == [(0, 0.0, 0, [])] * 2
    with pytest.raises(ValueError):
        curriculum.mix(table(spark, []), epochs=3.0)


def test_totals_before(spark):
    rows = [(None if i % 3 == 0 else i % 3, i * 7 % 100, i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, o int, v bigint")
    found = totals_before(df, ["g"], [F.col("o")], {"before": F.col("v")}).collect()
    assert sorted((str(r.g), r.o, r.before) for r in found) == sorted(
        (str(g), o, sum(w for h, p, w in rows if h == g and p < o)) for g, o, _ in rows
    )


def test_native(spark):
    plan = curriculum.mix(table(spark, rows_of(3)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
