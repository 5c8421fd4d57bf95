"""Planted benchmark passages, re-parameterised ones, and what must not match."""

import pytest

from evalspark.llm import decontaminate as dc

QUESTION = (
    "A train leaves the station at 40 km per hour and another train leaves the same station two "
    "hours later at 60 km per hour so when does the second train reach the first train"
)
NAMES = "the teacher gives Maria seven red apples and asks Maria to share them with Peter before noon"
PLAIN = "the blue fox runs over the quiet hill while seven owls watch from the tall dark tree at night"
FILLER = "words of no meaning fill this part of the page and say nothing at all"
ITEMS = [(1, QUESTION), (2, NAMES), (3, PLAIN), (4, "short item"), (5, None), (6, ""), (7, PLAIN)]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def leaks(documents, benchmark, rows, **options):
    found = dc.leaks(documents(rows), benchmark, **options).collect()
    return {(r.doc, r.item): (r.n_windows, r.item_windows, r.n_changed) for r in found}


@pytest.mark.parametrize("broadcast_chars", [0, 2_000_000])
def test_leaks(documents, benchmark, broadcast_chars):
    other = QUESTION.replace("40", "1,075.5").replace("60", "90")
    mixed = QUESTION.replace("two hours", "three hours")
    rows = [
        (1, f"{FILLER} {QUESTION} {FILLER}"),
        (2, f"{FILLER}. {other}, {FILLER}"),
        (3, NAMES.replace("Maria", "Helena").replace("Peter", "Paul")),
        (4, f"{FILLER} " * 40),
        (5, None),
        (6, ""),
        (7, PLAIN.upper()),
        (8, PLAIN.replace(" ", "\n ")),
        (9, mixed),
        (10, "short item"),
        (11, "the short item"),
        (7, PLAIN.upper()),
        (None, PLAIN),
        (12, " ".join(PLAIN.split()[:13])),
        (13, " ".join(PLAIN.split()[:11])),
    ]
    found = leaks(documents, benchmark, rows, broadcast_chars=broadcast_chars)
    expected = {(1, 1), (2, 1), (3, 2), (9, 1), (10, 4), (None, 3), (None, 7)}
    expected |= {(k, i) for k in (7, 8, 12) for i in (3, 7)}
    assert found.keys() == expected
    assert found[1, 1][2] == 0 and found[2, 1][2] == 2 and found[3, 2][2] == 2


def test_inconsistent_values_do_not_match(documents, benchmark):
    """Maria stands for two people: this is not the same question with another name."""
    changed = NAMES.replace("Maria", "Helena", 1).replace("Maria", "Sophie").replace("Peter", "Paul")
    assert leaks(documents, benchmark, [(1, changed)]) == {}


def test_removal(documents, benchmark):
    rows = [(1, f"{FILLER} {PLAIN}"), (2, FILLER), (None, FILLER), (3, None), (2, FILLER)]
    df = documents(rows)
    left = dc.remove_leaks(df, benchmark)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "2", "3", "None"]
    assert dc.remove_leaks(df.limit(0), benchmark).count() == 0
    assert dc.remove_leaks(df, benchmark.limit(0)).count() == 5
    assert sorted(str(r.doc_id) for r in dc.remove_leaks(documents([(None, PLAIN), (1, "x")]), benchmark).collect()) == ["1"]


def test_long_texts(documents, benchmark):
    words = " ".join(f"word{i % 977}x" for i in range(60_000))
    assert leaks(documents, benchmark, [(1, words), (2, f"{words} {PLAIN} {words}")]).keys() == {(2, 3), (2, 7)}


@pytest.mark.parametrize("broadcast_chars", [0, 2_000_000])
def test_verbatim_items_of_any_kind(spark, documents, broadcast_chars):
    short, chinese = "why is the sky blue", "天空为什么是蓝色的"
    numbers = "1 2 3 5 8 13 21 34 55 89 144 233 377 610"
    people = "we met Anna, Boris, Clara, David, Emil, Frida, Georg, Hanna and Ivan there"
    items = [(1, short), (2, chinese), (3, numbers), (4, people), (5, "of the"), (6, "in 1969")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [
        (1, f"{FILLER}. Why  is the\nsky blue? {FILLER}"),
        (2, f"第一句话。{chinese}？第二句话。{FILLER}"),
        (3, f"{FILLER}: {numbers}. {FILLER}"),
        (4, f"{FILLER} {people.upper()} {FILLER}"),
        (5, f"{FILLER} {people.lower()} {FILLER}"),
        (6, f"{FILLER} why is the sea blue {FILLER}"),
        (7, f"{FILLER} 7 8 9 11 12 14 15 16 17 18 19 20 22 23 {FILLER}"),
        (8, FILLER),
    ]
    found = leaks(documents, benchmark, rows, broadcast_chars=broadcast_chars)
    assert found.keys() == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)}
    every = leaks(documents, benchmark, rows, broadcast_chars=broadcast_chars, min_words=1)
    assert every.keys() == found.keys() | {(k, 5) for k, _ in rows}  # the filler has "of the"


def test_an_altered_mention_costs_its_own_windows_only(spark, documents):
    numbers = [f"word{chr(97 + i)} " * 3 + ("2019 " if i in (2, 20) else "") for i in range(24)]
    long = "".join(numbers)
    slots = (
        "a cyclist rides 40 km along the quiet river road before lunch and then rests under a big old "
        "oak tree near the village for 40 minutes before riding back home along the same road"
    )
    benchmark = spark.createDataFrame([(1, long), (2, slots)], "item_id bigint, text string")
    rows = [
        (1, f"{FILLER} {long.replace('2019', '2020', 1)} {FILLER}"),
        (2, slots.replace("40 km", "60 km").replace("40 minutes", "90 minutes")),
        (3, slots.replace("40 km", "60 km").replace("40 minutes", "60 minutes")),
    ]
    found = leaks(documents, benchmark, rows)
    assert found.keys() == {(1, 1), (2, 2), (3, 2)}
    assert found[2, 2][0] < found[3, 2][0] == found[3, 2][1]
    assert found[3, 2][2] == 1 and found[2, 2][2] == 0


def test_texts_are_extracted_once(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = dc.windows(documents, {"doc": "doc_id"}, "text", 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # three replacements for marks, in one expression, and nothing of it in a filter of the scan
    assert plan.count("regexp_replace") == 3
    assert all("regexp_replace" not in x for x in plan.split("\n") if "Filter" in x)


def held_windows(monkeypatch, df, benchmark, **options):
    """Windows of the documents that are made for the join, and the leaks."""
    made, windows = [], dc.windows
    monkeypatch.setattr(dc, "windows", lambda *a, **k: made.append(windows(*a, **k)) or made[-1])
    found = dc.leaks(df, benchmark, **options)
    monkeypatch.setattr(dc, "windows", windows)
    return made[-1].count(), sorted(map(str, found.collect()))


def test_windows_of_no_item_are_not_made(spark, benchmark, monkeypatch):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    planted = documents.where("doc_id % 3 = 0").selectExpr("doc_id + 100000 as doc_id", f"concat(text, ' {QUESTION} ', text, ' {NAMES}') as text")
    df = documents.select("doc_id", "text").union(planted)
    every, expected = held_windows(monkeypatch, df, benchmark, broadcast_chars=0)
    few, found = held_windows(monkeypatch, df, benchmark)
    assert found == expected and len(found) >= planted.count()
    assert few < every / 5
    monkeypatch.setattr(dc, "MOST_BITS", 64)  # a full bitmap loses nothing either
    assert held_windows(monkeypatch, df, benchmark)[1] == expected
