"""Base counts against their definitions, and the line rules."""

import random

import plain
import pytest

from evalspark.llm import cleaning



def prose(i):
    """A sentence that shares no three words in a row with another."""
    nouns = "river mill child water dusk garden stone letter window harbour".split()
    words = [f"{noun}{chr(97 + i % 26)}{chr(97 + i // 26)}" for noun in nouns]
    return "The " + " and ".join(words) + " were there."


BODY = "\n".join(map(prose, range(6)))


def judged(texts, rules=cleaning.Rules()):
    columns = [list(c) for c in cleaning.judge(texts, rules)]
    return [dict(zip(cleaning.FIELDS, row)) for row in zip(*columns)]


def test_base_counts():
    rng = random.Random(5)
    words = ["a", "b", "the", "é#", "x|y", "<>", "z\x0b"]
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a", "\n\na\na\n a"]
    for _ in range(300):
        n = rng.randint(0, 90)
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t"]) for _ in range(n)))
    for text, row in zip(texts, judged(texts)):
        assert tuple(row.values())[:6] == plain.base_counts(text), text


@pytest.mark.parametrize(
    "line",
    [
        "Home",
        "Read more",
        "Home | About | Contact | Imprint |",
        "BUY NOW AND SAVE BIG",
        "win$$$ big%%% now*** here### soon&&&",
        "very very very very very very very very very very",
        "Please accept cookies to go on reading this page.",
        "© 2020 Example",
    ],
)
def test_failing_lines_go(line):
    (row,) = judged([f"{BODY}\n{line}\n\nThe end came soon."])
    assert row["cleaned"] == f"{BODY}\n\nThe end came soon."
    assert row["lost_chars"] == len(line) and row["kept"]


def test_clean_documents_stay_as_they_are():
    text = BODY + "\nHe left.\n\nGo."
    (row,) = judged([text])
    assert row["kept"] and row["cleaned"] == text and row["lost_chars"] == 0


def test_documents_that_lose_too_much_are_rejected():
    menu = "\n".join(f"Home | News{i} | Sports | Weather{i} | Travel{i} |" for i in range(9))
    rows = judged([f"{prose(0)}\n{menu}", f"{BODY}\nMenu"])
    assert [r["kept"] for r in rows] == [False, True]
    assert not rows[0]["base_failed"]


def test_tables(documents):
    long = "\n".join(f"{prose(i % 600)} {i}" for i in range(3_000))
    rows = [(1, BODY), (2, None), (3, ""), (3, ""), (None, long), (4, "x" * 100_000)]
    found = cleaning.clean(documents(rows), keep=("doc_id", "kept", "out")).collect()
    assert len(found) == len(rows)
    for row in found:
        text = dict(rows)[row.kept.doc_id]
        assert tuple(row.out)[:6] == plain.base_counts(text)
        assert row.kept.kept == "k" and (row.out.cleaned is None) == (text is None)
    assert cleaning.clean(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    "line",
    [
        "Its market share on the continent grew for three years.",
        "They built a mill powered by water from the river.",
        "A new age of upshare once came and went again.",
        f"{prose(30)} Please accept cookies to go on. {prose(31)} {prose(32)}",
    ],
)
def test_prose_with_a_phrase_stays(line):
    (row,) = judged([f"{BODY}\n{line}"])
    assert row["lost_chars"] == 0 and row["kept"]


@pytest.mark.parametrize(
    "line", ["Proudly powered by example", "Home News Powered by Example Share on Example", "Share this with friends!"]
)
def test_phrases_in_short_lines_still_go(line):
    (row,) = judged([f"{BODY}\n{line}"])
    assert row["lost_chars"] == len(line)


def test_variety_does_not_depend_on_length():
    """A book on one line has few distinct words for its length; a repeated phrase is still found."""
    rng = random.Random(1)
    book = " ".join(f"word{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}" for _ in range(3_000))
    again = " ".join([prose(0)] * 200)
    rows = judged([f"{book}.", f"{BODY}\n{again}"])
    assert rows[0]["lost_chars"] == 0 and rows[0]["kept"]
    assert rows[1]["lost_chars"] == len(again)
