"""Line-first quality rules.

Every line is held against punctuation, navigation and boilerplate rules; lines that fail are
removed, and a document that loses too much of its text, or fails the base rules on its words, is
rejected.

Words are runs of anything but the six ASCII white space characters. A null or empty text has no
words and is rejected by the base rules; its cleaned text is null or empty. Blank lines are neither
removed nor counted as lost. Repeated rows are judged one by one, alike. Columns of the table with
the names of results do not clash: results come in a struct of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from evalspark.llm.batches import map_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
ENDINGS = ".!?…。！？؟।:;\"'”’»)]"
SEPARATOR = re.compile(r"[|•·»›→]")
MARK = re.compile(r"[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？।؟])")
BOILERPLATE = re.compile(
    r"(?i:\b(?:all rights reserved|licensed under|terms of (?:use|service)|privacy policy"
    r"|cookie policy|(?:use|accept|enable) (?:of )?cookies|enable javascript|click here|sign up for"
    r"|log ?in to|subscribe to our|back to top|skip to (?:main )?content|lorem ipsum)\b|©)"
    # ordinary words unless they open a sentence or have a capital
    r"|(?:^\W*|[.!?…]\s+)(?i:(?:proudly )?powered by|share (?:this|on))\b"
    r"|\b(?:P(?i:owered by)|S(?i:hare (?:this|on)))\b"
)

FIELDS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "base_failed": "boolean",
    "lost_chars": "bigint",
    "line_chars": "bigint",
    "kept": "boolean",
    "cleaned": "string",
}


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a document must keep half of its text by default."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: a line with fewer words has to end like a sentence
    sentence_words: int = 5
    #: of 100 characters of a line, marks that are no letters, digits or white space
    max_mark_percent: int = 25
    min_marks: int = 5
    #: separators of a menu, per 100 words, in a line with at least `min_separators` of them
    max_separator_percent: int = 20
    min_separators: int = 3
    #: a line of this many words in capitals only
    shout_words: int = 4
    #: a line of `repeat_words` or more words, of 100 of which fewer differ
    repeat_words: int = 10
    min_distinct_percent: int = 20
    #: words of a stretch within which words are held against each other
    stretch_words: int = 200
    #: a boilerplate phrase condemns a sentence of at most this many words
    phrase_words: int = 20
    max_lost_percent: int = 50

    def fails(self, line: str, words: list[str]) -> bool:
        """Whether a line with at least one word breaks a rule."""
        n = len(words)
        # punctuation
        if n < self.sentence_words and words[-1][-1] not in ENDINGS:
            return True
        marks = len(MARK.findall(line))
        if marks >= self.min_marks and 100 * marks > self.max_mark_percent * len(line):
            return True
        # navigation
        separators = len(SEPARATOR.findall(line))
        if separators >= self.min_separators:
            if 100 * separators > self.max_separator_percent * n:
                return True
        if n >= self.shout_words and line == line.upper() != line.lower():
            return True
        # boilerplate
        if n >= self.repeat_words:
            step = self.stretch_words
            distinct = sum(len(set(words[i : i + step])) for i in range(0, n, step))
            if 100 * distinct < self.min_distinct_percent * n:
                return True
        return self.boilerplate(line)

    def boilerplate(self, line: str) -> bool:
        """Whether half of a line or more is short sentences with a boilerplate phrase."""
        if BOILERPLATE.search(line) is None:
            return False
        sentences = [s for s in SENTENCE.split(line.strip()) if s]
        bad = [
            s
            for s in sentences
            if BOILERPLATE.search(s) and len(WORDS.findall(s)) <= self.phrase_words
        ]
        return 2 * sum(map(len, bad)) >= sum(map(len, sentences))


def repeated_words(codes: np.ndarray, document: np.ndarray, documents: int) -> np.ndarray:
    """Per document, the words in windows of three that its text has more than once."""
    count = np.zeros(documents, dtype=np.int64)
    if len(codes) < 3:
        return count
    n = int(codes.max()) + 1
    pairs, _ = pd.factorize(codes[:-1].astype(np.int64) * n + codes[1:])
    triples, _ = pd.factorize(pairs[:-1].astype(np.int64) * n + codes[2:])
    inside = document[:-2] == document[2:]
    windows, _ = pd.factorize(triples.astype(np.int64) * documents + document[:-2])
    times = np.bincount(windows, weights=inside)
    again = inside & (times[windows] > 1)
    covered = np.zeros(len(codes), dtype=bool)
    for shift in range(3):
        covered[shift : len(codes) - 2 + shift] |= again
    np.add.at(count, document[covered], 1)
    return count


def judge(texts: Sequence[str | None], rules: Rules) -> list:
    """The columns of `FIELDS` for some texts."""
    found = [WORDS.findall(t or "") for t in texts]
    n_words = np.array([len(f) for f in found], dtype=np.int64)
    words = [w for f in found for w in f]
    document = np.repeat(np.arange(len(texts)), n_words)
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
    n_repeat = repeated_words(codes, document, len(texts))
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    word_chars = [sum(map(len, f)) for f in found]
    n_symbols = [sum(map((t or "").count, SYMBOLS)) for t in texts]
    n_dup, lost, total, cleaned = [], [], [], []
    for text in texts:
        seen: set[str] = set()
        left, dup, gone, size = [], 0, 0, 0
        for line in (text or "").split("\n"):
            in_line = WORDS.findall(line)
            if in_line:
                dup += line in seen
                seen.add(line)
                size += len(line)
                if rules.fails(line, in_line):
                    gone += len(line)
                    continue
            left.append(line)
        n_dup.append(dup)
        lost.append(gone)
        total.append(size)
        cleaned.append(None if text is None else "\n".join(left) if gone else text)
    kept = ~failed & (100 * np.array(lost) <= rules.max_lost_percent * np.array(total))
    return [
        n_words, word_chars, n_symbols, n_dup, n_repeat, failed, lost, total, kept, cleaned,
    ]


def clean(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Rules = Rules()
) -> DataFrame:
    """Struct `kept` of the columns `keep` and struct `out` of `FIELDS`, for every row."""

    def make() -> Callable[[list], list]:
        return lambda texts: judge(texts, rules)

    return map_texts(df, text, make, FIELDS, keep)
