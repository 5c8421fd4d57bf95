"""Exact token counts at every prefix of a text, by dynamic programming.

The last token of a prefix of a pre-token is the only one that ends there and is compatible with
the last token of the prefix before it: joining them would never have been a merge. So one pass over
the bytes gives the token count of every prefix, and counts, truncation and budgets are look-ups.
Counts equal those of the tokenizers library for the same file, without added begin or end tokens;
special strings inside a text count as one token, as is that library's default.

Null texts count as empty. A prefix is measured in code points. The count of a prefix is the count
of that text by itself: a cut inside a run of white space, a contraction or a special string is
split as the cut text would be, so a longer prefix can have a smaller count.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from evalspark.llm.batches import map_texts
from evalspark.llm.bpe import unicode_spaces

#: Fixed value: the split of byte-level BPE files that ask for a pattern.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Pre-tokens whose counts a worker process remembers; beyond it, it starts anew.
REMEMBERED = 800_000
#: Contractions of two letters: cut after the first letter, they are two pre-tokens.
CUT_IN_TWO = ("'re", "'ve", "'ll")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge rules of a tokenizer file: bounded by the file.

    Token 0 to 255 are the bytes, token 256 + i is made by merge i, so a token's number is also the
    time at which it is made.
    """

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        self.tokens = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int]] = [(-1, -1)] * 256
        self.number = {t: i for i, t in enumerate(self.tokens)}
        self.pairs: dict[tuple[int, int], int] = {}
        for rule in spec["model"]["merges"]:
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            a, b = self.number[as_bytes(left)], self.number[as_bytes(right)]
            token = self.tokens[a] + self.tokens[b]
            if token in self.number:
                raise ValueError(f"two merges make the token {token!r}")
            self.number[token] = self.pairs[a, b] = len(self.tokens)
            self.tokens.append(token)
            self.parts.append((a, b))
        self.special = []
        for added in spec.get("added_tokens") or []:
            if added["single_word"] or added["lstrip"] or added["rstrip"]:
                raise ValueError(f"unsupported added token {added['content']!r}")
            self.special.append(added["content"])
        #: for the last bytes (at most 4) of a prefix, the lengths of the tokens that can end there
        ends: dict[bytes, set[int]] = {}
        for token in self.tokens:
            if len(token) > 3:
                ends.setdefault(token[-4:], set()).add(len(token))
        short = [t for t in self.tokens if len(t) in (2, 3)]
        for tail in {*ends, *(t[-3:] for t in ends), *(t[-2:] for t in ends), *short}:
            sizes = ends.setdefault(tail, set())
            sizes.update(n for n in (2, 3) if n <= len(tail) and tail[-n:] in self.number)
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the boundary between two tokens survives when both are encoded together.

        Left of it stands, at any time, a token on the right edge of `left`, right of it one on the
        left edge of `right`. The boundary falls if two of them form a pair while both stand; of two
        equal pairs the one further left is joined first.
        """
        parts, pairs = self.parts, self.pairs
        a, a_until = left, 1 << 60
        while a >= 0:
            b, b_until = right, 1 << 60
            while b >= 0:
                time = pairs.get((a, b))
                if time is not None and time < a_until and time <= b_until:
                    return False
                b, b_until = parts[b][0], b
            a, a_until = parts[a][1], a
        return True


class PrefixCounter:
    """Token counts of all prefixes; remembers pre-tokens and token pairs up to a bound."""

    def __init__(self, merges: Merges, remembered: int = REMEMBERED) -> None:
        self.merges = merges
        self.find = regex.compile(unicode_spaces(PATTERN)).findall
        self.blank = regex.compile(r"\p{White_Space}+").fullmatch
        self.special = (
            regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")").split
            if merges.special
            else lambda text: [text]
        )
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.blanks: set[str] = set()
        self.fits: dict[int, bool] = {}

    def byte_counts(self, piece: bytes) -> list[int]:
        """Counts of the prefixes of one pre-token, from one byte on."""
        merges, fits = self.merges, self.fits
        number, lengths = merges.number, merges.lengths
        last = [-1] * (len(piece) + 1)
        counts = [0] * (len(piece) + 1)
        for i in range(1, len(piece) + 1):
            for length in (
                lengths.get(piece[i - 4 if i > 4 else 0 : i])
                or lengths.get(piece[i - 3 if i > 3 else 0 : i])
                or lengths.get(piece[i - 2 if i > 2 else 0 : i])
                or ()
            ):
                if length > i or (token := number.get(piece[i - length : i])) is None:
                    continue
                before = last[i - length]
                if before >= 0:
                    key = before << 32 | token
                    if (fit := fits.get(key)) is None:
                        fit = fits[key] = merges.compatible(before, token)
                    if not fit:
                        continue
                last[i], counts[i] = token, counts[i - length] + 1
                break
            else:
                last[i], counts[i] = piece[i - 1], counts[i - 1] + 1
        return counts[1:]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            self.blanks.clear()
            new = list(pieces)
        if len(self.fits) > 4 * self.remembered:
            self.fits.clear()
        for piece in new:
            data = piece.encode()
            counts = self.byte_counts(data)
            if len(data) != len(piece):  # only where a character ends
                counts = [n for n, b in zip(counts, (*data[1:], 0)) if b & 0xC0 != 0x80]
            if piece in CUT_IN_TWO:
                counts[1] = 2
            self.known[piece] = array("i", counts).tobytes()
            if not ("!" <= piece[-1] <= "~") and self.blank(piece):
                self.blanks.add(piece)

    def segment(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without special strings, from one character on."""
        pieces = self.find(text)
        self.learn(set(pieces))
        packed = list(map(self.known.__getitem__, pieces))
        counts = np.frombuffer(b"".join(packed), dtype=np.int32).copy()
        lengths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        ends = np.cumsum(lengths)
        before = np.concatenate(([0], np.cumsum(counts[ends - 1])[:-1]))
        counts += np.repeat(before, lengths).astype(np.int32)
        for i in [i for i, p in enumerate(pieces[:-1]) if p in self.blanks]:
            # the whole run of white space, of which the last character went to the next piece
            run = pieces[i] + pieces[i + 1][0]
            if self.blank(run):
                self.learn({run})
                own = np.frombuffer(self.known[run], dtype=np.int32)
                counts[ends[i]] = before[i] + own[-1]
        return counts

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of all prefixes, the empty one included: one more than the text has characters."""
        parts = self.special(text)
        counts, total, found = [np.zeros(1, dtype=np.int32)], 0, []
        for i, part in enumerate(parts):
            if not part:
                continue
            if i % 2:
                before = parts[i - 1]
                cut = [self.segment(before + part[:n])[-1] for n in range(1, len(part))]
                start = total - (found[-1] if before else 0)
                own = np.array([*(start + c for c in cut), total + 1], dtype=np.int32) - total
            else:
                own = self.segment(part)
                found.append(int(own[-1]))
            counts.append(own + np.int32(total))
            total += int(own[-1])
        return np.concatenate(counts)


_counters: list[PrefixCounter] = []


def counter_of(merges: Broadcast) -> PrefixCounter:
    """The counter of this worker process, so that a task goes on with what others learned."""
    if not _counters or _counters[0].merges is not merges.value:
        _counters[:] = [PrefixCounter(merges.value)]
    return _counters[0]


def load(spark: SparkSession, path: str) -> Broadcast:
    """The merge rules, read by the driver; the file bounds their size."""
    return spark.sparkContext.broadcast(Merges(path))


def prefix_counts(
    df: DataFrame, merges: Broadcast, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` and `counts`: the token count of every prefix (array of int).

    Entry i is the count of the first i characters, so a text of n characters has n + 1 entries.
    """

    def make() -> Callable[[list], list]:
        counter = counter_of(merges)
        return lambda texts: [
            pa.array([counter.prefixes(t or "") for t in texts], type=pa.list_(pa.int32()))
        ]

    out = map_texts(df, text, make, {"counts": "array<int>"}, keep)
    return out.select("kept.*", "out.counts")


def budgets(
    df: DataFrame,
    merges: Broadcast,
    limit: int,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns `keep`, `n_tokens` (bigint) of the whole text, and `fit_chars` (bigint): the
    characters of its longest prefix with at most `limit` tokens."""

    def make() -> Callable[[list], list]:
        counter = counter_of(merges)

        def run(texts: list) -> list:
            totals, fits = [], []
            for t in texts:
                counts = counter.prefixes(t or "")
                totals.append(int(counts[-1]))
                fits.append(len(counts) - 1 - int(np.argmax(counts[::-1] <= limit)))
            return [totals, fits]

        return run

    out = map_texts(df, text, make, {"n_tokens": "bigint", "fit_chars": "bigint"}, keep)
    return out.select("kept.*", "out.*")
