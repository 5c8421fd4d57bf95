"""Code extraction from model answers, line numbering, chunking and path clean-up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.strings import ColumnOrName, as_col, bind, lines_of, strip

# The marks of a fenced block and of a module, and the anchor of clean paths.
FENCE = "```"
LANGUAGE_TAG = r"(?U)^ *\w*"
# the literal look-aheads keep the slow Unicode word-boundary test off most characters
MODULE_END = r"(?U)(?=endmodule)\bendmodule\b"
MODULE_REST = r"(?sU)(?=module)\bmodule\b(.*)"
PROJECT_FOLDER = "project"

# A path is a run of segments without quotes, parentheses, semicolons or line breaks, in which no
# two separators touch. It is looked for from its end, in the reversed text: there it starts at the
# project folder, so that other slashes start no search. And it is one flat character loop: a loop
# over whole segments would nest a stack frame per segment in Java and overflow on long paths.
_FOLDER_BACKWARDS = PROJECT_FOLDER[::-1]
_PATH_BACKWARDS = (
    r"[\\/]" + _FOLDER_BACKWARDS + r'[\\/](?:[^"();\n](?<![\\/][\\/]))+(?<=[\\/])'
)
_PROJECT_HINT = r"[\\/]" + PROJECT_FOLDER + r"[\\/]"


def _joined(bodies: Column) -> Column:
    """Stripped bodies with a blank line between them; null when there is none."""
    return bind(
        F.transform(bodies, strip),
        lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")),
    )


def fenced_code(text: ColumnOrName) -> Column:
    """Bodies of all fenced blocks longer than five characters, joined by a blank line.

    Splitting at the fences leaves block contents at the odd places; a last one without a closing
    fence does not count.
    """
    text = as_col(text)

    def bodies(pieces: Column) -> Column:
        closed = F.filter(pieces, lambda _, i: (i % 2 == 1) & (i < F.size(pieces) - 1))
        untagged = F.transform(
            closed, lambda piece: strip(F.regexp_replace(piece, LANGUAGE_TAG, ""))
        )
        return _joined(F.filter(untagged, lambda body: F.length(body) > 5))

    return F.when(text.contains(FENCE), bind(F.split(text, FENCE, -1), bodies))


def module_code(text: ColumnOrName) -> Column:
    """Bodies between ``module`` and ``endmodule`` (keywords dropped), joined likewise.

    In each piece that an ``endmodule`` closes, the body starts behind the first ``module``. Unlike
    one search for both keywords this passes over the text once, however often they occur.
    """
    text = as_col(text)

    def bodies(pieces: Column) -> Column:
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        rests = F.transform(closed, lambda piece: F.regexp_extract(piece, MODULE_REST, 1))
        return _joined(F.filter(rests, lambda body: F.length(body) > 5))

    return F.when(text.contains("endmodule"), bind(F.split(text, MODULE_END, -1), bodies))


def extract_code(text: ColumnOrName, code_type: str = "verilog_module") -> Column:
    """Fenced code if there is any, else module bodies, else null."""
    if code_type != "verilog_module":
        raise ValueError(f"unknown code type: {code_type}")
    return F.coalesce(fenced_code(text), module_code(text))


def number_lines(
    text: ColumnOrName, location: str = "prefix", start: int | Column = 1
) -> Column:
    """Put ``"{i}: "`` before or ``" :{i}"`` behind every line."""
    if location not in ("prefix", "postfix"):
        raise ValueError(f"unknown location: {location}")
    first = F.lit(start) if isinstance(start, int) else start

    def numbered(line: Column, i: Column) -> Column:
        number = (i + first).cast("string")
        if location == "prefix":
            return F.concat(number, F.lit(": "), line)
        return F.concat(line, F.lit(" :"), number)

    return F.array_join(F.transform(lines_of(as_col(text)), numbered), "\n")


def strip_paths(text: ColumnOrName) -> Column:
    """Shorten every absolute path that leads through the project folder to ``/project/``."""
    text = as_col(text)
    shortened = F.regexp_replace(F.reverse(text), _PATH_BACKWARDS, f"/{_FOLDER_BACKWARDS}/")
    return F.when(text.rlike(_PROJECT_HINT), F.reverse(shortened)).otherwise(text)


def _greedy_cuts(min_lines: int) -> Callable[[ColumnOrName], Column]:
    """Where chunks end, from an array that says which lines are blank.

    A cut is at a blank line that is followed by another and is far enough behind the cut before. A
    choice that depends on the one before is a loop; it runs over the flags alone, in Arrow batches,
    and the texts stay where they are.
    """

    @F.pandas_udf("array<int>")
    def cuts(blank: pd.Series) -> pd.Series:
        def chosen(flags: np.ndarray | None) -> list[int]:
            found = [0]
            if flags is not None:
                flags = np.asarray(flags, dtype=bool)
                for i in np.flatnonzero(flags[:-1] & flags[1:]).tolist():
                    if i - found[-1] >= min_lines:
                        found.append(i)
            return found

        return blank.map(chosen, na_action=None)

    return cuts


def _starts(cuts: Column, count: Column, min_lines: int, max_lines: int | None) -> Column:
    """Offsets at which chunks start, from the cuts: no short tail, and no overlong chunk."""
    is_short = (F.size(cuts) > 1) & (count - F.element_at(cuts, -1) < min_lines)
    all_but_last = F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0)))
    starts = F.when(is_short, all_but_last).otherwise(cuts)
    if max_lines is None:
        return starts
    return bind(
        starts,
        lambda begin: F.flatten(
            F.transform(
                begin,
                lambda at, i: F.sequence(at, _next(begin, i, count) - 1, F.lit(max_lines)),
            )
        ),
    )


def _next(starts: Column, i: Column, count: Column) -> Column:
    return F.coalesce(F.get(starts, i + 1), count)


def split_into_chunks(
    files: DataFrame, text: str, min_lines: int, max_lines: int | None = None
) -> DataFrame:
    """One row per chunk of the text column: chunk_no, start_line (from 1), line_count, chunk_text.

    A chunk ends at the first pair of blank lines that leaves it at least ``min_lines`` long; a
    short tail joins the last chunk. ``max_lines`` cuts longer chunks into pieces of that length.
    Needs no shuffle; the joined chunks of a file give back its text without carriage returns.
    """
    if min_lines < 1 or (max_lines is not None and max_lines < 1):
        raise ValueError("chunk limits must be positive")
    rest = [c for c in files.columns if c != text]
    split = files.select(*rest, lines_of(F.col(text)).alias("_lines"))
    blank = F.transform("_lines", lambda line: strip(line) == "")
    split = split.select(*rest, "_lines", _greedy_cuts(min_lines)(blank).alias("_cuts"))
    lines = F.col("_lines")
    count = F.size(lines)

    def texts(starts: Column) -> Column:
        """All chunk texts in one pass: the lines are joined with a mark before each start, and
        split there again. The mark is a carriage return, which no line contains any more."""
        is_start = F.flatten(
            F.transform(
                starts,
                lambda at, i: F.concat(
                    F.array(at > 0),
                    F.array_repeat(F.lit(False), _next(starts, i, count) - at - 1),
                ),
            )
        )
        marked = bind(
            is_start,
            lambda begins: F.transform(
                lines,
                lambda line, i: F.when(
                    F.get(begins, i), F.concat(F.lit("\r"), line)
                ).otherwise(line),
            ),
        )
        return F.split(F.array_join(marked, "\n"), "\n\r", -1)

    # the pieces are built before the explode, so that no row carries the whole file along
    pieces = bind(
        _starts(F.col("_cuts"), count, min_lines, max_lines),
        lambda starts: F.transform(
            texts(starts),
            lambda chunk, i: F.struct(
                (F.get(starts, i) + 1).cast("bigint").alias("start_line"),
                (_next(starts, i, count) - F.get(starts, i)).cast("bigint").alias("line_count"),
                chunk.alias("chunk_text"),
            ),
        ),
    )
    return split.select(*rest, F.posexplode(pieces).alias("chunk_no", "_piece")).select(
        *rest, F.col("chunk_no").cast("bigint").alias("chunk_no"), "_piece.*"
    )
