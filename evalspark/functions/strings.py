"""Small string helpers that follow Python's text semantics inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, like a let-binding.

    Branches of ``when`` are not shared by subexpression elimination, so a costly regex used in
    both a condition and its branch would otherwise run twice per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Fixed value: the characters Python counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind; looks at the two ends only."""
    return F.btrim(text, F.lit(WHITESPACE))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null (not '') when the pattern does not occur."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def int_div(value: Column, divisor: int | Column) -> Column:
    """Integer division; unlike floor(a / b) it is exact for every bigint."""
    by = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", value.cast("bigint"), by.cast("bigint"))


def lines_of(text: Column) -> Column:
    """Lines without carriage returns; trailing empty lines are kept."""
    return F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", -1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def json_fields(*fields: Column) -> Column:
    """The members of a JSON object without the braces; nulls are kept as ``null``."""
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return bind(whole, lambda json: json.substr(F.lit(2), F.length(json) - 2))
