"""Time stamps and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.strings import ColumnOrName, as_col, int_div

_STAMP = {
    "date": "yyyy-MM-dd",
    "datetime": "yyyy-MM-dd_HH-mm-ss",
    "datetime_ms": "yyyy-MM-dd_HH-mm-ss-SSS",
    "datetime_us": "yyyy-MM-dd_HH-mm-ss-SSSSSS",
}


def file_stamp(timestamp: ColumnOrName, precision: str = "datetime_ms") -> Column:
    """Time stamp for file names; fractions are cut, not rounded."""
    if precision not in _STAMP:
        raise ValueError(f"unknown precision: {precision}")
    return F.date_format(as_col(timestamp), _STAMP[precision] + "'L'")


def iso_timestamp(timestamp: ColumnOrName) -> Column:
    """ISO form in UTC; the fraction is left out when it is zero."""
    ts = F.to_utc_timestamp(as_col(timestamp), F.current_timezone())
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole,
        F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )


def duration_micros(start: ColumnOrName, end: ColumnOrName) -> Column:
    first, last = (as_col(c).cast("timestamp") for c in (start, end))
    return F.unix_micros(last) - F.unix_micros(first)


def duration_seconds(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def duration_text(micros: Column) -> Column:
    """``[D day[s], ]H:MM:SS[.ffffff]``."""
    in_day = F.pmod(micros, F.lit(86_400_000_000))
    days = int_div(micros - in_day, 86_400_000_000)
    seconds = int_div(in_day, 1_000_000)
    fraction = F.pmod(in_day, F.lit(1_000_000))
    minutes = int_div(seconds, 60)
    hours = int_div(minutes, 60)
    return F.concat(
        F.when(days == 0, "")
        .when(F.abs(days) == 1, F.concat(days.cast("string"), F.lit(" day, ")))
        .otherwise(F.concat(days.cast("string"), F.lit(" days, "))),
        hours.cast("string"),
        F.lit(":"),
        F.lpad((minutes % 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((seconds % 60).cast("string"), 2, "0"),
        F.when(fraction == 0, "").otherwise(
            F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
        ),
    )
