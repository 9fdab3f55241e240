"""Time features on integer unix seconds.

Time is an integer column of unix seconds.  All divisions are floor divisions
done in integer arithmetic (``div`` truncates toward zero, so it is corrected with
``pmod``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlytics.functions._util import as_col

WEEKDAY_NAMES = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def epoch_seconds(ts) -> Column:
    """Whole unix seconds of a TIMESTAMP_NTZ / TIMESTAMP column, independent of the
    session time zone for NTZ input."""
    c = as_col(ts)
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def floor_div(a, b: int) -> Column:
    a = as_col(a)
    return ((a - F.pmod(a, F.lit(b))).cast("long") / F.lit(b)).cast("long")


def weekday(t, shift: int = 32400) -> Column:
    """0 = Sunday ... 6 = Saturday, after shifting the clock back by ``shift`` seconds."""
    return F.pmod(floor_div(as_col(t) - F.lit(shift), 86400) + F.lit(4), F.lit(7))


def weekday_one_hot(t, shift: int = 32400, prefix: str = "is_") -> list[Column]:
    """Seven 0/1 TINYINT columns is_monday ... is_sunday; null time stays null."""
    wd = weekday(t, shift)
    order = [1, 2, 3, 4, 5, 6, 0]
    return [(wd == F.lit(k)).cast("tinyint").alias(prefix + WEEKDAY_NAMES[k]) for k in order]


def hour_of_day(t) -> Column:
    """UTC hour of day, not shifted."""
    return F.pmod(floor_div(t, 3600), F.lit(24))


def epoch_hour(t, minutes_since_pub) -> Column:
    """Epoch hour of a snapshot taken ``minutes_since_pub`` minutes after ``t``."""
    return floor_div(as_col(t) + as_col(minutes_since_pub) * F.lit(60), 3600)
