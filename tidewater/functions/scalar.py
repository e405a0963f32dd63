"""Scalar functions whose meaning differs from Spark's own, as columns.

The SQL front end writes the same expressions; these are for DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(text: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """1-based; a start before the text uses up the length."""
    begin = start if isinstance(start, Column) else F.lit(start)
    if length is None:
        return F.substring(text, F.greatest(begin, F.lit(1)), F.length(text))
    size = length if isinstance(length, Column) else F.lit(length)
    return F.substring(text, F.greatest(begin, F.lit(1)), F.greatest(size + F.least(begin - 1, F.lit(0)), F.lit(0)))


def concat(*parts: Column) -> Column:
    """Nulls count as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def average(value: Column) -> Column:
    """Decimals are averaged as doubles."""
    return F.avg(value.cast("double"))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 in UTC, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def day_of_week(day: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(day) - 1).cast("bigint")


def iso_day_of_week(day: Column) -> Column:
    """1 is Monday."""
    return (F.weekday(day) + 1).cast("bigint")


def age(later: Column, earlier: Column) -> Column:
    return later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")


def ascending(key: Column) -> Column:
    return key.asc_nulls_last()


def descending(key: Column) -> Column:
    return key.desc_nulls_first()
