"""Timestamps without time zone: parsing, periods, parts and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(col: Column, strict: bool = False) -> Column:
    """Text to TIMESTAMP_NTZ; unreadable text gives NULL, or stops the job when ``strict``."""
    parsed = col.try_cast("timestamp_ntz")
    if not strict:
        return parsed
    message = F.concat(F.lit("not a timestamp: "), col.cast("string"))
    return F.when(col.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def period(col: Column, unit: str) -> Column:
    """The day, or the first day of the week (Monday), month, quarter or year."""
    return F.to_date(col) if unit == "day" else F.trunc(F.to_date(col), unit)


def hours_between(start: Column, end: Column) -> Column:
    """end - start in fractional hours; does not depend on the session time zone."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)").cast("double")
    return seconds / F.lit(3600.0)


def plus_days(col: Column, days: int) -> Column:
    return col + F.make_dt_interval(F.lit(days))


def booking_parts(col: Column) -> dict[str, Column]:
    """Hour, day of week (Monday = 0) and month of a timestamp."""
    return {
        "book_hour": F.hour(col),
        "book_dow": F.weekday(col),
        "book_month": F.month(col),
    }
