"""Null-preserving numeric helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(col: Column, lo=None, hi=None) -> Column:
    """Bound a column from below, above or both; NULL stays NULL."""
    out = col
    if lo is not None:
        out = F.when(col < lo, lo).otherwise(out)
    if hi is not None:
        out = F.when(col > hi, hi).otherwise(out)
    return out


def log_amount(col: Column) -> Column:
    """log(1 + x) of an amount, with negative amounts counted as zero."""
    return F.log1p(clip(col, lo=F.lit(0.0)))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def round_even(col: Column, places: int) -> Column:
    """Round half to even after scaling, as array libraries do.

    ``bround`` would look at the shortest decimal text of a number instead.
    """
    scale = F.lit(float(10**places))
    return F.rint(col * scale) / scale


def relabel(col: Column, labels: Mapping) -> Column:
    """Replace the listed values by labels; other values turn into their text."""
    out = col.cast("string")
    for value, label in labels.items():
        out = F.when(col == F.lit(value), F.lit(label)).otherwise(out)
    return out


def is_missing(col: Column) -> Column:
    """1 where the value is NULL, else 0."""
    return col.isNull().cast("int")


def level_or_zero(rate: Column, level: Column, wanted) -> Column:
    """Aggregate: the rate of one level, 0 when that level does not occur."""
    return F.coalesce(F.max(F.when(level == F.lit(wanted), rate)), F.lit(0.0))
