"""Cleaning: test records, keys, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.functions.keys import decode_base36
from contactscope.functions.timeparts import parse_ts


def drop_test(contacts: DataFrame, flag: str = "is_test_errand") -> DataFrame:
    """Real records only. A missing flag is neither real nor test, so it goes too."""
    return contacts.where(F.col(flag) == 0)


def decode_keys(
    contacts: DataFrame, text: str = "order_number", key: str = "order_id", strict: bool = False
) -> DataFrame:
    """Add the integer order key decoded from its base-36 text."""
    return contacts.withColumn(key, decode_base36(F.col(text), strict))


def real_contacts(
    contacts: DataFrame, strict: bool = False, flag: str = "is_test_errand"
) -> DataFrame:
    """Contacts without test records, with decoded key and parsed time."""
    real = decode_keys(drop_test(contacts, flag), strict=strict)
    if dict(real.dtypes)["created"] != "timestamp_ntz":
        real = real.withColumn("created", parse_ts(F.col("created"), strict))
    return real


def fill_unknown(df: DataFrame, cols: Sequence[str], label: str = "Unknown") -> DataFrame:
    """NULL categories become a level of their own."""
    return df.na.fill(label, list(cols))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL numbers become 0."""
    return df.na.fill(0, list(cols))


def window_flag(
    contacts: DataFrame, orders: DataFrame, days: int = 90, name: str = "in_window"
) -> DataFrame:
    """Flag contacts made up to ``days`` after the last order.

    A contact without a time is outside the window, and so is every contact when
    there is no order at all.
    """
    end = orders.agg(F.max("order_created_at").alias("end")).scalar()
    limit = end + F.make_dt_interval(F.lit(days))
    return contacts.withColumn(name, F.coalesce(F.col("created") <= limit, F.lit(False)))


def in_window(contacts: DataFrame, orders: DataFrame, days: int = 90) -> DataFrame:
    """Contacts made up to ``days`` after the last order."""
    flagged = window_flag(contacts, orders, days, "__in")
    return flagged.where("__in").drop("__in")


def bucket_other(col: Column, keep: Sequence[str], label: str = "Other") -> Column:
    """Levels outside ``keep`` are merged into one; NULL stays NULL."""
    return F.when(col.isin(list(keep)), col).when(col.isNotNull(), F.lit(label))
