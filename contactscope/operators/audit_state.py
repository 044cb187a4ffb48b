"""Data audits from a state kept by period, so that a new day or month reads only its own rows.

A period's state is one row of counters and extremes, and the rows of several periods add up to the audit of
all of them: missing cells, rows that meet a rule, test records, undecodable keys, first and last time.
Repeated keys are no sum of periods. They come from a second table with the number of rows of each key and
period, in which a key that occurs once is one short row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.functions.numeric import share
from contactscope.functions.timeparts import period


def period_state(
    df: DataFrame, time: str, columns: Sequence[str], rules: Mapping[str, Column], unit: str = "day"
) -> DataFrame:
    """One row a period: n_rows, ``nulls_<column>``, ``rule_<name>``, first_time, last_time. Rows without a time
    have the period NULL."""
    return df.groupBy(period(F.col(time), unit).alias("period")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns],
        *[F.count_if(condition).alias(f"rule_{name}") for name, condition in rules.items()],
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def key_state(df: DataFrame, time: str, key: str, unit: str = "day") -> DataFrame:
    """(period, key, n): rows of each key and period."""
    part = period(F.col(time), unit).alias("period")
    return df.groupBy(part, F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def merged_state(state: DataFrame) -> DataFrame:
    """One row: the state of all periods."""
    sums = [c for c in state.columns if c == "n_rows" or c.startswith(("nulls_", "rule_"))]
    return state.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def audit(state: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(metric, n, pct): every counter of the merged state with its share of the rows, and the repeated keys."""
    row = merged_state(state)
    counters = [c for c in row.columns if c == "n_rows" or c.startswith(("nulls_", "rule_"))]
    pairs = [
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("n"), (share(F.col(c), F.col("n_rows")) * 100).alias("pct"))
        for c in counters
    ]
    out = row.select(F.inline(F.array(*pairs)))
    if keys is not None:
        repeated = keys.groupBy("key").agg(F.sum("n").alias("n")).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")
        )
        pct = (share(F.col("n"), F.col("all")) * 100).alias("pct")
        out = out.unionByName(repeated.select(F.lit("repeated_keys").alias("metric"), "n", pct))
    return out


def coverage(state: DataFrame) -> DataFrame:
    """One row: first and last date, and how many periods have rows."""
    return merged_state(state).select(
        F.to_date("first_time").alias("first_date"), F.to_date("last_time").alias("last_date")
    ).crossJoin(F.broadcast(state.agg(F.count("period").alias("periods"))))  # one row each
