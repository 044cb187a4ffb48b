"""Data-quality audit. Each report is one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.functions.numeric import share
from contactscope.functions.timeparts import period


def _long(row: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """One-row wide aggregate to one row per name."""
    pairs = [F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names]
    return row.select(F.inline(F.array(*pairs)))


def table_shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long(row, df.columns, "column", "nulls").where("nulls > 0")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key; all missing keys count as one key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.lit(key).alias("key"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def threshold_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that meet each rule, and their share of all rows."""
    row = df.agg(
        F.count(F.lit(1)).alias("__all"), *[F.count_if(cond).alias(n) for n, cond in rules.items()]
    )
    pairs = [
        F.struct(
            F.lit(n).alias("rule"),
            F.col(n).alias("n"),
            (share(F.col(n), F.col("__all")) * 100).alias("pct"),
        )
        for n in rules
    ]
    return row.select(F.inline(F.array(*pairs)))


def financial_rules(amount: str = "order_amount", revenue: str = "revenue") -> dict[str, Column]:
    """Negative amounts and revenues, and amounts above one million."""
    return {
        "negative_amount": F.col(amount) < 0,
        "negative_revenue": F.col(revenue) < 0,
        "extreme_amount": F.col(amount) > 1_000_000,
    }


def test_flag_audit(contacts: DataFrame, flag: str = "is_test_errand") -> DataFrame:
    """How many records are test records, and what remains."""
    test = F.count_if(F.col(flag) == 1)
    total = F.count(F.lit(1))
    return contacts.agg(
        total.alias("contacts"),
        test.alias("test_contacts"),
        F.count_if(F.col(flag) == 0).alias("real_contacts"),
        (share(test, total) * 100).alias("test_pct"),
    )


def date_coverage(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last date of each table, and how many days each lies after the first table's."""
    out, first = None, None
    for name, (df, col) in tables.items():
        row = df.agg(
            F.lit(name).alias("table"),
            F.to_date(F.min(col)).alias("first_date"),
            F.to_date(F.max(col)).alias("last_date"),
        )
        first = row if first is None else first
        out = row if out is None else out.unionByName(row)
    base = first.agg(F.struct(F.max("first_date").alias("a"), F.max("last_date").alias("b")).alias("s")).scalar()
    return out.select(
        "*",
        F.date_diff("first_date", base["a"]).alias("first_gap_days"),
        F.date_diff("last_date", base["b"]).alias("last_gap_days"),
    )


def flag_share_by_period(df: DataFrame, flag: str, ts: str, unit: str = "month") -> DataFrame:
    """Share of flagged records per period: shows whether they cluster in time."""
    hits = F.count_if(F.col(flag) == 1)
    return (
        df.withColumn("period", period(F.col(ts), unit))
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("n"),
            hits.alias("flagged"),
            share(hits, F.count(F.lit(1))).alias("flag_share"),
        )
    )
