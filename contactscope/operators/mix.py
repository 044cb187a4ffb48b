"""Volumes, category and channel mixes, contingency tables, rankings.

Contacts are counted per (row, level) cell once; top lists, shares and pivots are
computed from those cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactscope.functions.numeric import share
from contactscope.functions.timeparts import period
from contactscope.operators.clean import bucket_other, window_flag
from contactscope.operators.link import uncontacted_share


def with_period(df: DataFrame, ts: str, unit: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or unit, period(F.col(ts), unit))


def volume_by_period(contacts: DataFrame, unit: str = "week", ts: str = "created") -> DataFrame:
    """Contacts per period; periods without contacts have no row."""
    return (
        with_period(contacts, ts, unit, "period")
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("contacts"))
    )


def rate_by_period(
    orders: DataFrame, unit: str = "week", ts: str = "order_created_at", key: str = "order_id"
) -> DataFrame:
    """Orders, contacted orders and contact rate per booking period."""
    n, hit = F.count(key), F.coalesce(F.sum("contacted"), F.lit(0)).cast("bigint")
    return (
        with_period(orders, ts, unit, "period")
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(n.alias("orders"), hit.alias("contacted_orders"), share(hit, n).alias("contact_rate"))
    )


def top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent levels; ties in name order."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), col)
        .limit(k)
    )


def keep_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """Only the rows of the k most frequent levels."""
    return df.join(F.broadcast(top_categories(df, col, k).select(col)), col, "left_semi")


MOST_COLUMNS = 10_000  # of a result with a column for each level


def cell_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    """Rows per (row level, column level), both present."""
    return (
        df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(row, col)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_mix(
    df: DataFrame, row: str, col: str, k: int | None = None, denom: str = "all"
) -> DataFrame:
    """Share of each level within each row, with a row for cells that are empty.

    ``k`` keeps the globally most frequent levels. ``denom="all"`` divides by all
    levels of the row, ``"top"`` by the kept ones only; an empty denominator gives
    NULL. Records without row or level count nowhere.
    """
    if denom not in ("all", "top"):
        raise ValueError(f"unknown denominator: {denom}")
    cells = cell_counts(df, row, col)
    levels = cells.groupBy(col).agg(F.sum("n").alias("n"))
    if k is not None:
        levels = levels.orderBy(F.desc("n"), col).limit(k)
    # The list of columns of the result: k names, or the names of all levels.
    kept = levels.agg(F.sort_array(F.collect_list(col)).alias("kept")).scalar()
    in_kept = F.array_contains(F.col("__kept"), F.col(col))
    per_row = (
        cells.withColumn("__kept", kept)
        .groupBy(row)
        .agg(
            F.sum("n").alias("__all"),
            F.sum(F.when(in_kept, F.col("n"))).alias("__top"),
            F.map_from_entries(
                F.collect_list(F.when(in_kept, F.struct(F.col(col), F.col("n"))))
            ).alias("__cells"),
        )
        .withColumn("__kept", kept)
    )
    base = F.col("__all") if denom == "all" else F.coalesce(F.col("__top"), F.lit(0))
    return (
        per_row.select(row, "__cells", base.alias("__base"), F.explode("__kept").alias(col))
        .withColumn("n", F.coalesce(F.try_element_at("__cells", F.col(col)), F.lit(0)))
        .select(row, col, "n", (share(F.col("n"), F.col("__base")) * 100).alias("pct"))
    )


def share_within(cells: DataFrame, row: str, value: str = "n") -> DataFrame:
    """Each cell of an aggregated table as a share of its row."""
    total = F.sum(value).over(Window.partitionBy(row))
    return cells.withColumn("share", share(F.col(value), total))


def channel_share(contacts: DataFrame, unit: str = "quarter", ts: str = "created") -> DataFrame:
    """Channel shares per period, in percent."""
    return category_mix(with_period(contacts, ts, unit, "period"), "period", "errand_channel")


def levels_of(df: DataFrame, col: str) -> list:
    """The levels of a column in order, for the columns of a result; too many stop the job."""
    found = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)
    levels = [r[0] for r in found.limit(MOST_COLUMNS + 1).collect()]
    if len(levels) > MOST_COLUMNS:
        raise ValueError(f"{col} has more than {MOST_COLUMNS} levels")
    return levels


def cross_counts(
    df: DataFrame, row: str, col: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Two-key counts, one column per level, 0 where there is none; all levels unless some are named."""
    values = levels_of(df, col) if values is None else values
    return (
        df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(row)
        .agg(*[F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values])
    )


def contingency(
    df: DataFrame, factor: str, outcome: str, outcomes: Sequence | None = None
) -> DataFrame:
    """Factor level x outcome counts in long form, zero cells included.

    All outcomes that occur, unless some are named.
    """
    outcomes = levels_of(df, outcome) if outcomes is None else outcomes
    if not outcomes:
        outcomes = [None]
    wide = (
        df.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
        .groupBy(F.col(factor).cast("string").alias("level"))
        .agg(*[F.count_if(F.col(outcome) == F.lit(o)).alias(f"o{i}") for i, o in enumerate(outcomes)])
    )
    cells = [
        F.struct(F.lit(o).alias("outcome"), F.col(f"o{i}").alias("n"))
        for i, o in enumerate(outcomes)
    ]
    return wide.select("level", F.inline(F.array(*cells)))


def monthly_volume(
    contacts: DataFrame,
    keep: Sequence[str],
    unit: str = "month",
    col: str = "errand_category",
    ts: str = "created",
    other: str = "Other",
) -> DataFrame:
    """Volume per period of the named levels and of all others, stacked in that order.

    ``bottom`` is the running total below a series within its period; ``total`` is
    the whole period.
    """
    named = [*keep, other]
    counted = (
        with_period(contacts, ts, unit, "period")
        .withColumn("series", bucket_other(F.col(col), keep, other))
        .where(F.col("period").isNotNull() & F.col("series").isNotNull())
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("series") == name).alias(f"s{i}") for i, name in enumerate(named)],
        )
    )
    stacked, bottom = [], F.lit(0).cast("bigint")
    for i, name in enumerate(named):
        n = F.col(f"s{i}")
        stacked.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("series"),
                n.alias("contacts"),
                bottom.alias("bottom"),
            )
        )
        bottom = bottom + n
    return counted.select("period", "total", F.inline(F.array(*stacked)))


def linkage_report(orders: DataFrame, contacts: DataFrame, days: int = 90) -> DataFrame:
    """Contacts in and out of the order window and orders without contact: (metric, n, pct)."""
    inside = F.count_if("in_window")
    total = F.count(F.lit(1))
    counted = window_flag(contacts, orders, days).agg(
        total.alias("total"), inside.alias("inside"), (total - inside).alias("outside")
    )

    def row(metric: str, n: str, base: str):
        pct = share(F.col(n), F.col(base)) * 100
        return F.struct(F.lit(metric).alias("metric"), F.col(n).alias("n"), pct.alias("pct"))

    windows = counted.select(
        F.inline(
            F.array(
                row("real_contacts", "total", "total"),
                row("in_window", "inside", "total"),
                row("out_of_window", "outside", "total"),
            )
        )
    )
    none = uncontacted_share(orders, contacts).select(
        F.lit("orders_without_contact").alias("metric"),
        F.col("uncontacted").alias("n"),
        F.col("uncontacted_pct").alias("pct"),
    )
    return windows.unionByName(none)


def out_of_window(contacts: DataFrame, orders: DataFrame, days: int = 90) -> DataFrame:
    """Contacts later than the window, and those without a time."""
    return window_flag(contacts, orders, days, "__in").where(~F.col("__in")).drop("__in")


def out_of_window_span(contacts: DataFrame, orders: DataFrame, days: int = 90) -> DataFrame:
    """First and last date of the contacts outside the window."""
    return out_of_window(contacts, orders, days).agg(
        F.to_date(F.min("created")).alias("first_date"),
        F.to_date(F.max("created")).alias("last_date"),
    )


def head_tail(df: DataFrame, head: int, tail: int, rate: str, key: str) -> DataFrame:
    """The first and the last rows of a ranking, each row once."""
    best = df.orderBy(F.desc(rate), key).limit(head)
    worst = df.orderBy(rate, F.desc(key)).limit(tail)
    return best.unionByName(worst).distinct()


def union_results(parts: Mapping[str, DataFrame], name: str = "report") -> DataFrame:
    """Result rows of unlike reports under each other; columns a part lacks are NULL."""
    out = None
    for label, part in parts.items():
        part = part.withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
