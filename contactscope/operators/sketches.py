"""Quantiles from mergeable sketches kept by level and period.

A KLL sketch of some thousand numbers stands for any number of values, and sketches of disjoint rows merge into the
sketch of all of them. So a table has one small row a level and week; a new week adds its rows, and quantiles
over any set of levels and weeks come from merging rows, not from the data. The rank of a quantile is off by
less than ``rank_error`` of all values, with 99 % probability for each one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.functions.timeparts import period

SIZE = 1600


def rank_error(size: int = SIZE) -> float:
    """The published bound of the normalised rank error of a single quantile."""
    return 2.296 / size**0.9021


def sketch_by_period(
    df: DataFrame, by: Sequence[str], time: str, value: str, unit: str = "week", size: int = SIZE
) -> DataFrame:
    """(levels, period, n, sketch): one row a combination of levels and period.

    Missing and NaN values do not count; rows without a time have the period NULL, and missing levels are a level.
    """
    number = F.col(value).cast("double")
    rows = df.select(*by, period(F.col(time), unit).alias("period"), F.when(~F.isnan(number), number).alias("__v"))
    rows = rows.where(F.col("__v").isNotNull())
    return rows.groupBy(*by, "period").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("__v", size).alias("sketch")
    )


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser groups: (levels, n, sketch)."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(levels, n, prob, value): the quantiles of every row of a table of sketches."""
    pairs = [
        F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
        for p in probs
    ]
    return sketches.select(*by, "n", F.inline(F.array(*pairs)))


def exact_ranks(found: DataFrame, df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``found`` with the shares of the data's values below and up to each quantile."""
    rows = df.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(value).cast("double").alias("__v"))
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    same: Column = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # A value meets the few quantiles of its own level.
    few = F.broadcast(found)
    met = rows.join(few, same) if by else rows.crossJoin(few)
    names = [*by, "prob"]
    counted = met.groupBy(*[F.col(c).alias(f"__at_{c}") for c in names]).agg(
        F.count_if(F.col("__v") < F.col("value")).alias("__below"),
        F.count_if(F.col("__v") <= F.col("value")).alias("__upto"),
    )
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__at_{c}"))
    shares = [(F.col(f"__{c}") / F.col("n")).alias(f"share_{c}") for c in ("below", "upto")]
    return found.join(counted, same, "left").select(*found.columns, *shares)
