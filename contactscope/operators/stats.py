"""Chi-square and Mann-Whitney tests as aggregations.

Tables of any size reduce to counts per level or per distinct value; only the final
one-row figures meet a tail probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.functions.numeric import clip, level_or_zero
from contactscope.functions.tails import chi2_sf, normal_sf
from contactscope.operators.ranking import median, quantiles, running_totals
from contactscope.operators.rates import rate_by
from contactscope.operators.repeat import extreme_categories


def chi2_tests(
    df: DataFrame, factors: Sequence[str], outcome: str = "contacted", outcomes: Sequence | None = None
) -> DataFrame:
    """Chi-square test of independence of every factor and the outcome, in one pass.

    One row per factor: statistic, dof, rows used, p, and Cramer's V. Levels and outcomes are those
    that occur, or of these the named ``outcomes``; rows with a NULL on either side are left out.
    With one degree of freedom the differences are reduced by up to one half (Yates).
    """
    used = df.where(F.col(outcome).isNotNull())
    if outcomes is not None:
        used = used.where(F.col(outcome).isin(list(outcomes)))
    cells = (
        used.select(F.col(outcome).alias("__o"), *[F.col(f).cast("string").alias(f) for f in factors])
        .unpivot(["__o"], list(factors), "factor", "level")
        .where(F.col("level").isNotNull())
        .groupBy("factor", "level", "__o")
        .agg(F.count(F.lit(1)).cast("double").alias("cell"))
    )
    return _chi2_of(cells)


def _chi2_of(cells: DataFrame) -> DataFrame:
    """The test of each factor from its counts (factor, level, __o, cell)."""

    def margin(key: str, name: str) -> tuple[DataFrame, DataFrame]:
        sums = cells.groupBy("factor", key).agg(F.sum("cell").alias(name))
        return sums, sums.groupBy("factor").agg(
            F.count(F.lit(1)).alias(f"{name}_k"), F.sum(1.0 / F.col(name)).alias(f"{name}_inverse"),
            F.sum(name).alias(f"{name}_n"),
        )

    rows, row_totals = margin("level", "row")
    columns, column_totals = margin("__o", "column")
    totals = row_totals.join(column_totals.drop("column_n"), "factor").withColumn(
        "dof", ((F.col("row_k") - 1) * (F.col("column_k") - 1)).cast("bigint")
    )
    n = F.col("row_n")
    expected = F.col("row") * F.col("column") / n
    gap = F.col("cell") - expected
    met = cells.join(rows, ["factor", "level"]).join(columns, ["factor", "__o"]).join(totals, "factor")
    summed = met.groupBy("factor").agg(
        F.sum(gap * gap / expected).alias("present"),
        # A cell that does not occur adds its expectation.
        (F.max(n) - F.sum(expected)).alias("rest"),
        (F.count(F.lit(1)) < F.max("row_k") * F.max("column_k")).alias("holes"),
        F.max(F.abs(gap)).alias("gap"),
        *[F.max(c).alias(c) for c in ("dof", "row_n", "row_k", "column_k", "row_inverse", "column_inverse")],
    )
    # In a table of two by two all four differences are equal.
    kept = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    corrected = kept * kept * n * F.col("row_inverse") * F.col("column_inverse")
    plain = F.col("present") + F.when(F.col("holes"), F.col("rest")).otherwise(0.0)
    statistic = F.when(F.col("dof") == 0, F.lit(0.0)).when(F.col("dof") == 1, corrected).otherwise(plain)
    least = F.least("row_k", "column_k") - 1
    return (
        summed.withColumn("statistic", statistic)
        .select(
            "factor",
            "statistic",
            "dof",
            n.cast("bigint").alias("n"),
            F.sqrt(F.try_divide("statistic", n * least)).alias("cramers_v"),
        )
        .withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof")))
    )


def chi2_test(
    df: DataFrame, factor: str, outcome: str = "contacted", outcomes: Sequence | None = None
) -> DataFrame:
    """Chi-square test of one factor."""
    return chi2_tests(df, [factor], outcome, outcomes)


def mann_whitney(
    df: DataFrame,
    value: str,
    group: str,
    x,
    y,
    alternative: str = "two-sided",
    alpha: float = 0.05,
) -> DataFrame:
    """Mann-Whitney U test of group ``x`` against group ``y``, asymptotic, with tie correction.

    ``statistic`` is U of ``x``: the pairs it wins, ties counted half. The continuity
    correction is one half.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative: {alternative}")
    side = F.col(group)
    totals = running_totals(
        df.where(side.isin(x, y)).select(value, group),
        value,
        {"n1": F.count_if(side == F.lit(x)), "n2": F.count_if(side == F.lit(y))},
    )
    ties = (F.col("n1") + F.col("n2")).cast("double")
    wins = F.col("n1").cast("double") * (
        F.col("n2_before").cast("double") + F.col("n2").cast("double") / 2.0
    )
    row = totals.agg(
        F.coalesce(F.sum("n1"), F.lit(0)).cast("bigint").alias("n_x"),
        F.coalesce(F.sum("n2"), F.lit(0)).cast("bigint").alias("n_y"),
        F.sum(wins).alias("statistic"),
        F.sum(ties * ties * ties - ties).alias("ties"),
    )
    n1, n2 = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    both = n1 + n2
    spread = F.sqrt(
        n1 * n2 / 12.0 * ((both + 1.0) - F.try_divide(F.col("ties"), both * (both - 1.0)))
    )
    other = n1 * n2 - F.col("statistic")
    u = {
        "two-sided": F.greatest(F.col("statistic"), other),
        "greater": F.col("statistic"),
        "less": other,
    }[alternative]
    tail = normal_sf(F.col("z")) * (2.0 if alternative == "two-sided" else 1.0)
    return (
        row.withColumn("sd", spread)
        .withColumn("z", F.try_divide(u - n1 * n2 / 2.0 - 0.5, F.col("sd")))
        # All values equal: no evidence either way.
        .withColumn(
            "p_value",
            F.when(F.col("sd") > 0, F.least(F.lit(1.0), tail)).when(F.col("sd") == 0, F.lit(1.0)),
        )
        .select(
            "statistic",
            "n_x",
            "n_y",
            "z",
            F.when((F.col("n_x") > 0) & (F.col("n_y") > 0), F.col("p_value")).alias("p_value"),
            F.lit("asymptotic").alias("method"),
            # Share of pairs that x wins less the share that it loses.
            F.try_divide(F.lit(2.0) * F.col("statistic") - n1 * n2, n1 * n2).alias("rank_biserial"),
        )
        .withColumn("reject", (F.col("p_value") < alpha).cast("int"))
    )


def median_split(df: DataFrame, col: str, name: str = "value_group") -> DataFrame:
    """Add ``high`` above the median, ``low`` up to it, NULL for NULL.

    The median is taken after negative values are set to zero; the rows are compared
    as they are.
    """
    clipped = df.select(clip(F.col(col), lo=F.lit(0.0)).alias("__x"))
    middle = median(clipped, "__x").scalar()
    return (
        df.withColumn("__median", middle)
        .withColumn(
            name,
            F.when(F.col(col) > F.col("__median"), "high").when(
                F.col(col) <= F.col("__median"), "low"
            ),
        )
        .drop("__median")
    )


def value_test(df: DataFrame, amount: str = "order_amount", outcome: str = "contacted") -> DataFrame:
    """Two-sided Mann-Whitney test of the outcome, high against low amounts."""
    return mann_whitney(median_split(df, amount), outcome, "value_group", "high", "low")


def family_single_test(orders: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Do FAMILY orders have more contacts than SINGLE orders (those without any included)?"""
    group, value = "customer_group_type", "n_contacts"
    medians = quantiles(orders.where(F.col(group).isin("FAMILY", "SINGLE")), value, {"m": 0.5}, [group])
    pair = medians.agg(
        F.struct(
            F.max(F.when(F.col(group) == "FAMILY", F.col("m"))).alias("x"),
            F.max(F.when(F.col(group) == "SINGLE", F.col("m"))).alias("y"),
        )
    ).scalar()
    test = mann_whitney(orders, value, group, "FAMILY", "SINGLE", "greater", alpha)
    return test.withColumn("median_family", pair["x"]).withColumn("median_single", pair["y"])


def repeat_chi2(
    per_order: DataFrame, best: int = 8, worst: int = 4, min_volume: int = 500
) -> DataFrame:
    """Does the first category predict a repeat contact? Best and worst categories only."""
    chosen = extreme_categories(per_order, best, worst, min_volume)
    return chi2_test(chosen, "first_category", "is_repeat")


# The four categorical factors, and the levels each report row compares.
CHI2_FACTORS = {
    "is_canceled": "Order Cancellation",
    "is_changed": "Booking Modification",
    "customer_group_type": "Customer Group Type",
    "journey_type_id": "Journey Type",
}
COMPARED = {
    "is_canceled": ("1", "0"),
    "is_changed": ("1", "0"),
    "customer_group_type": ("FAMILY", "SINGLE"),
    "value_group": ("high", "low"),
}
VALUE_LABEL = "Order Value (High vs Low)"


def propensity(orders: DataFrame, amount: str = "order_amount") -> DataFrame:
    """Five rows: which order characteristics go with contact, and how strongly.

    ``first_*`` and ``second_*`` are the two contact rates worth comparing; for the
    journey type these are the highest and the lowest.
    """
    split = median_split(orders, amount)
    rates = rate_by(split, [*CHI2_FACTORS, "value_group"])
    level, rate, dimension = F.col("level"), F.col("contact_rate"), F.col("dimension")
    highest = F.min(F.struct((-rate).alias("r"), level.alias("level")))
    lowest = F.min(F.struct(rate.alias("r"), level.alias("level")))
    first_level, second_level = highest["level"], lowest["level"]
    first_rate, second_rate = -highest["r"], lowest["r"]
    for name, (a, b) in COMPARED.items():
        here = F.first(dimension) == name
        first_level = F.when(here, F.lit(a)).otherwise(first_level)
        second_level = F.when(here, F.lit(b)).otherwise(second_level)
        first_rate = F.when(here, level_or_zero(rate, level, a)).otherwise(first_rate)
        second_rate = F.when(here, level_or_zero(rate, level, b)).otherwise(second_rate)
    insight = rates.groupBy(dimension.alias("factor")).agg(
        first_level.alias("first_level"),
        first_rate.alias("first_rate"),
        second_level.alias("second_level"),
        second_rate.alias("second_rate"),
    )
    chi2 = chi2_tests(orders, list(CHI2_FACTORS)).select(
        "factor", F.lit("Chi-square").alias("test"), "statistic", "dof", "p_value"
    )
    ranks = mann_whitney(split, "contacted", "value_group", "high", "low").select(
        F.lit("value_group").alias("factor"),
        F.lit("Mann-Whitney U").alias("test"),
        "statistic",
        "p_value",
    )
    labels = F.create_map(
        *[F.lit(v) for pair in {**CHI2_FACTORS, "value_group": VALUE_LABEL}.items() for v in pair]
    )
    # Five rows on either side.
    return (
        chi2.unionByName(ranks, allowMissingColumns=True)
        .join(F.broadcast(insight), "factor", "left")
        .withColumn("label", F.element_at(labels, F.col("factor")))
    )

