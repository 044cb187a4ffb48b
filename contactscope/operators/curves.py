"""Time to first contact: summary, survival curves, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.functions.numeric import share
from contactscope.operators.link import first_contact
from contactscope.operators.ranking import order_statistics, quantiles, running_totals


def ttfc(contacts: DataFrame, orders: DataFrame) -> DataFrame:
    """Hours from order to first contact per key, contacts before the order left out."""
    return (
        first_contact(contacts, orders, with_category=False)
        .where("hours_ttfc >= 0")
        .select("order_id", "hours_ttfc")
    )


def ttfc_summary(times: DataFrame, col: str = "hours_ttfc") -> DataFrame:
    """Number, median in hours and days, shares within 24 and 48 hours."""
    middle = quantiles(times, col, {"median_hours": 0.5}).select("median_hours").scalar()
    return (
        times.agg(
            F.count(col).alias("n"),
            F.avg((F.col(col) <= 24).cast("int")).alias("within_24h"),
            F.avg((F.col(col) <= 48).cast("int")).alias("within_48h"),
        )
        .withColumn("median_hours", middle)
        .withColumn("median_days", F.col("median_hours") / 24)
    )


def _grid_point(i: Column, step: Column, top: Column, last: int) -> Column:
    """Evenly spaced points from 0; the last one is exactly the upper end."""
    return F.when(i == last, top).otherwise(i.cast("double") * step)


def survival_curve(
    df: DataFrame, col: str = "hours_ttfc", points: int = 500, q: float = 0.99
) -> DataFrame:
    """Share of times at or above each of evenly spaced points.

    The points run from 0 to the value at 0-based position int(q n) of the sorted
    times. Each time is put at the last point it reaches, so one pass and a running
    total over the points replace a comparison of all times with every point.
    """
    last = points - 1
    ends = order_statistics(
        df, col, {"top": lambda n: F.least(F.floor(n.cast("double") * F.lit(q)), n - 1)}
    ).agg(F.struct(F.max("top").alias("top"), F.max("n").alias("n")).alias("s"))
    top, n = ends.scalar()["top"], ends.scalar()["n"]

    binned = (
        df.where(F.col(col) >= 0)
        .select(F.col(col).alias("t"), top.alias("top"))
        .withColumn("step", F.col("top") / F.lit(float(last)))
        .withColumn(
            "i",
            F.coalesce(
                F.least(F.floor(F.try_divide("t", "step")), F.lit(last).cast("bigint")),
                F.lit(last).cast("bigint"),
            ),
        )
    )
    # Rounding may put a time one point off; compare with the points themselves.
    i, step, end = F.col("i"), F.col("step"), F.col("top")
    reached = (
        F.when((i < last) & (_grid_point(i + 1, step, end, last) <= F.col("t")), i + 1)
        .when((i > 0) & (_grid_point(i, step, end, last) > F.col("t")), i - 1)
        .otherwise(i)
    )
    counts = binned.groupBy(reached.alias("point")).agg(F.count(F.lit(1)).alias("__n"))
    grid = df.sparkSession.range(points).withColumnRenamed("id", "point")
    onward = Window.orderBy(F.desc("point")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        grid.join(counts, "point", "left")
        .withColumn("at_risk", F.sum(F.coalesce(F.col("__n"), F.lit(0))).over(onward))
        .withColumn("top", top)
        .withColumn("n", n)
        .select(
            "point",
            _grid_point(F.col("point"), F.col("top") / F.lit(float(last)), F.col("top"), last).alias(
                "hours"
            ),
            "at_risk",
            share(F.col("at_risk"), F.col("n")).alias("survival"),
        )
    )


def survival_steps(df: DataFrame, col: str = "hours_ttfc") -> DataFrame:
    """The exact step form: share of times at or above each distinct time."""
    steps = running_totals(df, col, {"n": F.count(F.lit(1))}, descending=True)
    total = df.agg(F.count(col)).scalar()
    at_risk = F.col("n") + F.col("n_before")
    return steps.withColumn("__total", total).select(
        F.col(col).alias("hours"),
        "n",
        at_risk.alias("at_risk"),
        share(at_risk, F.col("__total")).alias("survival"),
    )


def equal_width_hist(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin is closed, empty bins are listed.

    When all values are equal the range is half a unit to either side.
    """
    ends = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    flat = F.col("__lo") == F.col("__hi")

    def with_ends(frame: DataFrame) -> DataFrame:
        return (
            frame.withColumn("__lo", ends["lo"].cast("double"))
            .withColumn("__hi", ends["hi"].cast("double"))
            .withColumn("lo", F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")))
            .withColumn("hi", F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")))
            .drop("__lo", "__hi")
        )

    position = F.floor((F.col(col) - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo")))
    counts = (
        with_ends(df.where(F.col(col).isNotNull()).select(col))
        .groupBy((F.least(position, F.lit(bins - 1).cast("bigint")) + 1).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = with_ends(df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1).cast("double") * width).alias("left_edge"),
        (F.col("lo") + F.col("bin").cast("double") * width).alias("right_edge"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


def ttfc_histogram(times: DataFrame, col: str = "hours_ttfc", limit_hours: float = 720.0, bins: int = 50) -> DataFrame:
    """Days to first contact up to the limit, in equal bins, with their median."""
    days = times.where(F.col(col) <= limit_hours).select((F.col(col) / 24).alias("days"))
    middle = quantiles(days, "days", {"median_days": 0.5}).select("median_days").scalar()
    return equal_width_hist(days, "days", bins).withColumn("median_days", middle)
