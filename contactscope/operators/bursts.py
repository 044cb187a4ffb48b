"""Do flagged records cluster in time? A scan statistic over windows of all widths.

Every run of periods is a window. Its log likelihood ratio compares a flag share of its own, inside and
outside, with one share for all records; only windows with a higher share inside count. The window with
the largest ratio is the burst. Its p-value is the rank of its ratio among those of ``draws`` random tables, in which the
flags are dealt anew to the records, so it holds for the search over all windows at once.

The data is merged to one row a period first. Windows are pairs of periods, from running sums; there are
as many as the calendar has, however many records there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.functions.timeparts import period
from contactscope.sources.tables import materialise

DRAWS = 999
SEED = 42


def _part(c: Column, n: Column) -> Column:
    """c log(c / n) + (n - c) log((n - c) / n), where 0 log 0 is 0."""
    return F.when(c > 0, c * F.log(c / n)).otherwise(0.0) + F.when(c < n, (n - c) * F.log((n - c) / n)).otherwise(0.0)


def windows(df: DataFrame, flag: str, time: str, unit: str = "day") -> DataFrame:
    """(first_period, last_period, n, flagged, ratio): all windows with a higher share inside than outside."""
    each = df.select(period(F.col(time), unit).alias("period"), (F.col(flag) == 1).alias("hit"))
    each = each.where(F.col("period").isNotNull()).groupBy("period")
    each = each.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("c"))
    so_far = Window.orderBy("period")  # one row a period
    each = materialise(
        each.select(
            "period", F.row_number().over(so_far).alias("i"), "n", "c",
            F.sum("n").over(so_far).alias("n_to"), F.sum("c").over(so_far).alias("c_to"),
        ),
        "burst-periods",
    )
    total = each.agg(F.struct(F.max("i").alias("i"), F.sum("n").alias("n"), F.sum("c").alias("c"))).scalar()
    begin = each.withColumn("t", total).select(
        F.col("period").alias("first_period"),
        (F.col("n_to") - F.col("n")).alias("n_before"),
        (F.col("c_to") - F.col("c")).alias("c_before"),
        F.col("t.n").cast("double").alias("all_n"),
        F.col("t.c").cast("double").alias("all_c"),
        F.explode(F.sequence(F.col("i"), F.col("t.i"))).alias("i"),
    )
    end = each.select("i", F.col("period").alias("last_period"), "n_to", "c_to")
    both = begin.join(end, "i").select(
        "first_period", "last_period", "all_n", "all_c",
        (F.col("n_to") - F.col("n_before")).alias("n"), (F.col("c_to") - F.col("c_before")).alias("flagged"),
    )
    n, c = F.col("n").cast("double"), F.col("flagged").cast("double")
    rest_n, rest_c = F.col("all_n") - n, F.col("all_c") - c
    ratio = _part(c, n) + _part(rest_c, rest_n) - _part(F.col("all_c"), F.col("all_n"))
    higher = (rest_n > 0) & (c * rest_n > rest_c * n)
    return both.where(higher).select("first_period", "last_period", "n", "flagged", ratio.alias("ratio"))


def _largest(n: np.ndarray, c: np.ndarray) -> float:
    """The largest ratio over all windows of one table."""
    def part(c, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(c > 0, c * np.log(c / n), 0.0)
            return a + np.where(c < n, (n - c) * np.log((n - c) / n), 0.0)

    n_to, c_to = np.append(0, np.cumsum(n)).astype(float), np.append(0, np.cumsum(c)).astype(float)
    whole, best = part(c_to[-1:], n_to[-1:])[0], 0.0
    for i in range(len(n)):
        inside, hits = n_to[i + 1 :] - n_to[i], c_to[i + 1 :] - c_to[i]
        outside, others = n_to[-1] - inside, c_to[-1] - hits
        higher = (outside > 0) & (hits * outside > others * inside)
        if higher.any():
            found = part(hits[higher], inside[higher]) + part(others[higher], outside[higher])
            best = max(best, float(found.max()) - whole)
    return best


def _dealt(n: list[int], flagged: int, seed: int):
    """Draw numbers to the largest ratio of a table whose flags are dealt anew."""

    def run(batches):
        sizes = np.array(n)
        for batch in batches:
            best = []
            for draw in batch.column("draw").to_pylist():
                rng = np.random.default_rng([seed, draw])
                best.append(_largest(sizes, rng.multivariate_hypergeometric(sizes, flagged, method="marginals")))
            yield pa.record_batch([pa.array(best, pa.float64())], ["ratio"])

    return run


def burst(
    df: DataFrame, flag: str, time: str, unit: str = "day", draws: int = DRAWS, seed: int = SEED
) -> DataFrame:
    """One row (first_period, last_period, n, flagged, ratio, p_value): the window in which flags cluster most.

    Records without a time do not count; a missing flag is none. No row where no window stands out, as where all or
    no records are flagged. Of equal ratios the earlier, then shorter window counts. The random tables are
    drawn in tasks; the driver holds one number a period.
    """
    spark = df.sparkSession
    found = windows(df, flag, time, unit)
    best = materialise(
        found.orderBy(F.desc(F.round("ratio", 9)), "first_period", "last_period").limit(1), "burst-window"
    )
    row = best.first()
    if row is None:
        return best.withColumn("p_value", F.lit(None).cast("double"))
    counts = df.where(F.col(time).isNotNull()).groupBy(period(F.col(time), unit).alias("p"))
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag) == 1).alias("c")).orderBy("p").collect()
    cores = spark.sparkContext.defaultParallelism
    tables = spark.range(0, draws, 1, min(draws, 4 * cores)).select(F.col("id").alias("draw"))
    drawn = tables.mapInArrow(_dealt([r.n for r in counts], sum(r.c for r in counts), seed), "ratio double")
    reached = drawn.agg(F.count_if(F.col("ratio") >= F.lit(row.ratio - 1e-9))).first()[0]
    return best.withColumn("p_value", F.lit((1 + reached) / (1 + draws)))
