"""Order statistics and running totals over a whole column, without a global sort.

A window without partitions would put every distinct value into one task. Here
values are first put into buckets that keep their order, 4,096 per power of two: a
column that spans ten powers of two is spread over some 40,000 of them, and no
column of doubles can fill more than 2 * 2100 * 4096. Only the bucket totals pass
through a single window; the values are accumulated inside their bucket, and the
totals of the buckets before are added. Rows with the same value are merged before
they meet, so one hot value is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 4096
ZERO_OFFSET = 1100 * PER_OCTAVE  # above the lowest exponent a double can have

BUCKET = "__bucket"


def value_bucket(value: Column) -> Column:
    """Bucket number of a numeric value; never decreases when the value grows."""
    value = value.cast("double")
    size = F.floor(F.log2(F.abs(value)) * PER_OCTAVE) + ZERO_OFFSET
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("int")


def running_totals(
    df: DataFrame, value: str, measures: Mapping[str, Column], descending: bool = False, following: bool = False
) -> DataFrame:
    """One row per distinct value with each measure and its exclusive running total.

    ``measures`` maps names to aggregates that can be summed. For measure ``m``
    the result has ``m`` (of that value) and ``m_before`` (of all values that come
    earlier in the order), and with ``following`` also ``m_next`` (of the next value in the order, NULL
    at the last one). Rows whose value is NULL are left out.
    """
    names = list(measures)
    direction = F.desc if descending else F.asc
    per_value = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(*[agg.alias(name) for name, agg in measures.items()])
        .withColumn(BUCKET, value_bucket(F.col(value)))
    )
    at_head = F.max_by if descending else F.min_by
    heads = [at_head(n, value).alias(f"__head_{n}") for n in names] if following else []
    buckets = per_value.groupBy(BUCKET).agg(*[F.sum(n).alias(n) for n in names], *heads)
    in_order = Window.orderBy(direction(BUCKET))
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        BUCKET,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in names],
        *[F.lead(f"__head_{n}").over(in_order).alias(f"__next_{n}") for n in names if following],
    )
    values = Window.partitionBy(BUCKET).orderBy(direction(value))
    inside = values.rowsBetween(Window.unboundedPreceding, -1)
    # Join and window both need the values by bucket, so the join adds no shuffle.
    return per_value.join(offsets, BUCKET).select(
        value,
        *names,
        *[
            (F.col(f"__{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before")
            for n in names
        ],
        # The last value of a bucket is followed by the first one of the next bucket.
        *[F.coalesce(F.lead(n).over(values), f"__next_{n}").alias(f"{n}_next") for n in names if following],
    )


def order_statistics(
    df: DataFrame,
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact values at given 0-based ranks: one row, or one row per group.

    ``ranks`` maps an output name to a function from the row count to the rank.
    The result has the group columns, ``n`` (non-NULL values) and the named values.

    A first pass counts rows per bucket; only the buckets that hold a wanted rank
    are looked at value by value. Without groups these are at most one bucket per
    rank, so the second pass is a filter on the scan. With groups the rows are
    first merged per group and value.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).alias("__value"), value_bucket(F.col(value)).alias(BUCKET)
    )
    if by:
        rows = rows.groupBy(*by, BUCKET, "__value").agg(F.count(F.lit(1)).alias("__n"))
    else:
        rows = rows.withColumn("__n", F.lit(1).cast("bigint"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (
        rows.groupBy(*by, BUCKET)
        .agg(F.sum("__n").alias("__in_bucket"))
        .withColumns(
            {
                "n": F.sum("__in_bucket").over(group),
                "__before": F.sum("__in_bucket").over(upto) - F.col("__in_bucket"),
            }
        )
    )
    at_columns = [f"__at_{name}" for name in ranks]
    wanted = F.lit(False)
    for at in at_columns:
        end = F.col("__before") + F.col("__in_bucket")
        wanted = wanted | ((F.col(at) >= F.col("__before")) & (F.col(at) < end))
    targets = (
        counted.withColumns(
            {at: rank(F.col("n")).cast("bigint") for at, rank in zip(at_columns, ranks.values())}
        )
        .where(wanted)
        .drop("__in_bucket")
    )
    if not by:
        targets = F.broadcast(targets)  # at most one row per wanted rank
    inside = (
        Window.partitionBy(*by, BUCKET)
        .orderBy("__value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = (
        rows.join(targets, [*by, BUCKET])
        .groupBy(*by, BUCKET, "__before", "n", *at_columns, "__value")
        .agg(F.sum("__n").alias("__n"))
        .withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
    )
    start = F.col("__end") - F.col("__n")

    def picked(name: str) -> Column:
        at = F.col(f"__at_{name}")
        return F.max(F.when((at >= start) & (at < F.col("__end")), F.col("__value"))).alias(name)

    return values.groupBy(*by).agg(F.max("n").alias("n"), *[picked(name) for name in ranks])


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, per group if wanted."""

    def position(prob: float, n: Column) -> Column:
        return (n - 1).cast("double") * F.lit(float(prob))

    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, prob in probs.items():
        ranks[f"{name}__lo"] = lambda n, p=prob: F.floor(position(p, n))
        ranks[f"{name}__hi"] = lambda n, p=prob: F.ceil(position(p, n))
    found = order_statistics(df, value, ranks, by)
    out = []
    for name, prob in probs.items():
        lo = F.col(f"{name}__lo").cast("double")
        hi = F.col(f"{name}__hi").cast("double")
        at = position(prob, F.col("n"))
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return found.select(*by, "n", *out)


def capped_sums(df: DataFrame, value: str, prob: float, by: Sequence[str]) -> DataFrame:
    """Per group: rows, values, their ``prob`` quantile ``cap``, and the sum of values clipped to it.

    Values above the lower neighbour of the quantile are clipped, so the sum needs the running
    totals up to that neighbour only. Rows are merged once, per group, bucket and value; of the
    merged rows only those of the one bucket with that neighbour are looked at again.
    """
    by = list(by)
    merged = (
        df.select(
            *by,
            F.when(F.col(value).isNotNull(), value_bucket(F.col(value))).alias(BUCKET),
            F.col(value).cast("double").alias("__value"),
        )
        .groupBy(*by, BUCKET, "__value")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy(F.asc_nulls_first(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(BUCKET).isNotNull()

    def before(col: str) -> Column:
        return F.coalesce(F.sum(F.when(known, F.col(col))).over(earlier), F.lit(0))

    buckets = (
        merged.groupBy(*by, BUCKET)
        .agg(
            F.sum("__c").alias("__in"),
            F.sum(F.col("__value") * F.col("__c")).alias("__sum"),
            F.min("__value").alias("__least"),
        )
        .withColumns(
            {
                "n_rows": F.sum("__in").over(group),
                "n": F.coalesce(F.sum(F.when(known, F.col("__in"))).over(group), F.lit(0)),
                "__before": before("__in"),
                "__sum_before": before("__sum"),
                "__next": F.lead("__least").over(group.orderBy(F.asc_nulls_first(BUCKET))),
            }
        )
    )
    at = (F.col("n") - 1).cast("double") * F.lit(float(prob))
    lo, hi = F.floor(at), F.ceil(at)
    # The bucket with the lower neighbour, or the only one of a group without values.
    here = known & (F.col("__before") <= lo) & (lo < F.col("__before") + F.col("__in"))
    keys = [*by, BUCKET]
    targets = buckets.where(here | (F.col("n") == 0)).select(
        *[F.col(c).alias(f"__k_{c}") for c in keys],
        *["n_rows", "n", "__before", "__sum_before", "__next"],
    )
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    met = merged.join(targets, condition)
    upto = (
        Window.partitionBy(*by, BUCKET)
        .orderBy("__value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = met.withColumns(
        {
            "__end": F.col("__before") + F.sum("__c").over(upto),
            "__upto": F.col("__sum_before") + F.sum(F.col("__value") * F.col("__c")).over(upto),
        }
    )
    start = F.col("__end") - F.col("__c")
    is_lo = (start <= lo) & (lo < F.col("__end"))
    is_hi = (start <= hi) & (hi < F.col("__end"))
    found = values.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"),
        F.max("n").alias("n"),
        F.max(F.when(is_lo, F.col("__value"))).alias("__lo"),
        F.coalesce(F.max(F.when(is_hi, F.col("__value"))), F.max("__next")).alias("__hi"),
        F.max(F.when(is_lo, F.col("__end"))).alias("__n_lo"),
        F.max(F.when(is_lo, F.col("__upto"))).alias("__sum_lo"),
    )
    cap = F.col("__lo") + (at - F.floor(at)) * (F.coalesce("__hi", "__lo") - F.col("__lo"))
    return found.withColumn("cap", cap).select(
        *by, "n_rows", "n", "cap",
        (F.col("__sum_lo") + (F.col("n") - F.col("__n_lo")) * F.col("cap")).alias("capped_sum"),
    )


def median(df: DataFrame, value: str, approx: bool = False) -> DataFrame:
    """One row ``median``. ``approx`` trades the exact value for a single pass."""
    if approx:
        return df.agg(F.percentile_approx(value, 0.5).cast("double").alias("median"))
    return quantiles(df, value, {"median": 0.5}).select("median")
