"""Booking-time features, encodings, weights and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.functions.numeric import is_missing, log_amount
from contactscope.functions.timeparts import booking_parts
from contactscope.operators.clean import fill_unknown, fill_zero
from contactscope.sources.tables import materialise

# What is known when an order is placed, what is only known later,
# and what the segmentation looks at.
CATEGORICAL = [
    "brand", "booking_system", "customer_group_type", "device", "client_entry_type",
    "booking_system_source_type", "journey_type_id", "site_country", "currency",
]
NUMERIC = ["order_amt_log", "book_hour", "book_dow", "book_month", "is_direct"]
POST_BOOKING = [
    "is_canceled", "is_changed", "cancel_reason", "change_reason", "n_contacts",
]
CLUSTER_CATEGORICAL = [
    "customer_group_type", "journey_type_id", "device", "brand", "booking_system_source_type",
]
BROADCAST_LEVELS = 1_000_000  # columns with more levels than this together are coded by a join
LEVELS_PER_TASK = 1_000_000
CLUSTER_NUMERIC = ["contacted", "n_contacts", "is_changed", "is_canceled"]


def booking_features(
    orders: DataFrame,
    categorical: Sequence[str] = CATEGORICAL,
    key: str = "order_id",
    label: str = "contacted",
) -> DataFrame:
    """Key, label, categorical and numeric features known at booking time.

    Asking for a column that is only filled in later is an error.
    """
    leaks = sorted({c.lower() for c in categorical} & {*POST_BOOKING, label})
    if leaks:
        raise ValueError(f"not known at booking time: {', '.join(leaks)}")
    parts = booking_parts(F.col("order_created_at"))
    numeric = orders.select(
        key,
        label,
        *categorical,
        log_amount(F.col("order_amount")).alias("order_amt_log"),
        *[part.alias(name) for name, part in parts.items()],
        is_missing(F.col("partner")).alias("is_direct"),
    )
    return fill_zero(fill_unknown(numeric, categorical), NUMERIC)


def level_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(__column, __level, __code): every level of the columns and its position among the column's sorted levels.

    All columns share one sorted order. It is cut into ranges of some ``LEVELS_PER_TASK`` levels, each sorted on its own;
    a level's position is its place in its range after the lengths of the ranges before.
    The driver holds one number a range and one a column.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "__column", "__level")
    levels = materialise(long.where(F.col("__level").isNotNull()).distinct(), "levels")
    ranges = -(-levels.count() // LEVELS_PER_TASK)
    order = ["__column", "__level"]
    if ranges > 1:
        levels = levels.repartitionByRange(ranges, *order)
    else:
        levels = levels.coalesce(1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    levels = materialise(
        levels.sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("__range"), place.alias("__place")),
        "level-order",
    )
    sizes = levels.groupBy("__column", "__range").agg(F.min("__place").alias("low"), F.count(F.lit(1)).alias("n")).collect()
    before, starts = [0] * (ranges + 1), {}
    for r in sorted(sizes, key=lambda r: r["__range"]):
        before[r["__range"]] += r.n
    before = [sum(before[:i]) for i in range(len(before))]
    for r in sizes:
        at = before[r["__range"]] + r.low
        starts[r["__column"]] = min(at, starts.get(r["__column"], at))
    offset = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("__range") + 1)
    start = F.lit(0)
    for c, at in starts.items():
        start = F.when(F.col("__column") == c, F.lit(at)).otherwise(start)
    return levels.select(*order, (F.col("__place") + offset - start).cast("int").alias("__code"))


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_enc``: the position of the level among the sorted levels.

    The levels of all columns are found, numbered and stored while this is called. Columns with
    ``BROADCAST_LEVELS`` levels together are coded from one dictionary that every task holds; the levels of
    all other columns meet theirs in one join and come back by row. The codes are plain integers, so tree
    learners take them as ordinal numbers. A missing level has no code.
    """
    levels = level_codes(df, cols)
    counts = {r["__column"]: r["count"] for r in levels.groupBy("__column").count().collect()}
    few, total = [], 0
    for c in sorted(cols, key=lambda c: counts.get(c, 0)):
        total += counts.get(c, 0)
        if total <= BROADCAST_LEVELS:
            few.append(c)
    coded = df
    many = [c for c in cols if c not in few]
    if many:
        coded = materialise(coded.withColumn("__row", F.monotonically_increasing_id()), "rows-to-code")
        named = [F.struct(F.lit(c).alias("__column"), F.col(c).cast("string").alias("__level")) for c in many]
        long = coded.select("__row", F.inline(F.array(*named))).where(F.col("__level").isNotNull())
        wide = long.join(levels, ["__column", "__level"]).groupBy("__row")
        codes = [F.max(F.when(F.col("__column") == c, F.col("__code"))).alias(f"{c}_enc") for c in many]
        coded = coded.join(wide.agg(*codes), "__row", "left").drop("__row")
    dictionary = levels.where(F.col("__column").isin(few))
    for c in few:
        own = dictionary.select(
            F.col("__column").alias("__c"), F.col("__level").alias("__l"), F.col("__code").alias(f"{c}_enc")
        )
        same = (F.lit(c) == F.col("__c")) & (F.col(c).cast("string") == F.col("__l"))
        coded = coded.join(F.broadcast(own), same, "left").drop("__c", "__l")
    return coded.select(*df.columns, *[f"{c}_enc" for c in cols])


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Add the feature vector; missing numbers count as 0."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(fill_zero(df, cols))


def balanced_weights(df: DataFrame, label: str = "contacted", name: str = "weight") -> DataFrame:
    """Add weights that give both classes the same total: n / (2 n_class)."""
    sizes = df.agg(
        F.struct(
            F.count(label).cast("double").alias("n"),
            F.count_if(F.col(label) == 1).cast("double").alias("ones"),
        )
    ).scalar()
    ones = F.col("__sizes.ones")
    own = F.when(F.col(label) == 1, ones).otherwise(F.col("__sizes.n") - ones)
    return (
        df.withColumn("__sizes", sizes)
        .withColumn(name, F.try_divide(F.col("__sizes.n"), F.lit(2.0) * own))
        .drop("__sizes")
    )


def standardise(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Add each column with zero mean and unit population variance; constants become 0."""
    moments = df.agg(
        F.struct(
            *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
        )
    ).scalar()
    def scaled(c: str) -> Column:
        centred = F.col(c).cast("double") - F.col(f"__m.m_{c}")
        spread = F.col(f"__m.s_{c}")
        return F.when(spread > 0, centred / spread).otherwise(centred).alias(f"{c}{suffix}")

    return df.withColumn("__m", moments).select(*df.columns, *[scaled(c) for c in cols])


def cluster_features(orders: DataFrame, key: str = "order_id") -> tuple[DataFrame, list[str]]:
    """Orders with encoded and scaled clustering features, and the names of the scaled columns."""
    prepared = fill_unknown(
        orders.withColumn("order_amt_log", log_amount(F.col("order_amount"))), CLUSTER_CATEGORICAL
    )
    coded = label_encode(prepared, CLUSTER_CATEGORICAL)
    cols = ["order_amt_log", *[f"{c}_enc" for c in CLUSTER_CATEGORICAL], *CLUSTER_NUMERIC]
    filled = coded.select("*", *[F.coalesce(F.col(c), F.lit(0)).alias(f"f_{c}") for c in cols])
    scaled = standardise(filled, [f"f_{c}" for c in cols])
    return scaled.drop(*[f"f_{c}" for c in cols]), [f"f_{c}_std" for c in cols]
