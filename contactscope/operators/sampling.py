"""Exact-size samples that do not depend on partitioning, run or engine.

Rows are ranked by a seeded hash of their key and the lowest ranks are taken. The rank at which to
stop is found from counts, not by sorting: hash values are counted in buckets (1,024 per power of
two, at most 61,440 a group), and only the rows of the bucket in which a group's sample ends are
ordered. The stops, a row a group, join the rows on the group. All other rows are taken or left by
their bucket, without being moved.

Keys may repeat: copies are ranked by a hash of the whole row, so a sample has its exact size; which
of wholly equal rows is taken cannot be told.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.functions.keys import row_hash
from contactscope.sources.tables import materialise

BUCKETS = 1024  # per power of two
SMALL_GROUPS = 1_000_000  # stops of up to so many groups are sent to the rows; else both are shuffled


def mark_lowest(
    df: DataFrame,
    quota: Callable[[Column], Column],
    seed: int,
    key: Sequence[str],
    group: str | None = None,
    name: str = "selected",
) -> DataFrame:
    """Flag the rows with the lowest hashes, ``quota(rows in group)`` per group; NULL is in no group.

    The stops are counted and stored while this is called.
    """
    g = F.lit(0) if group is None else F.col(group)
    ranked = df.withColumns({"__g": g, "__u": row_hash(seed, *key)})
    bucket = F.floor(F.log2(F.col("__u") + 1) * BUCKETS)
    ranked = ranked.withColumn("__bucket", bucket)
    upto = (
        Window.partitionBy("__g")
        .orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = (
        ranked.where(F.col("__g").isNotNull())
        .groupBy("__g", "__bucket")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumns(
            {
                "__end": F.sum("__c").over(upto),
                "__total": F.sum("__c").over(Window.partitionBy("__g")),
            }
        )
        .withColumn("__quota", F.least(quota(F.col("__total")).cast("bigint"), F.col("__total")))
    )
    holds = (F.col("__end") - F.col("__c") < F.col("__quota")) & (F.col("__quota") <= F.col("__end"))
    stops = counts.where(holds).select(
        F.col("__g").alias("__sg"),
        F.col("__bucket").alias("__stop"),
        (F.col("__quota") - F.col("__end") + F.col("__c")).alias("__need"),
    )
    stops = materialise(stops, "sample-stops")
    if stops.count() <= SMALL_GROUPS:
        stops = F.broadcast(stops)
    met = ranked.join(stops, F.col("__g") == F.col("__sg"), "left")
    sure = F.coalesce(F.col("__bucket") < F.col("__stop"), F.lit(False))
    edge = F.coalesce(F.col("__bucket") == F.col("__stop"), F.lit(False))
    names = df.columns
    order = Window.partitionBy("__g").orderBy("__u", *key, F.xxhash64(*names))
    last = met.where(edge).withColumn("__at", F.row_number().over(order))
    return (
        met.where(~edge)
        .select(*names, sure.alias(name))
        .unionByName(last.select(*names, (F.col("__at") <= F.col("__need")).alias(name)))
    )


def _taken(marked: DataFrame) -> DataFrame:
    return marked.where("__in").drop("__in")


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """n rows without replacement; all rows when there are fewer."""
    return _taken(mark_lowest(df, lambda total: F.lit(n), seed, key, name="__in"))


def sample_per_group(
    df: DataFrame, group: str, n: int, seed: int, key: Sequence[str]
) -> DataFrame:
    """At most n rows of each group; any number of groups."""
    return _taken(mark_lowest(df, lambda total: F.lit(n), seed, key, group, "__in"))


def stratified_split(
    df: DataFrame, label: str, test_share: float, seed: int, key: Sequence[str]
) -> DataFrame:
    """Add ``is_test``: exactly round(share x rows) of each class are 1.

    The input, mostly a join, is written once and read from there.
    """
    rows = materialise(df, "split")
    marked = mark_lowest(
        rows, lambda total: F.round(total.cast("double") * F.lit(test_share)), seed, key, label, "__in"
    )
    return marked.withColumn("is_test", F.col("__in").cast("int")).drop("__in")


def spread_sample(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """``sample_n`` dealt out evenly, so that every core works on what follows.

    For samples that are small next to the table. Dealing by a hash of the key rather
    than by the key keeps Spark from reusing the partitions of a join on it, which
    adaptive execution may have merged into very few.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return sample_n(df, n, seed, key).repartition(cores, F.xxhash64(*key))
