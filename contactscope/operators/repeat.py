"""Repeat contacts by the category of the first contact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactscope.operators.link import KEY, first_by
from contactscope.operators.mix import head_tail


def repeat_per_order(contacts: DataFrame) -> DataFrame:
    """Per contacted key: contacts, repeat flag and first category, from one grouping."""
    return (
        contacts.groupBy(KEY)
        .agg(
            F.count(KEY).alias("n_contacts"),
            first_by("errand_category").alias("first_category"),
        )
        .where("n_contacts > 0")
        .withColumn("is_repeat", (F.col("n_contacts") > 1).cast("int"))
    )


def repeat_by_first(per_order: DataFrame, min_volume: int = 500) -> DataFrame:
    """Repeat rate and volume per first category with more than ``min_volume`` orders."""
    return (
        per_order.where(F.col("first_category").isNotNull())
        .groupBy("first_category")
        .agg(F.avg("is_repeat").alias("repeat_rate"), F.count("is_repeat").alias("volume"))
        .where(F.col("volume") > min_volume)
    )


def overall_repeat(per_order: DataFrame) -> DataFrame:
    """Contacted keys and the share of them with more than one contact."""
    return per_order.agg(
        F.count(F.lit(1)).alias("contacted_keys"), F.avg("is_repeat").alias("repeat_share")
    )


def extreme_categories(
    per_order: DataFrame, best: int = 8, worst: int = 4, min_volume: int = 500
) -> DataFrame:
    """Per-order rows whose first category is among the best or worst repeat rates."""
    ranking = repeat_by_first(per_order, min_volume)
    chosen = head_tail(ranking, best, worst, "repeat_rate", "first_category")
    # At most best + worst names.
    return per_order.join(
        F.broadcast(chosen.select("first_category")), "first_category", "left_semi"
    )
