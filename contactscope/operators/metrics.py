"""Exact ranking metrics of a score against a 0/1 label.

Rows are merged per distinct score and accumulated from the highest score down, so
ties share one threshold. Nothing is binned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactscope.functions.numeric import share
from contactscope.operators.ranking import running_totals


def thresholds(
    scored: DataFrame, label: str = "label", score: str = "score", following: bool = False
) -> DataFrame:
    """Per distinct score: hits and misses at it, and above it; with ``following`` those at the next lower one too."""
    return running_totals(
        scored.select(score, label),
        score,
        {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)},
        descending=True,
        following=following,
    )


def _sizes(scored: DataFrame, label: str, score: str):
    return (
        scored.where(F.col(score).isNotNull())
        .agg(
            F.struct(
                F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
            )
        )
        .scalar()
    )


def ranking_metrics(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: area under the ROC curve, average precision, class sizes.

    The area is the share of (positive, negative) pairs in the right order, ties
    counted half. Average precision is the step sum of precision over recall gains.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    hits = F.col("pos_before") + pos
    right = pos * (F.col("neg_before").cast("double") + neg / 2.0)
    gain = pos * F.try_divide(hits, hits + F.col("neg_before") + neg)
    row = thresholds(scored, label, score).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).cast("bigint").alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).cast("bigint").alias("negatives"),
        F.sum(right).alias("__wrong"),
        F.sum(gain).alias("__gain"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return row.select(
        (F.lit(1.0) - F.try_divide(F.col("__wrong"), pairs)).alias("roc_auc"),
        share(F.col("__gain"), F.col("positives")).alias("average_precision"),
        "positives",
        "negatives",
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(scored, label, score).select("roc_auc")


def average_precision(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(scored, label, score).select("average_precision")


def roc_curve(
    scored: DataFrame, label: str = "label", score: str = "score", drop_straight: bool = False
) -> DataFrame:
    """False and true positive rate at every threshold; the first point has none (0, 0).

    With ``drop_straight`` a point goes if the step to it equals the step from it, which changes neither
    the curve nor its area; the first and the last threshold stay. The curve then has as many points as
    it has turns, not as the table has scores.
    """
    sizes = _sizes(scored, label, score)
    steps = thresholds(scored, label, score, following=drop_straight)
    if drop_straight:
        same = (F.col("pos") == F.col("pos_next")) & (F.col("neg") == F.col("neg_next"))
        first = F.col("pos_before") + F.col("neg_before") == 0
        steps = steps.where(first | F.col("pos_next").isNull() | ~same)
    points = (
        steps
        .withColumn("s", sizes)
        .select(
            F.col(score).alias("threshold"),
            share(F.col("neg_before") + F.col("neg"), F.col("s.neg")).alias("fpr"),
            share(F.col("pos_before") + F.col("pos"), F.col("s.pos")).alias("tpr"),
        )
    )
    start = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall at every threshold, the end point (1, 0), and the base rate."""
    sizes = _sizes(scored, label, score)
    hits = F.col("pos_before") + F.col("pos")
    points = (
        thresholds(scored, label, score)
        .withColumn("s", sizes)
        .select(
            F.col(score).alias("threshold"),
            share(hits, hits + F.col("neg_before") + F.col("neg")).alias("precision"),
            share(hits, F.col("s.pos")).alias("recall"),
            share(F.col("s.pos"), F.col("s.pos") + F.col("s.neg")).alias("base_rate"),
        )
    )
    end = (
        scored.sparkSession.range(1)
        .withColumn("s", sizes)
        .select(
            F.lit(None).cast("double").alias("threshold"),
            F.lit(1.0).alias("precision"),
            F.lit(0.0).alias("recall"),
            share(F.col("s.pos"), F.col("s.pos") + F.col("s.neg")).alias("base_rate"),
        )
    )
    return points.unionByName(end)
