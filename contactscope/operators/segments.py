"""Order segments: k-means with restarts, silhouette, profiles, names."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactscope.functions.numeric import clip, log_amount
from contactscope.operators.features import CLUSTER_CATEGORICAL, assemble, cluster_features
from contactscope.operators.kmeans import Fit, assign, fit_all
from contactscope.operators.rates import winsor_mean
from contactscope.operators.sampling import sample_n, sample_per_group, spread_sample
from contactscope.operators.silhouette import euclidean_silhouette
from contactscope.sources.tables import materialise

# Numbers of clusters and restarts, plot sample, profile columns.
SEED = 42
SCAN_KS = (2, 3, 4, 5, 6)
SCAN_RESTARTS = 5
FINAL_K = 4
FINAL_RESTARTS = 10
POINTS_PER_CLUSTER = 2_000

PROFILE_RATES = ["contact_rate", "cancel_rate", "change_rate", "pct_family", "pct_roundtrip"]
BLOCK_ROWS = 1_250  # ``pairwise_silhouette`` compares its sample in tiles of this many rows squared

KEPT = [
    "order_id", "order_amount", "order_amt_log", "contacted", "n_contacts",
    "is_canceled", "is_changed", "customer_group_type", "journey_type_id",
]

SEGMENT_COLUMNS = [
    "order_id", "order_amount", "contacted", "n_contacts", "is_canceled", "is_changed",
    *CLUSTER_CATEGORICAL,
]


def segment_table(orders: DataFrame, rows: int | None = None, seed: int = SEED) -> DataFrame:
    """Orders with the scaled feature vector, stored for the many passes of k-means.

    All orders, unless a sample of ``rows`` is asked for.
    """
    base = orders
    if rows is not None:
        base = spread_sample(orders, rows, seed, ["order_id"])
    stored = materialise(base.select(SEGMENT_COLUMNS), "segment-orders")
    scaled, cols = cluster_features(stored)
    return materialise(assemble(scaled, cols).select(*KEPT, "features"), "segments")


def kmeans_all(df: DataFrame, ks: Sequence[int], restarts: int, seed: int = SEED) -> dict[int, Fit]:
    """For every k the best of several runs by total squared distance; all runs share their scans."""
    return fit_all(df, ks, restarts, seed)


def kmeans(df: DataFrame, k: int, restarts: int, seed: int = SEED) -> Fit:
    """The best of several runs by total squared distance; ties go to the earlier run."""
    return kmeans_all(df, [k], restarts, seed)[k]


def squared_silhouette(df: DataFrame, cluster: str = "cluster") -> float:
    """Silhouette with squared distances over all rows, in one pass per cluster centre."""
    return ClusteringEvaluator(
        predictionCol=cluster, featuresCol="features", metricName="silhouette"
    ).evaluate(df)


def _tile_sums(labels: Sequence[str]):
    """Sum of distances from the rows of one block to each cluster of another block."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        here, there = tile[tile["source"]], tile[~tile["source"]]
        if here.empty or there.empty:
            return pd.DataFrame(
                {"id": [], "labelling": [], "own": [], "other": [], "total": [], "n": []}
            )
        a = np.stack(here["x"].to_numpy())
        b = np.stack(there["x"].to_numpy())
        squared = np.zeros((len(a), len(b)))
        for left, right in zip(a.T, b.T):  # one feature at a time keeps the tile small
            squared += (left[:, None] - right[None, :]) ** 2
        distance = np.sqrt(squared)
        parts = []
        for name in labels:
            for level in np.unique(there[name]):
                members = (there[name] == level).to_numpy()
                parts.append(
                    pd.DataFrame(
                        {
                            "id": here["id"],
                            "labelling": name,
                            "own": here[name],
                            "other": level,
                            "total": distance[:, members].sum(axis=1),
                            "n": int(members.sum()),
                        }
                    )
                )
        return pd.concat(parts, ignore_index=True)

    return run


def pairwise_silhouette(
    df: DataFrame,
    labels: Sequence[str],
    rows: int,
    seed: int = SEED,
    key: str = "order_id",
) -> DataFrame:
    """Mean silhouette with Euclidean distances over a sample, for each column of cluster numbers.

    The measure needs the distance of every sampled row to every other one. The sample
    of ``rows`` rows is cut into blocks by row hash; each pair of blocks is one task
    that returns distance sums per row and cluster, never the pairs. All labellings
    share the distances. Rows alone in their cluster count as 0.
    """
    sample = sample_n(df.select(key, "features", *labels), rows, seed, [key]).select(
        F.col(key).alias("id"), vector_to_array("features").alias("x"), *labels
    )
    blocks = -(-rows // BLOCK_ROWS)
    sample = sample.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    points = ["id", "x", *labels]
    here = sample.select(*points, F.lit(True).alias("source"), F.col("block").alias("i"), every.alias("j"))
    there = sample.select(*points, F.lit(False).alias("source"), every.alias("i"), F.col("block").alias("j"))
    sums = here.unionByName(there).groupBy("i", "j").applyInPandas(
        _tile_sums(labels),
        "id long, labelling string, own int, other int, total double, n long",
    )
    per_cluster = sums.groupBy("labelling", "id", "own", "other").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    own, other = F.col("own"), F.col("other")
    per_row = per_cluster.groupBy("labelling", "id").agg(
        F.max(F.when(own == other, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.min(F.when(own != other, F.try_divide("total", "n"))).alias("b"),
    )
    width = F.coalesce(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)
    )
    return per_row.groupBy("labelling").agg(
        F.avg(width).alias("silhouette"), F.count(F.lit(1)).alias("n")
    )


def silhouette_scan(
    df: DataFrame,
    ks: Sequence[int] = SCAN_KS,
    restarts: int = SCAN_RESTARTS,
    metric: str = "squared euclidean",
    tolerance: float = 5e-3,
) -> DataFrame:
    """(k, metric, silhouette, n, is_best) for each number of clusters; ties go to the smaller k.

    The measure is taken over all rows. With squared distances one pass per labelling is enough; with
    ``euclidean`` ones it is bounded by cells and known to ``tolerance``.
    """
    if metric not in ("squared euclidean", "euclidean"):
        raise ValueError(f"unknown metric: {metric}")
    n, scores = df.count(), []
    for k, model in kmeans_all(df, ks, restarts).items():
        clustered = assign(model, df)
        if metric == "euclidean":
            value = euclidean_silhouette(clustered, tolerance=tolerance).first().silhouette
        else:
            value = squared_silhouette(clustered)
        scores.append((k, metric, value, n))
    rows = df.sparkSession.createDataFrame(scores, "k int, metric string, silhouette double, n long")
    best = F.row_number().over(Window.orderBy(F.desc("silhouette"), "k"))  # one row per k
    return rows.withColumn("is_best", (best == 1).cast("int"))


def cluster_profile(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, winsorised mean amount and rates per cluster."""
    rates = (
        df.where(F.col(cluster).isNotNull())
        .groupBy(cluster)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("contacted").alias("contact_rate"),
            F.avg("n_contacts").alias("avg_contacts"),
            F.avg("is_canceled").alias("cancel_rate"),
            F.avg("is_changed").alias("change_rate"),
            _level_share("customer_group_type", "FAMILY").alias("pct_family"),
            _level_share("journey_type_id", "Round-trip").alias("pct_roundtrip"),
        )
    )
    amounts = winsor_mean(df, cluster, "order_amount").select(
        cluster, F.col("winsor_mean").alias("avg_order_amt")
    )
    return rates.join(amounts, cluster, "left")


def _level_share(col: str, level: str):
    """Aggregate: share of one level among all rows; NULL is another level."""
    return F.avg(F.coalesce(F.col(col) == level, F.lit(False)).cast("int"))


def name_segments(profile: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Name each cluster by its profile, since cluster numbers mean nothing.

    The cluster with the highest cancel rate is ``cancelled``; of the others the one
    with the highest change rate is ``changed``; of the rest the one with the highest
    round-trip share is ``round trip``; what remains is ``one way``. The windows run
    over one row per cluster.
    """
    named = profile.withColumn("segment", F.lit(None).cast("string"))
    for column, name in [
        ("cancel_rate", "cancelled"),
        ("change_rate", "changed"),
        ("pct_roundtrip", "round trip"),
    ]:
        open_first = Window.orderBy(F.col("segment").isNotNull(), F.desc(column), cluster)
        named = named.withColumn("__at", F.row_number().over(open_first)).withColumn(
            "segment",
            F.when(F.col("segment").isNull() & (F.col("__at") == 1), name).otherwise(F.col("segment")),
        )
    return named.drop("__at").withColumn("segment", F.coalesce("segment", F.lit("one way")))


def segment_points(
    df: DataFrame, cluster: str = "cluster", n: int = POINTS_PER_CLUSTER, seed: int = SEED
) -> DataFrame:
    """Scatter data: log amount and contacts (0 to 10) of at most n orders per cluster."""
    if "order_amt_log" not in df.columns:
        df = df.withColumn("order_amt_log", log_amount(F.col("order_amount")))
    points = df.select(
        "order_id",
        cluster,
        "order_amt_log",
        clip(F.col("n_contacts"), F.lit(0), F.lit(10)).cast("bigint").alias("contacts"),
    )
    return sample_per_group(points, cluster, n, seed, ["order_id"])


def profile_long(profile: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Segment comparison in long form: (cluster, metric, value)."""
    return profile.select(cluster, *PROFILE_RATES).unpivot(
        [cluster], PROFILE_RATES, "metric", "value"
    )
