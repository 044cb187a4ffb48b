"""What single steps read, move and hold stays bounded."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from contactscope.operators import kmeans
from contactscope.plans import registry


def test_audit_joins_its_tables_once(spark, folder, monkeypatch):
    read, replace = [], registry.replace_periods

    def noted(df, path, column):
        read.append([f for f in df.inputFiles() if "lineitem" in f or "orders" in f])
        replace(df, path, column)

    monkeypatch.setattr(registry, "replace_periods", noted)
    assert registry.QUERIES["audit_by_period"](spark, folder).count()
    assert read == [[]] * 4


def test_kmeans_blocks_are_small(spark):
    x = F.array(F.col("id") % 7 + F.lit(0.5), F.col("id") % 3 * 1.0, F.lit(1.0))
    df = spark.range(0, 30_000, 1, 2).select("id", array_to_vector(x).alias("features"))
    blocks = kmeans.pack(df)
    sizes = blocks.agg(F.max(F.length("data")).alias("most"), F.sum("n").alias("n"), F.sum(F.length("data")).alias("all")).first()
    assert sizes.most <= kmeans.BLOCK_BYTES and sizes.n == 30_000 and sizes["all"] == 30_000 * 24
    centres = np.array([[0.5, 0, 1], [6.5, 2, 1]])
    points = np.array([r.x for r in df.select(x.alias("x")).collect()])
    far = ((points[:, None] - centres) ** 2).sum(axis=2)
    ((n, cost, sums),) = kmeans._pass(blocks, [centres])
    near = far.argmin(axis=1)
    assert n.tolist() == np.bincount(near).tolist() and np.isclose(cost.sum(), far.min(axis=1).sum())
    assert np.allclose(sums, np.eye(2)[near].T @ points)
