"""Silhouettes bounded by cells against all pair distances."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from contactscope.operators import silhouette


def plain(points, labels):
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    labels, total = np.array(labels), 0.0
    for i in range(len(points)):
        own = labels == labels[i]
        if own.sum() > 1:
            a = distance[i, own].sum() / (own.sum() - 1)
            b = min(distance[i, labels == k].mean() for k in set(labels) - {labels[i]})
            total += (b - a) / max(a, b) if max(a, b) else 0
    return total / len(points)


def table(spark, points, labels):
    rows = [(i, str(k) if k is not None else None, *map(float, p)) for i, (p, k) in enumerate(zip(points, labels))]
    names = [f"v{j}" for j in range(len(points[0]))]
    df = spark.createDataFrame(rows, "order_id long, cluster string, " + ", ".join(f"{n} double" for n in names))
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


@pytest.mark.parametrize("most, tolerance", [(8192, 1e-4), (60, 2e-3), (40, 1e-4)])
def test_bounds_hold(spark, monkeypatch, most, tolerance):
    monkeypatch.setattr(silhouette, "MOST_CELLS", most)
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(150, 2)) + c for c in ([0, 0], [4, 0], [1, 5])] + [[[90.0, 90.0]]])
    points = np.concatenate([points, points[:40]])  # repeated points
    labels = [*[0] * 150, *[1] * 150, *[2] * 150, 9, *[0] * 40]
    row = silhouette.euclidean_silhouette(table(spark, points, labels), tolerance=tolerance).first()
    want = plain(points, labels)
    assert row.low - 1e-9 <= want <= row.high + 1e-9 and row.high - row.low <= 2 * tolerance
    assert row.silhouette == pytest.approx(want, abs=tolerance) and row.n == len(points)


def test_edges(spark):
    points = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [5.0, 5.0]])
    one = silhouette.euclidean_silhouette(table(spark, points, [1, 1, 1, 1, 1])).first()
    assert (one.silhouette, one.n) == (None, 5)
    two = silhouette.euclidean_silhouette(table(spark, points, [1, 1, 2, 2, None])).first()
    assert (two.silhouette, two.n) == (1.0, 4)
    same = silhouette.euclidean_silhouette(table(spark, points[:2], [1, 2])).first()
    assert (same.silhouette, same.low, same.high) == (0.0, 0.0, 0.0)


def test_open_cells_leave_in_small_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    count, rows = 600, 3000
    cells = {
        "c": np.sort(rng.integers(0, 3, count)), "cell": np.arange(count), "n": np.ones(count),
        "m": rng.normal(size=(count, 2)), "v": np.ones(count),
    }
    x = pa.array(rng.normal(size=(rows, 2)).tolist(), pa.list_(pa.float64()))
    batch = pa.record_batch([pa.array(range(rows)), pa.array([i % 3 for i in range(rows)], pa.int32()), x], ["id", "c", "x"])
    got = list(silhouette._first_pass(cells, np.bincount(cells["c"]), 0.0)([batch]))
    assert sum(b.num_rows for b in got) == rows and pa.Table.from_batches(got)["id"].to_pylist() == list(range(rows))
    assert pa.Table.from_batches(got)["x"].to_pylist() == x.to_pylist()
    assert all(len(o) == count for b in got for o in b["opened"])
    most = max(len(b["opened"].flatten()) for b in got)
    assert most <= silhouette.OPEN_CELLS + silhouette.STEP_ROWS * count  # all 1.8 million at once before
