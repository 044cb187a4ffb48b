"""The ROC curve without points on straight stretches."""

import random

import numpy as np

from contactscope.operators import metrics


def area(points):
    x, y = zip(*sorted(points))
    return float(np.trapezoid(y, x))


def test_same_curve_with_fewer_points(spark):
    draw = random.Random(6)
    rows = [(draw.choice([0.0, -1.5, 2.0**draw.randrange(-30, 30) * draw.random(), draw.randrange(9) / 8]), int(draw.random() < 0.3)) for _ in range(800)]
    rows += [(1e6 + i, 1) for i in range(50)] + [(-1e6 - i, 0) for i in range(70)] + [(None, 1)]
    scored = spark.createDataFrame(rows, "score double, label int")
    whole = [(r.fpr, r.tpr) for r in metrics.roc_curve(scored).collect()]
    kept = metrics.roc_curve(scored, drop_straight=True).collect()
    # By plain second differences of the counts at all thresholds.
    known = [r for r in rows if r[0] is not None]
    cuts = sorted({s for s, _ in known}, reverse=True)
    tp = np.array([sum(label for s, label in known if s >= c) for c in cuts])
    fp = np.array([sum(1 - label for s, label in known if s >= c) for c in cuts])
    turns = np.concatenate([[True], (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0), [True]])
    assert {r.threshold for r in kept} == {None, *np.array(cuts)[turns]}
    assert len(kept) < len(whole) - 100
    assert abs(area([(r.fpr, r.tpr) for r in kept]) - area(whole)) < 1e-12


def test_few_thresholds(spark):
    for rows, n in (([], 1), ([(0.5, 1)], 2), ([(0.5, 1), (0.25, 0)], 3), ([(0.5, 1), (0.25, 1), (0.1, 1)], 3)):
        scored = spark.createDataFrame(rows, "score double, label int")
        assert metrics.roc_curve(scored, drop_straight=True).count() == n
