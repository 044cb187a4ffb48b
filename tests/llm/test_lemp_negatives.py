"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactscope.llm import lemp_negatives as lemp

SCHEMA = "vec_id long, embedding array<float>, label int, score string, target int"


def plain(rows, k=5):
    kept = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in e])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (label, q) in kept.items():
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), i, own) for i, (own, p) in kept.items() if len(p) == len(q) and i != a]
        scored.sort()
        for s, positive, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, positive, r, i, -s, -n) for r, (n, i, _) in enumerate(fit, 1)]
    return sorted(out)


def check(spark, rows, parts=3):
    made = spark.createDataFrame([(i, e, label, "x", 1) for i, e, label in rows], SCHEMA).repartition(parts)
    got = lemp.hard_negatives(made, F.col("vec_id") % 10 == 0)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    want = plain(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def cloud(n, size=6, seed=1, labels=4):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = draw.randrange(labels)
        stretch = draw.choice([0.2, 1, 1, 1, 3])
        rows.append((i, [stretch * (c + draw.gauss(0, 0.4)) for c in centres[label]], draw.choice([label, label, (label + 1) % labels])))
    return rows


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lemp, "BUCKET_ROWS", 32)
    assert len(check(spark, cloud(700))) > 500


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(lemp, "BUCKET_ROWS", 16)
    monkeypatch.setattr(lemp, "ANCHOR_BYTES", 400)
    check(spark, cloud(150, 3, 4))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lemp, "BUCKET_ROWS", 16)
    rows = cloud(80, 3, 2)
    rows += [(i, [0.5, 0.25, -0.1], i % 3) for i in range(100, 160)]  # ties
    rows += [(200, None, 1), (201, [1.0, None, 0.0], 1), (202, [float("nan"), 0.0, 1.0], 1), (210, [float("inf"), 0.0, 1.0], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (220, [1.0, 1.0, 1.0], None), (230, [0.0, 0.0, 0.0], 1), (231, [0.0, 0.0, 0.0], 2)]
    rows += [(240, [], 1), (241, [], 1), (242, [], 2), (250, [1.0], 1), (251, [2.0], 1), (252, [1.9], 2), (253, [-2.0], 1)]
    rows += [(10, [9.0, 9.0, 9.0], 0), (10, [9.0, 9.0, 9.0], 0), (20, [0.1, 0.1, 0.1], 3)]  # repeated ids
    rows += [(-10, [0.3, 0.2, 0.1], 1)]
    check(spark, rows)


def test_long_vectors_are_exact(spark):
    rows = [(i, [3e6 + 0.5 * i, -2e5, 7.0 + i], i % 2) for i in range(0, 40)]
    assert check(spark, rows)


def test_beyond_64_bits(spark):
    rows = [(i, [1e30, 1.0], i % 2) for i in range(0, 20)]
    made = spark.createDataFrame([(i, e, label, "x", 1) for i, e, label in rows], SCHEMA)
    got = sorted(lemp.hard_negatives(made, F.col("vec_id") % 10 == 0).collect())
    assert {r.positive_score for r in got} == {r.negative_score for r in got} == {lemp.MOST}
    assert [r.negative_id for r in got[:5]] == [1, 3, 5, 7, 9]


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]])
def test_few_rows(spark, rows):
    assert check(spark, rows, 1) == []


def test_pruning_leaves_few_candidates():
    """With a high cosine asked for, only rows near the anchor are left, and none that qualifies is lost."""
    rng = np.random.default_rng(1)
    units = rng.normal(size=(2000, 16))
    units /= np.sqrt((units**2).sum(axis=1))[:, None]
    lists = np.argsort(units, axis=0).T.astype(np.int16)
    for i in range(50):
        anchor = units[i] + rng.normal(size=16) * 0.02
        anchor /= np.sqrt((anchor**2).sum())
        found = lemp._candidates(anchor, units, lists, 0.97)
        assert set(np.flatnonzero(units @ anchor >= 0.97)) <= set(found) and len(found) < 200
