"""Level codes by ranges, and codes from a join, against sorted sets."""

import random

import pytest

from contactscope.operators import features


@pytest.mark.parametrize("most, each", [(1_000_000, 1_000_000), (0, 7), (12, 5)])
def test_codes_of_many_levels(spark, monkeypatch, most, each):
    monkeypatch.setattr(features, "BROADCAST_LEVELS", most)
    monkeypatch.setattr(features, "LEVELS_PER_TASK", each)
    draw = random.Random(1)
    rows = [
        (i, draw.choice(["x", "y", None]), draw.choice(["hot", f"level {draw.randrange(40)}"]), None, draw.randrange(-3, 3))
        for i in range(300)
    ]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "id int, few string, `many` string, none string, number int")
    cols = ["few", "many", "none", "number"]
    got = features.label_encode(df, cols)
    assert got.columns == [*df.columns, "few_enc", "many_enc", "none_enc", "number_enc"]
    codes = []
    for at in range(1, 5):
        levels = sorted({str(r[at]) for r in rows if r[at] is not None})
        codes.append({level: i for i, level in enumerate(levels)})
    want = [(*r, *[codes[at - 1].get(str(r[at])) if r[at] is not None else None for at in range(1, 5)]) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_large_task(spark, monkeypatch):
    """A column with more levels than a task should sort is dealt to ranges of like length."""
    monkeypatch.setattr(features, "LEVELS_PER_TASK", 20_000)
    df = spark.range(200_000).selectExpr("cast(id * 7919 % 200000 as string) as a", "'one' as b")
    codes = features.level_codes(df, ["a", "b"])
    sizes = [r["count"] for r in codes.groupBy("__column").count().collect()]
    assert sorted(sizes) == [1, 200_000]
    ends = codes.where("__column = 'a'").selectExpr("min(__code)", "max(__code)", "count(distinct __code)").first()
    assert tuple(ends) == (0, 199_999, 200_000)
    ordered = [r["__level"] for r in codes.where("__column = 'a'").orderBy("__code").limit(5).collect()]
    assert ordered == ["0", "1", "10", "100", "1000"]
