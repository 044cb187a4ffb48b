"""The scan for bursts against all windows by hand, with and without a planted burst."""

import math
import random
from datetime import date, timedelta

import pytest

from contactscope.operators import bursts


def made(spark, days, share, burst=None, seed=1):
    draw = random.Random(seed)
    rows = []
    for d in range(days):
        day = date(2024, 1, 1) + timedelta(days=2 * d)  # every other day has no records
        for _ in range(draw.randrange(5, 30)):
            p = 0.5 if burst and burst[0] <= d <= burst[1] else share
            rows.append((f"{day} 10:00:00", int(draw.random() < p), d))
    rows += [(None, 1, -1), ("2024-01-01 00:00:00", None, 0)]
    df = spark.createDataFrame(rows, "t string, flag int, d int")
    return rows, df.selectExpr("cast(t as timestamp_ntz) as t", "flag", "d")


def plain(rows, days):
    n, c = [0] * days, [0] * days
    for t, flag, d in rows:
        if t is not None:
            n[d] += 1
            c[d] += flag == 1

    def part(c, n):
        return (c * math.log(c / n) if c else 0) + ((n - c) * math.log((n - c) / n) if c < n else 0)

    all_n, all_c, best = sum(n), sum(c), (0, None, None)
    for i in range(days):
        for j in range(i, days):
            m, h = sum(n[i : j + 1]), sum(c[i : j + 1])
            if m < all_n and h * (all_n - m) > (all_c - h) * m:
                ratio = part(h, m) + part(all_c - h, all_n - m) - part(all_c, all_n)
                if ratio > best[0] + 1e-9:
                    best = (ratio, i, j)
    return best


def test_planted_burst_is_found(spark):
    rows, df = made(spark, 60, 0.07, (20, 26))
    row = bursts.burst(df, "flag", "t", draws=199).first()
    ratio, i, j = plain(rows, 60)
    assert row.ratio == pytest.approx(ratio) and row.p_value == 1 / 200
    day = lambda k: date(2024, 1, 1) + timedelta(days=2 * k)
    assert (row.first_period, row.last_period) == (day(i), day(j)) and abs(i - 20) <= 1 and abs(j - 26) <= 1


def test_no_burst_no_small_p(spark):
    ps = []
    for seed in (2, 3, 4):
        rows, df = made(spark, 25, 0.1, seed=seed)
        row = bursts.burst(df, "flag", "t", draws=99).first()
        assert row.ratio == pytest.approx(plain(rows, 25)[0])
        ps.append(row.p_value)
        assert row == bursts.burst(df, "flag", "t", draws=99).first()
    assert max(ps) > 0.1


@pytest.mark.parametrize("flags", [[], [0, 0], [1, 1], [None]])
def test_nothing_stands_out(spark, flags):
    df = spark.createDataFrame([(f"2024-01-0{i + 1} 00:00:00", f) for i, f in enumerate(flags)], "t string, flag int")
    df = df.selectExpr("cast(t as timestamp_ntz) as t", "flag")
    assert bursts.burst(df, "flag", "t", draws=9).count() == 0
