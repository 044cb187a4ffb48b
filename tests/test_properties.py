"""Brute force, invariants, independence of partitioning, hot keys."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactscope.functions.keys import row_hash
from contactscope.operators import curves, link, metrics, mix, ranking, rates, sampling, segments, stats


@pytest.fixture(scope="module")
def values():
    rng = random.Random(7)
    out = [rng.gauss(0, 1) * 10 ** rng.randint(-6, 6) for _ in range(1500)]
    return out + [0.0, -0.0, 1.0, 1.0, 2.0, 4.0, 1e300, -1e300, 5e-324] + [3.25] * 800


@pytest.fixture(scope="module")
def numbers(spark, values):
    rows = [(i, v, i % 3 == 0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, x double, flag boolean").repartition(7).cache()


def test_buckets_keep_the_order(numbers):
    rows = numbers.select("x", ranking.value_bucket(F.col("x")).alias("b")).collect()
    rows.sort(key=lambda r: r.x)
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:]))
    assert max(abs(r.b) for r in rows) <= 2100 * ranking.PER_OCTAVE + 1


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(numbers, values, descending):
    measures = {"n": F.count(F.lit(1)), "hits": F.count_if(F.col("flag"))}
    got = {r.x: r for r in ranking.running_totals(numbers, "x", measures, descending).collect()}
    assert len(got) == len(set(values))
    for x, row in got.items():
        before = [i for i, v in enumerate(values) if (v > x if descending else v < x)]
        assert row.n_before == len(before)
        assert row.hits_before == sum(i % 3 == 0 for i in before)
        assert row.n == sum(v == x for v in values)


def test_quantiles_as_numpy(numbers, values):
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    row = ranking.quantiles(numbers, "x", probs).collect()[0]
    for name, q in probs.items():
        assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12)
    grouped = ranking.quantiles(numbers, "x", probs, by=["flag"]).collect()
    for r in grouped:
        part = [v for i, v in enumerate(values) if (i % 3 == 0) == r.flag]
        assert r["n"] == len(part)
        assert r["d"] == pytest.approx(np.quantile(part, 0.9), rel=1e-12)


def test_survival_curve_brute_force(spark):
    rng = random.Random(3)
    times = [rng.expovariate(1 / 300) for _ in range(900)] + [0.0] * 40 + [24.0] * 400
    df = spark.createDataFrame([(t,) for t in times], "hours_ttfc double").repartition(5)
    rows = curves.survival_curve(df).orderBy("point").collect()
    ordered = np.sort(times)
    grid = np.linspace(0, ordered[int(len(ordered) * 0.99)], 500)
    assert [r.survival for r in rows] == [(ordered >= t).mean() for t in grid]
    assert [r.hours for r in rows] == pytest.approx(grid.tolist())
    survival = [r.survival for r in rows]
    assert survival[0] == 1.0 and survival == sorted(survival, reverse=True)
    steps = {r.hours: r.survival for r in curves.survival_steps(df).collect()}
    assert all(steps[t] == (ordered >= t).mean() for t in set(times))


def test_survival_curve_of_equal_times(spark):
    df = spark.createDataFrame([(0.0,)] * 4, "hours_ttfc double")
    assert {r.survival for r in curves.survival_curve(df, points=5).collect()} == {1.0}


def test_mann_whitney_brute_force(numbers, values):
    row = stats.mann_whitney(numbers, "x", "flag", True, False).collect()[0]
    x = np.array([v for i, v in enumerate(values) if i % 3 == 0])
    y = np.array([v for i, v in enumerate(values) if i % 3 != 0])
    wins = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
    assert row.statistic == wins and (row.n_x, row.n_y) == (len(x), len(y))


def test_ranking_metrics_brute_force(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(700)]
    df = spark.createDataFrame(pairs, "label int, score double").repartition(6)
    row = metrics.ranking_metrics(df).collect()[0]
    pos = np.array([s for y, s in pairs if y])
    neg = np.array([s for y, s in pairs if not y])
    auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert row.roc_auc == pytest.approx(auc, rel=1e-12)
    precision_sum, last = 0.0, 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        recall = (pos >= t).sum() / len(pos)
        precision_sum += (recall - last) * (pos >= t).sum() / ((pos >= t).sum() + (neg >= t).sum())
        last = recall
    assert row.average_precision == pytest.approx(precision_sum, rel=1e-12)
    flipped = metrics.roc_auc(df.withColumn("score", -F.col("score"))).collect()[0]
    assert flipped.roc_auc == pytest.approx(1 - auc, rel=1e-12)
    perfect = metrics.ranking_metrics(df.withColumn("score", F.col("label").cast("double"))).collect()[0]
    assert (perfect.roc_auc, perfect.average_precision) == (1.0, 1.0)
    ends = metrics.pr_curve(df).where("threshold is null").collect()[0]
    assert (ends.precision, ends.recall) == (1.0, 0.0)


def test_samples(spark):
    df = spark.range(5000).selectExpr("id", "id % 5 as g", "cast(id % 4 = 0 as int) as y")
    ranked = [r.id for r in df.orderBy(row_hash(9, "id"), "id").collect()]
    for n in (0, 1, 17, 2048, 4999, 5000, 9000):
        got = {r.id for r in sampling.sample_n(df.repartition(3), n, 9, ["id"]).collect()}
        assert got == set(ranked[:n])
    parts = {
        p: sorted(r.id for r in sampling.sample_per_group(df.repartition(p), "g", 30, 9, ["id"]).collect())
        for p in (1, 13)
    }
    assert parts[1] == parts[13] and len(parts[1]) == 150
    split = sampling.stratified_split(df, "y", 0.2, 9, ["id"]).groupBy("y").agg(F.sum("is_test").alias("t"))
    assert {r.y: r.t for r in split.collect()} == {0: 750, 1: 250}


def test_sample_of_skewed_groups(spark):
    df = spark.range(6000).selectExpr("id", "case when id < 5990 then 'hot' when id < 5999 then 'cold' end as g")
    got = sampling.sample_per_group(df, "g", 20, 1, ["id"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"hot": 20, "cold": 9}
    many = spark.range(20_100).selectExpr("id", "id % 10050 as g")
    assert sampling.sample_per_group(many, "g", 1, 1, ["id"]).groupBy("g").count().where("count = 1").count() == 10_050


def test_samples_of_repeated_keys_are_exact(spark):
    df = spark.range(100).selectExpr("id % 50 as k", "id div 50 as copy")
    for n in (1, 11, 50, 99):
        rows = sampling.sample_n(df, n, 3, ["k"]).collect()
        assert len(rows) == len(set(rows)) == n
    same = spark.range(90).selectExpr("1 as k")
    assert sampling.sample_n(same, 31, 3, ["k"]).count() == 31


@pytest.fixture(scope="module")
def hot(spark):
    """Orders and contacts where one order, and the missing key, hold a third of the contacts each."""
    orders = spark.range(400).select(
        F.col("id").alias("order_id"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias(
            "order_created_at"
        ),
    )
    contacts = spark.range(6000).select(
        F.col("id").alias("errand_id"),
        F.expr("case id % 3 when 0 then 7 when 1 then id % 500 end").alias("order_id"),
        (F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias(
            "created"
        ),
        F.concat(F.lit("c"), F.col("id") % 4).alias("errand_category"),
    )
    return orders, contacts


def plain_link(orders, contacts):
    return contacts.join(orders, "order_id", "left").select("errand_id", "order_id", "order_created_at")


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_hot_keys_change_nothing(spark, hot, threshold):
    orders, contacts = hot
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        linked = link.link_contacts(contacts, orders)
        plain = plain_link(orders, contacts)
        assert linked.count() == plain.count() == 6000
        assert linked.select(plain.columns).exceptAll(plain).count() == 0
        orphans = link.orphan_contacts(contacts, orders).select("errand_id")
        expected = plain.where("order_created_at is null").select("errand_id")
        assert orphans.exceptAll(expected).count() == expected.exceptAll(orphans).count() == 0
        counts = link.with_contact_counts(orders, contacts)
        assert counts.agg(F.sum("n_contacts")).first()[0] == plain.where("order_created_at is not null").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_links_read_contacts_once_and_split_missing_keys(spark, hot):
    orders, contacts = hot
    parts = 8
    linked = link.link_contacts(contacts.repartition(parts), orders)
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1
    spread = contacts.select(link._spread().alias("s"), "order_id")
    assert spread.where("order_id is null").select("s").distinct().count() > 1000
    assert spread.where("order_id is not null").select("s").distinct().count() == 1


def test_partition_independence(hot):
    orders, contacts = hot
    linked = link.with_contact_counts(orders, contacts)

    def report(parts):
        o, c = linked.repartition(parts), contacts.repartition(parts)
        return (
            rates.contact_baseline(o, c).collect(),
            sorted(map(str, rates.lorenz(link.contacts_per_order(c)).collect())),
            sorted(map(str, link.first_contact(c, o).collect())),
            sorted(map(str, curves.survival_curve(curves.ttfc(c, o)).collect())),
            sorted(map(str, mix.category_mix(c, "errand_category", "order_id", 5).collect())),
        )

    assert report(1) == report(13)


def test_partitions_of_the_whole(spark, hot):
    orders, contacts = hot
    flagged = link.flag_contacted(orders, contacts)
    assert flagged.where("contacted = 1").count() + link.uncontacted(orders, contacts).count() == 400
    shares = mix.category_mix(contacts.withColumn("d", F.to_date("created")), "d", "errand_category")
    for r in shares.groupBy("d").agg(F.sum("pct").alias("p")).collect():
        assert r.p == pytest.approx(100.0)


def test_silhouette_brute_force(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(11)
    points = [(i, rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1), i % 3, i % 2) for i in range(150)]
    points.append((150, 50.0, 50.0, 9, 0))  # alone in its cluster
    df = spark.createDataFrame(points, "order_id long, a double, b double, k3 int, k2 int")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    got = {r.labelling: r.silhouette for r in segments.pairwise_silhouette(df, ["k3", "k2"], 10_000).collect()}
    xy = np.array([p[1:3] for p in points])
    distance = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    for column, name in ((3, "k3"), (4, "k2")):
        labels = np.array([p[column] for p in points])
        total = 0.0
        for i in range(len(points)):
            own = labels == labels[i]
            if own.sum() == 1:
                continue
            a = distance[i, own].sum() / (own.sum() - 1)
            b = min(distance[i, labels == k].mean() for k in set(labels) - {labels[i]})
            total += (b - a) / max(a, b)
        assert got[name] == pytest.approx(total / len(points), rel=1e-9)
