"""States that add up: quantile sketches by period, audits by period, results that are published whole."""

import random

import pytest
from pyspark.sql import functions as F

from contactscope.operators import audit_state, quality, sketches
from contactscope.sources.tables import manifest, publish, read_published, replace_periods, write_result


@pytest.fixture
def events(spark):
    draw = random.Random(4)
    rows = [
        (draw.randrange(3000), draw.choice(["a", "b", None]), f"2024-0{draw.randrange(1, 6)}-{draw.randrange(1, 28):02d} 08:00:00", draw.gauss(0, 10) if i % 9 else None)
        for i in range(4000)
    ]
    rows += [(1, "a", None, 5.0), (1, "a", None, float("nan")), (None, None, "2024-01-01 00:00:00", 3.0)]
    df = spark.createDataFrame(rows, "id long, level string, t string, x double")
    return df.withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_sketches_merge_to_near_ranks(spark, events, tmp_path):
    path = f"file://{tmp_path}/sketches"
    early = events.where("t < '2024-03-01'")
    replace_periods(sketches.sketch_by_period(early, ["level"], "t", "x", "month"), path, "period")
    rest = events.where("t >= '2024-03-01' or t is null")
    for _ in range(2):  # a rerun replaces its own periods
        replace_periods(sketches.sketch_by_period(rest, ["level"], "t", "x", "month"), path, "period")
    kept = spark.read.parquet(path)
    valued = events.where("x is not null and not isnan(x)")
    assert kept.agg(F.sum("n")).first()[0] == valued.count()
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    for by in (["level"], []):
        found = sketches.quantiles(sketches.merged(kept, by), by, probs)
        ranks = sketches.exact_ranks(found, events, by, "x").collect()
        assert len(ranks) == len(probs) * (3 if by else 1)
        for r in ranks:
            assert r.share_below - 0.01 <= r.prob <= r.share_upto + 0.01
    assert sketches.rank_error() < 0.004


def test_audit_of_periods_is_that_of_all_rows(spark, events, tmp_path):
    rules = {"large": F.col("x") > 15}
    columns = ["id", "level", "x"]
    path = f"file://{tmp_path}/audit"
    for part in (events, events.where("t >= '2024-04-01'")):
        replace_periods(audit_state.period_state(part, "t", columns, rules, "week"), f"{path}/state", "period")
        replace_periods(audit_state.key_state(part, "t", "id", "week"), f"{path}/keys", "period")
    state, keys = spark.read.parquet(f"{path}/state"), spark.read.parquet(f"{path}/keys")
    got = {r.metric: (r.n, r.pct) for r in audit_state.audit(state, keys).collect()}
    n = events.count()
    assert got["n_rows"] == (n, 100.0)
    nulls = {r["column"]: r.nulls for r in quality.null_counts(events.select(*columns)).collect()}
    assert {c: got[f"nulls_{c}"][0] for c in nulls} == nulls
    assert got["rule_large"][0] == events.where("x > 15").count()
    assert got["repeated_keys"][0] == quality.duplicate_keys(events, "id").first().duplicates
    days = audit_state.coverage(state).first()
    assert (str(days.first_date), str(days.last_date)) == tuple(
        map(str, events.agg(F.to_date(F.min("t")), F.to_date(F.max("t"))).first())
    )


def test_no_rows(spark, events, tmp_path):
    none = events.limit(0)
    assert {r.n for r in audit_state.audit(audit_state.period_state(none, "t", ["x"], {}), audit_state.key_state(none, "t", "id")).collect()} == {0}
    assert sketches.merged(sketches.sketch_by_period(none, ["level"], "t", "x"), ["level"]).count() == 0


def broken(spark):
    """Rows of which the last ones fail, after others have been written."""
    return spark.range(0, 400, 1, 8).select(F.when(F.col("id") < 399, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("long").alias("id"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_failed_write_leaves_the_old_result(spark, tmp_path, fmt):
    path = f"file://{tmp_path}/out"
    first = spark.range(5)
    target = write_result(first, "r", path, fmt)
    publish(first, "p", path, fmt)
    for write in (write_result, publish):
        with pytest.raises(Exception, match="broken"):
            write(broken(spark), "r" if write is write_result else "p", path, fmt)
    read = spark.read.option("header", True).schema("id long").format(fmt).load(target)
    assert read.count() == 5 and read_published(spark, "p", path).count() == 5
    assert {f.name for f in (tmp_path / "out").iterdir()} == {"r", "p"}
    write_result(spark.range(7), "r", path, fmt)
    assert spark.read.option("header", True).format(fmt).load(target).count() == 7


def test_versions_are_kept_and_cleaned(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert manifest(spark, "p", path) is None
    with pytest.raises(ValueError, match="nothing published"):
        read_published(spark, "p", path)
    for n in range(1, 5):
        publish(spark.range(n), "p", path, keep=2)
        reader = read_published(spark, "p", path)
        if n == 3:
            under_way = reader
    assert reader.count() == 4 and under_way.count() == 3
    assert [v["number"] for v in manifest(spark, "p", path)["versions"]] == [3, 4]
    assert sum(f.name.startswith("v") for f in (tmp_path / "out" / "p").iterdir()) == 2
