"""Sources, sinks, models and the whole job on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from contactscope.operators import models, segments
from contactscope.plans import job, registry, reports
from contactscope.plans.linked import prepare
from contactscope.sources import schemas, star
from contactscope.sources.tables import materialise, read_table, write_result


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "order_id,Order_Created_At,Order_Amount,Brand,Is_Canceled,unknown\n"
        "4600000001,2024-01-02 03:04:05,-1.5,A,1.0,x\n"
        "4600000002,soon,NaN,NA,,y\n"
        "oops,,abc,null,0,z\n"
    )
    df = read_table(spark, str(path), schemas.ORDERS, "csv")
    assert df.columns == ["order_id", "order_created_at", "order_amount", "brand", "is_canceled"]
    rows = df.collect()
    assert rows[0].order_id == 4600000001 and rows[0].order_amount == -1.5 and rows[0].is_canceled == 1
    assert rows[1][1:] == (None, None, None, None)
    assert rows[2][:4] == (None, None, None, None) and rows[2].is_canceled == 0
    with pytest.raises(Exception, match="not a timestamp"):
        read_table(spark, str(path), schemas.ORDERS, "csv", strict_time=True).collect()


def test_parquet_reads_nan_as_null(spark, tmp_path):
    target = write_result(
        spark.createDataFrame([(1, float("nan"), "a"), (2, 2.0, None)], "ORDER_ID long, Revenue double, Brand string"),
        "orders", str(tmp_path),
    )
    rows = read_table(spark, target, schemas.ORDERS).orderBy("order_id").collect()
    assert [(r.order_id, r.revenue, r.brand) for r in rows] == [(1, None, "a"), (2, 2.0, None)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, folder, tmp_path, fmt):
    df = star.bookings(spark, folder)
    back = read_table(spark, write_result(df, "b", str(tmp_path), fmt), schemas.ORDERS, fmt)
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == df.count()
    with pytest.raises(ValueError):
        write_result(df, "b", str(tmp_path), "xlsx")


def test_materialised_table_reads_only_what_is_needed(spark, folder):
    table = materialise(star.bookings(spark, folder), "bookings")
    plan = table.where("order_id > 5").select("brand")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(order_id), GreaterThan(order_id,5)]" in plan
    assert "ReadSchema: struct<order_id:bigint,brand:string>" in plan


def test_models(spark, folder):
    table = models.training_table(registry.L(spark, folder))
    sizes = {r.is_test: r["count"] for r in table.groupBy("is_test").count().collect()}
    assert sizes == {0: 1200, 1: 300}
    train = table.where("is_test = 0")
    weights = train.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in weights] == pytest.approx([600.0, 600.0])
    logistic = models.fit_logistic(train)
    again = models.fit_logistic(train)
    assert list(logistic.coefficients) == pytest.approx(list(again.coefficients))
    forest = models.fit_forest(train, trees=10)
    scored = models.score(forest, table.where("is_test = 1")).collect()
    assert len(scored) == 300 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored}) > 20
    shares = models.importances(forest, table).collect()
    assert len(shares) == len(models.FEATURES)
    assert sum(r.importance for r in shares) == pytest.approx(1.0)
    assert models.top_importances(forest, table).count() == 10


def test_separable_labels_are_learnt(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(2000).selectExpr(
        "id as order_id", "cast(id % 2 as double) as label", "cast(id % 2 * 10 + id % 7 as double) as x", "1.0D as weight"
    )
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    for model in (models.fit_logistic(df), models.fit_forest(df, trees=5)):
        row = models.compare_models({"m": models.score(model, df)}).collect()[0]
        assert (row.roc_auc, row.average_precision) == (1.0, 1.0)


def test_segments(spark, folder):
    table = segments.segment_table(registry.L(spark, folder))
    best = segments.kmeans(table, 3, restarts=3)
    single = segments.kmeans(table, 3, restarts=1)
    assert best.summary.trainingCost <= single.summary.trainingCost + 1e-9
    clustered = segments.assign(best, table)
    named = segments.name_segments(segments.cluster_profile(clustered)).collect()
    assert {r.segment for r in named} == {"cancelled", "changed", "round trip"}
    assert sum(r.n for r in named) == 1500
    scan = segments.silhouette_scan(table, ks=(2, 3), restarts=1).collect()
    assert {r.k for r in scan} == {2, 3} and sum(r.is_best for r in scan) == 1
    assert all(-1 <= r.silhouette <= 1 and r.n == 1500 for r in scan)
    assert -1 <= segments.squared_silhouette(clustered) <= 1


def test_job(spark, folder, tmp_path):
    orders = write_result(star.bookings(spark, folder), "orders", str(tmp_path), "csv")
    contacts = write_result(star.contacts(spark, folder), "contacts", str(tmp_path), "csv")
    parts = ["descriptive", "statistics", "executive"]
    written = job.run(spark, orders, contacts, str(tmp_path / "out"), "csv", parts=parts)
    assert len(written) == len(set(written)) == 22 + 11 + 5
    tables = {p.rsplit("/", 1)[1]: spark.read.parquet(p) for p in written}
    base = tables["baseline"].collect()[0]
    assert (base.orders, base.contacted_orders) == (1500, 797)
    assert base.repeat_share == pytest.approx(0.461731, abs=1e-6)
    assert tables["propensity"].count() == 5


def test_model_reports(spark, folder):
    data = prepare(star.bookings(spark, folder), star.contacts(spark, folder), store=True)
    prediction = reports.modelling(data, in_window_only=True)
    compared = prediction["model_compare"].collect()
    assert {r.model for r in compared} == {"Logistic Regression", "Random Forest"}
    assert all(r.positives + r.negatives == 300 and 0.3 < r.roc_auc < 1 for r in compared)
    curves = prediction["roc_curves"].groupBy("model").agg(F.max("fpr").alias("x"), F.max("tpr").alias("y"))
    assert {(r.x, r.y) for r in curves.collect()} == {(1.0, 1.0)}
    assert prediction["pr_curves"].where("threshold is null").count() == 2
    tables = reports.segmentation(data)
    assert tables["silhouettes"].count() == 5
    assert tables["segments"].count() == 4 and tables["segment_rates"].count() == 20
    assert tables["segment_points"].count() == 1500


def test_strict_job_stops_on_bad_keys(spark, folder):
    data = prepare(star.bookings(spark, folder), star.contacts(spark, folder), strict=True)
    with pytest.raises(Exception, match="not a base-36 key"):
        data.contacts.collect()
