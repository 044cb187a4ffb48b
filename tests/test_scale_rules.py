"""Whole tables, exact sizes and plans that hold at scale."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactscope.operators import features, mix, models, rates, segments, stats
from contactscope.plans import registry
from contactscope.sources.tables import malformed_rows, read_table, write_result

ROOT = Path(__file__).resolve().parents[1]


def test_csv_as_written_by_others(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_bytes(
        b'order_id,device,partner\n1,"A ""quoted"" brand",x\n2,"two\nlines",y\n3,short\n4,long,z,extra\n5,"a,b",\n'
    )
    schema = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("device", T.StringType()), T.StructField("partner", T.StringType())])
    rows = {r.order_id: (r.device, r.partner) for r in read_table(spark, str(path), schema, "csv").collect()}
    assert rows == {1: ('A "quoted" brand', "x"), 2: ("two\nlines", "y"), 3: ("short", None), 4: ("long", "z"), 5: ("a,b", None)}
    report = malformed_rows(spark, str(path)).collect()[0]
    assert (report.n_rows, report.malformed) == (5, 2)
    back = spark.createDataFrame([(1, 'say "hi"\nand, go', "\\")], schema)
    again = read_table(spark, write_result(back, "again", str(tmp_path), "csv"), schema, "csv")
    assert again.collect() == back.collect()


def test_chi2_counts_the_outcomes_that_occur(spark):
    rows = [("a", 0), ("a", 1), ("b", 1), ("c", 2)]
    df = spark.createDataFrame(rows, "f string, y int")
    every = stats.chi2_test(df, "f", "y").collect()[0]
    assert (every.dof, every.n) == (4, 4)
    named = stats.chi2_test(df, "f", "y", (0, 1)).collect()[0]
    assert (named.dof, named.n) == (1, 3)
    plain = spark.createDataFrame([(x, y) for x, y, n in [("a", 0, 5), ("a", 1, 3), ("b", 0, 2), ("b", 2, 9), ("c", 1, 4)] for _ in range(n)], "f string, y int")
    total, observed = 23, {("a", 0): 5, ("a", 1): 3, ("b", 0): 2, ("b", 2): 9, ("c", 1): 4}
    r, c = {"a": 8, "b": 11, "c": 4}, {0: 7, 1: 7, 2: 9}
    want = sum((observed.get((i, j), 0) - r[i] * c[j] / total) ** 2 / (r[i] * c[j] / total) for i in r for j in c)
    got = stats.chi2_test(plain, "f", "y").collect()[0]
    assert got.statistic == pytest.approx(want) and got.cramers_v == pytest.approx((want / total / 2) ** 0.5)
    cells = {(x.level, x.outcome): x.n for x in mix.contingency(df, "f", "y").collect()}
    assert len(cells) == 9 and cells["c", 2] == 1


def test_fit_bound_leaves_the_held_out_part_whole(spark, folder):
    table = models.training_table(registry.L(spark, folder), rows=200)
    sizes = {r.is_test: r["count"] for r in table.groupBy("is_test").count().collect()}
    assert sizes == {0: 200, 1: 300}


def test_segmentation_takes_all_orders(spark, folder):
    assert segments.segment_table(registry.L(spark, folder)).count() == 1500


def test_label_encode_of_missing_and_mixed_columns(spark):
    df = spark.createDataFrame([("b", 3), ("a", 10), (None, 3)], "s string, n int")
    got = {(r.s, r.n): (r.s_enc, r.n_enc) for r in features.label_encode(df, ["s", "n"]).collect()}
    assert got == {("b", 3): (1, 1), ("a", 10): (0, 0), (None, 3): (None, 1)}


def test_winsorised_mean_moves_no_rows_by_group_alone(spark, folder):
    plan = rates.winsor_mean(registry.B(spark, folder), "brand", "order_amount")
    text = plan._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line and "__value" in line]
    assert not [line for line in joins if "__bucket" not in line]
    assert text.count("__value") and "hashpartitioning(brand" in text


def test_winsorised_mean_equals_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 500), ("d", 33)) for v in rng.lognormal(3, 2, n) - 5]
    rows += [("e", None), ("c", None), (None, 1.0), ("f", 7.0), ("f", 7.0)]
    got = {r.g: (r.n, r.winsor_mean) for r in rates.winsor_mean(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    for g in "abcdf":
        x = np.array([max(v, 0.0) for k, v in rows if k == g and v is not None])
        assert got[g][1] == pytest.approx(np.minimum(x, np.quantile(x, 0.95)).mean())
    assert got["e"] == (1, None) and got["c"][0] == 501 and set(got) == set("abcdef")


def test_queries_run_from_any_folder(tmp_path):
    """Executors get the package's functions with their code; they need no copy of it."""
    script = (
        "import sys, importlib.util as u\n"
        f"s = u.spec_from_file_location('entry', {str(ROOT / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m)\n"
        "from contactscope.session import local_session\n"
        "spark = local_session(2)\n"
        "q = m.queries()\n"
        "print('rows', q['chi2_currency'](spark, '/root/testdata/sf0.001').count(), q['propensity'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1 5" in done.stdout, done.stderr[-2000:]
