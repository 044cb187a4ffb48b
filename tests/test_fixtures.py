"""Small literal cases: missing values, ties, bad keys, empty and one-level groups."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from contactscope.functions import tails
from contactscope.functions.keys import decode_base36
from contactscope.functions.numeric import clip, round_even, share
from contactscope.functions.timeparts import hours_between, parse_ts, period
from contactscope.operators import (
    clean,
    curves,
    features,
    link,
    mix,
    quality,
    ranking,
    rates,
    repeat,
    stats,
)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def ts(text):
    return dt.datetime.fromisoformat(text)


DECODED = [
    ("24770FC", 4607513832), ("24770fc", 4607513832), (" 1Z ", 71), ("12-3", None), ("!!", None),
    ("", None), (None, None), ("nan", 30191), ("-1Z", -71), ("+1z", 71), ("1_Z", 71), ("_1", None),
    ("1_", None), ("1__2", None), ("000", 0), ("ZZZZZZZZZZZZ", 36**12 - 1), ("1" + "0" * 12, 36**12), ("1Y2P0IJ32E8E7", 2**63 - 1),
    ("1y2p0ij32e8e7", 2**63 - 1), ("1Y2P0IJ32E8E8", None), ("Z" * 13, None), ("-1Y2P0IJ32E8E7", 1 - 2**63),
    ("000_1Y2P0IJ32E8E7", 2**63 - 1), ("1" + "0" * 13, None),
    ("0" * 30 + "1Z", 71),
]


def test_decode(spark):
    df = frame(spark, "i int, k string", *[(i, k) for i, (k, _) in enumerate(DECODED)])
    got = df.select("i", decode_base36(F.col("k")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [v for _, v in DECODED]


def test_decode_strict(spark):
    good = frame(spark, "k string", ("24770FC",), (None,))
    got = good.select(decode_base36(F.col("k"), strict=True).alias("v")).collect()
    assert {r.v for r in got} == {4607513832, None}
    with pytest.raises(PySparkException, match="not a base-36 key"):
        frame(spark, "k string", ("12-3",)).select(decode_base36(F.col("k"), strict=True)).collect()


def test_parse_ts(spark):
    df = frame(spark, "t string", ("2024-03-31 02:30:00.5",), ("2024-05-01",), ("soon",), (None,))
    got = [r.v for r in df.select(parse_ts(F.col("t")).alias("v")).collect()]
    assert got == [ts("2024-03-31 02:30:00.5"), ts("2024-05-01"), None, None]
    with pytest.raises(PySparkException, match="not a timestamp"):
        df.select(parse_ts(F.col("t"), strict=True)).collect()


def test_times_do_not_depend_on_the_session_zone(spark):
    df = frame(
        spark, "a timestamp_ntz, b timestamp_ntz", (ts("2024-03-31 01:30"), ts("2024-03-31 03:30:00.000360"))
    )
    query = df.select(
        hours_between(F.col("a"), F.col("b")).alias("h"),
        period(F.col("a"), "week").alias("w"),
        period(F.col("a"), "quarter").alias("q"),
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Stockholm", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = query.collect()[0]
            assert row.h == pytest.approx(2.0000001, abs=1e-12)
            assert (row.w, row.q) == (dt.date(2024, 3, 25), dt.date(2024, 1, 1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_numeric_helpers(spark):
    df = frame(spark, "x double", (-1.0,), (2.5,), (99.0,), (None,))
    got = df.select(
        clip(F.col("x"), F.lit(0.0), F.lit(10.0)).alias("c"),
        round_even(F.col("x"), 0).alias("r"),
        share(F.col("x"), F.lit(0)).alias("s"),
    ).collect()
    assert [r.c for r in got] == [0.0, 2.5, 10.0, None]
    assert [r.r for r in got] == [-1.0, 2.0, 99.0, None]
    assert [r.s for r in got] == [None] * 4


def test_tail_probabilities():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(0.0, 0) == 1.0 and tails.chi2_tail(0.0, 3) == 1.0
    # exp(-x/2) alone would underflow here
    assert 0 < tails.chi2_tail(1500.0, 1000) < 1e-15
    assert tails.normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-15)
    assert tails.log_erfc(25.0) == pytest.approx(math.log(math.erfc(25.0)), rel=1e-9)


def test_null_keys_are_no_group(spark):
    df = frame(spark, "f string, contacted int", (None, 1), ("A", 1), ("A", 0), ("B", 0))
    assert {r.level for r in rates.rate_by(df, ["f"]).collect()} == {"A", "B"}
    assert {r.level for r in rates.rate_by(df, ["f"], dropna=False).collect()} == {None, "A", "B"}
    cells = {(r.level, r.outcome): r.n for r in mix.contingency(df, "f", "contacted").collect()}
    assert cells == {("A", 0): 1, ("A", 1): 1, ("B", 0): 1, ("B", 1): 0}


def test_duplicates_and_nulls(spark):
    df = frame(spark, "id int, x double", (1, 1.0), (1, None), (1, 2.0), (2, None), (None, 1.0), (None, 1.0))
    assert quality.duplicate_keys(df, "id").collect()[0].duplicates == 3
    assert {(r["column"], r.nulls) for r in quality.null_counts(df).collect()} == {("id", 2), ("x", 2)}
    assert quality.null_counts(df.where("x = 2.0")).count() == 0
    empty = df.where("id > 5")
    assert quality.duplicate_keys(empty, "id").collect()[0].duplicates == 0
    assert quality.threshold_audit(empty, {"neg": F.col("x") < 0}).collect()[0].pct is None


def test_test_flag(spark):
    df = frame(spark, "is_test_errand int", (0,), (0,), (1,), (None,))
    assert clean.drop_test(df).count() == 2
    row = quality.test_flag_audit(df).collect()[0]
    assert (row.contacts, row.test_contacts, row.real_contacts, row.test_pct) == (4, 1, 2, 25.0)


def test_window_edge(spark):
    orders = frame(spark, "order_id long, order_created_at timestamp_ntz", (1, ts("2024-01-01")), (2, None))
    edge = ts("2024-01-01") + dt.timedelta(days=90)
    contacts = frame(
        spark,
        "errand_id int, created timestamp_ntz, order_id long, errand_category string",
        (1, edge, 1, "a"), (2, edge + dt.timedelta(microseconds=1), 1, "b"), (3, None, None, None),
    )
    assert [r.errand_id for r in clean.in_window(contacts, orders).collect()] == [1]
    assert {r.errand_id for r in mix.out_of_window(contacts, orders).collect()} == {2, 3}
    report = {r.metric: (r.n, r.pct) for r in mix.linkage_report(orders, contacts).collect()}
    assert report["in_window"][0] + report["out_of_window"][0] == report["real_contacts"][0] == 3
    assert report["orders_without_contact"] == (1, 50.0)


def small_tables(spark):
    orders = frame(
        spark,
        "order_id long, order_created_at timestamp_ntz",
        (1, ts("2024-01-01")), (2, ts("2024-01-02")), (3, ts("2024-01-03")),
    )
    contacts = frame(
        spark,
        "errand_id long, order_number string, created timestamp_ntz, errand_category string, order_id long",
        (11, "1", ts("2024-01-03"), "late", 1),
        (13, "1", ts("2024-01-02"), "tie b", 1),
        (12, "1", ts("2024-01-02"), "tie a", 1),
        (10, "1", ts("2024-01-01 12:00"), None, 1),
        (21, "2", None, "no time", 2),
        (22, "2", ts("2024-01-01"), "timed", 2),
        (91, "9", ts("2024-01-05"), "orphan", 9),
        (92, "!!", ts("2024-01-05"), "bad", None),
    )
    return orders, contacts


def test_links(spark):
    orders, contacts = small_tables(spark)
    linked = {r.order_id: (r.n_contacts, r.contacted) for r in link.with_contact_counts(orders, contacts).collect()}
    assert linked == {1: (4, 1), 2: (2, 1), 3: (0, 0)}
    assert {r.order_id: r.contacted for r in link.flag_contacted(orders, contacts).collect()} == {1: 1, 2: 1, 3: 0}
    assert [r.order_id for r in link.uncontacted(orders, contacts).collect()] == [3]
    assert {r.errand_id for r in link.orphan_contacts(contacts, orders).collect()} == {91, 92}
    rows = link.link_contacts(contacts, orders).collect()
    assert len(rows) == 8
    assert {r.errand_id for r in rows if r.hours_to_contact is None} == {21, 91, 92}
    audit = link.decode_audit(contacts, orders).collect()[0]
    assert (audit.real_contacts, audit.failed_decodes, audit.matched, audit.raw_matched) == (8, 1, 6, 6)
    base = rates.contact_baseline(link.with_contact_counts(orders, contacts), contacts).collect()[0]
    assert (base.orders, base.contacted_orders, base.contacted_keys) == (3, 2, 3)
    assert base.mean_contacts == pytest.approx(7 / 3) and base.repeat_share == pytest.approx(2 / 3)


def test_duplicate_orders_fan_out_in_links_only(spark):
    orders, contacts = small_tables(spark)
    twice = orders.unionByName(orders)
    assert link.link_contacts(contacts, twice).count() == 8 + 6
    assert link.first_contact(contacts, twice).count() == 3


def test_first_contact(spark):
    orders, contacts = small_tables(spark)
    rows = {r.order_id: r for r in link.first_contact(contacts, orders).collect()}
    assert {k: r.first_category for k, r in rows.items()} == {1: "tie a", 2: "timed", 9: "orphan"}
    assert rows[1].hours_ttfc == 12.0 and rows[2].hours_ttfc == -24.0 and rows[9].hours_ttfc is None
    assert [r.order_id for r in curves.ttfc(contacts, orders).collect()] == [1]
    per_order = {r.order_id: r.is_repeat for r in repeat.repeat_per_order(contacts).collect()}
    assert per_order == {1: 1, 2: 1, 9: 0}


def table_2x2(spark):
    rows = [("a", 0, 4096), ("a", 1, 837), ("b", 0, 8248), ("b", 1, 1819)]
    return frame(spark, "f string, contacted int, n int", *rows).select(
        "f", "contacted", F.explode(F.sequence(F.lit(1), "n"))
    )


def test_chi2(spark):
    row = stats.chi2_test(table_2x2(spark), "f").collect()[0]
    assert (row.dof, row.n) == (1, 15000)
    assert row.statistic == pytest.approx(2.681985, abs=1e-6)
    assert row.p_value == pytest.approx(0.101489, abs=1e-6)


def test_chi2_degenerate(spark):
    one_level = frame(spark, "f string, contacted int", ("a", 0), ("a", 1), (None, 1))
    row = stats.chi2_test(one_level, "f").collect()[0]
    assert (row.statistic, row.dof, row.p_value, row.n) == (0.0, 0, 1.0, 2)
    one_outcome = frame(spark, "f string, contacted int", ("a", 1), ("b", 1))
    row = stats.chi2_test(one_outcome, "f").collect()[0]
    assert (row.statistic, row.dof, row.p_value) == (0.0, 0, 1.0)


def test_mann_whitney(spark):
    df = frame(spark, "v int, g string", (1, "x"), (1, "x"), (0, "x"), (0, "y"), (0, "y"), (1, "y"), (None, "x"))
    forward = stats.mann_whitney(df, "v", "g", "x", "y").collect()[0]
    backward = stats.mann_whitney(df, "v", "g", "y", "x").collect()[0]
    assert forward.statistic == 6.0 and forward.statistic + backward.statistic == 9.0
    assert forward.p_value == pytest.approx(backward.p_value)
    same = stats.mann_whitney(df.where("v = 1"), "v", "g", "x", "y").collect()[0]
    assert same.p_value == 1.0
    none = stats.mann_whitney(df, "v", "g", "x", "z").collect()[0]
    assert none.n_y == 0 and none.p_value is None


def test_median_split(spark):
    df = frame(spark, "a double", (-5.0,), (1.0,), (2.0,), (8.0,), (None,))
    groups = {r.a: r.value_group for r in stats.median_split(df, "a").collect()}
    assert groups == {-5.0: "low", 1.0: "low", 2.0: "high", 8.0: "high", None: None}


def test_quantiles(spark):
    df = frame(spark, "x int", (1,), (2,), (3,), (4,), (10,), (None,))
    row = ranking.quantiles(df, "x", {"q": 0.9, "m": 0.5}).collect()[0]
    assert (row.n, row.m) == (5, 3.0) and row.q == pytest.approx(7.6)
    at = ranking.order_statistics(df, "x", {"v": lambda n: F.floor(n.cast("double") * F.lit(0.9))})
    assert at.collect()[0].v == 10
    assert ranking.median(df.where("x > 50"), "x").collect()[0].median is None
    assert ranking.median(df, "x", approx=True).collect()[0].median == 3.0


def test_histogram_edges(spark):
    df = frame(spark, "x double", (0.0,), (5.0,), (10.0,), (10.0,), (None,))
    rows = {r.bin: r for r in curves.equal_width_hist(df, "x", 5).collect()}
    assert [rows[i].n for i in range(1, 6)] == [1, 0, 1, 0, 2]
    assert (rows[1].left_edge, rows[5].right_edge) == (0.0, 10.0)
    flat = {r.bin: r.n for r in curves.equal_width_hist(df.where("x = 10"), "x", 5).collect()}
    assert flat == {1: 0, 2: 0, 3: 2, 4: 0, 5: 0}


def test_lorenz(spark):
    counts = frame(spark, "order_id long, n_contacts long", (1, 1), (2, 1), (3, 2))
    points = [(r.cum_orders, r.cum_contacts) for r in rates.lorenz(counts).orderBy("n_contacts").collect()]
    assert points == [(2 / 3, 1 / 2), (1.0, 1.0)]
    histogram = rates.count_histogram(counts.withColumn("n_contacts", F.col("n_contacts") * 6)).collect()
    assert [(r.n_contacts, r.orders) for r in histogram] == [(6, 2), (10, 1)]


def test_row_without_top_level(spark):
    df = frame(
        spark, "errand_channel string, errand_category string",
        ("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("c", None), (None, "x"),
    )
    top = mix.category_mix(df, "errand_channel", "errand_category", k=1, denom="top")
    assert {(r.errand_channel, r.n, r.pct) for r in top.collect()} == {("a", 2, 100.0), ("b", 0, None)}
    everything = mix.category_mix(df, "errand_channel", "errand_category", k=1, denom="all")
    assert {(r.errand_channel, r.pct) for r in everything.collect()} == {("a", 2 / 3 * 100), ("b", 0.0)}


def test_monthly_volume(spark):
    day = ts("2024-01-05")
    df = frame(spark, "created timestamp_ntz, errand_category string", (day, "a"), (day, "c"), (day, "d"), (day, None))
    rows = mix.monthly_volume(df, ["a", "b"]).orderBy("position").collect()
    assert [(r.series, r.contacts, r.bottom, r.total) for r in rows] == [
        ("a", 1, 0, 3), ("b", 0, 1, 3), ("Other", 2, 1, 3),
    ]


def test_head_and_tail_overlap(spark):
    df = frame(spark, "k string, r double", *[(f"k{i}", float(i)) for i in range(5)])
    assert mix.head_tail(df, 3, 3, "r", "k").count() == 5
    assert {r.k for r in mix.head_tail(df, 1, 1, "r", "k").collect()} == {"k0", "k4"}


def test_winsor_mean_ignores_missing(spark):
    df = frame(
        spark, "g int, x double",
        *[(1, float(i)) for i in range(1, 101)], (1, None), (1, -50.0), (2, None),
    )
    rows = {r.g: r for r in rates.winsor_mean(df, "g", "x").collect()}
    values = [0.0, *[float(i) for i in range(1, 101)]]
    cap = 95.0  # position 0.95 * 100 of 101 values
    assert rows[1].winsor_mean == pytest.approx(sum(min(v, cap) for v in values) / 101)
    assert rows[1].n == 102 and rows[2].winsor_mean is None


def test_features_refuse_later_columns(spark):
    orders = frame(spark, "order_id long", (1,))
    for late in ("is_canceled", "Is_Changed", "cancel_reason", "contacted", "n_contacts"):
        with pytest.raises(ValueError, match="not known at booking time"):
            features.booking_features(orders, ["brand", late])


def test_standardise_constant(spark):
    df = frame(spark, "id int, a double, b int", (1, 1.0, 7), (2, 3.0, 7))
    rows = {r.id: (r.a_std, r.b_std) for r in features.standardise(df, ["a", "b"]).collect()}
    assert rows == {1: (-1.0, 0.0), 2: (1.0, 0.0)}


def test_label_encode(spark):
    df = frame(spark, "c string", ("b",), ("Z",), ("a",), ("b",))
    assert {(r.c, r.c_enc) for r in features.label_encode(df, ["c"]).collect()} == {("Z", 0), ("a", 1), ("b", 2)}
