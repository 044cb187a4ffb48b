"""Tables stored by order: the results of the plain joins, without moving rows."""

import random
import uuid

import pytest

from contactscope.operators import link
from contactscope.sources.layout import OrderLayout, stored_by_order

TIMES = "order_id long, order_created_at timestamp_ntz"


@pytest.fixture
def data(spark, tmp_path):
    draw = random.Random(3)
    orders = [(i, f"2024-01-{i % 28 + 1:02d} 10:00:00") for i in range(200)] + [(7, "2024-02-01 00:00:00")]
    contacts = [(k, draw.choice([5, 5, None, draw.randrange(250)]), f"2024-02-{k % 28 + 1:02d} 12:30:00") for k in range(900)]
    orders = spark.createDataFrame(orders, "order_id long, t string").selectExpr("order_id", "cast(t as timestamp_ntz) as order_created_at")
    contacts = spark.createDataFrame(contacts, "errand_id long, order_id long, t string").selectExpr(
        "errand_id", "order_id", "cast(t as timestamp_ntz) as created"
    )
    name = f"layout_{uuid.uuid4().hex}"
    batches = [(f"day {d}", contacts.where(f"errand_id % 3 = {d}")) for d in range(3)]
    layout = stored_by_order(spark, name, f"file://{tmp_path}/layout", orders, batches, 4)
    yield orders, contacts, layout
    layout.drop()


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_same_results(spark, data):
    orders, contacts, layout = data
    assert rows(layout.contact_counts()) == rows(link.with_contact_counts(orders, contacts))
    assert rows(layout.contact_flag()) == rows(link.flag_contacted(orders, contacts))
    assert rows(layout.link_contacts()) == rows(link.link_contacts(contacts, orders))
    # A third of all contacts belongs to one order: they lie apart, and so do those without a key.
    assert {r.order_id for r in layout.apart().collect()} == {None, 5}
    again = OrderLayout(spark, layout.name, layout.path, layout.buckets)
    assert again.batches() == ["day 0", "day 1", "day 2"] and again.contact_counts().count() == 201


def test_no_shuffle_by_order(spark, data):
    _, _, layout = data
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (layout.contact_counts(), layout.link_contacts(), layout.contact_flag()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
            df.collect()
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_batches_come_once(spark, data):
    orders, contacts, layout = data
    with pytest.raises(ValueError, match="there already"):
        layout.append(contacts, "day 1")
    with pytest.raises(ValueError, match="its orders already"):
        layout.create(orders)
    before = rows(layout.contact_counts())
    # A batch that broke off after its buckets were written does not count, and can be removed and appended anew.
    half = contacts.where("order_id is not null and order_id <> 5").selectExpr("*", "'day 3' as batch")
    layout._write(half, "contacts", batches=True)
    assert rows(layout.contact_counts()) == before
    layout.clear("day 3")
    layout.append(contacts.limit(0), "day 3")
    assert rows(layout.contact_counts()) == before and len(layout.batches()) == 4
