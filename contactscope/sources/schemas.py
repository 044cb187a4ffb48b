"""Declared schemas of the two input tables. Names are matched in any letter case."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


ORDERS = _struct(
    order_id=T.LongType(),
    order_created_at=T.TimestampNTZType(),
    order_amount=T.DoubleType(),
    revenue=T.DoubleType(),
    brand=_TEXT,
    device=_TEXT,
    journey_type_id=_TEXT,
    customer_group_type=_TEXT,
    client_entry_type=_TEXT,
    booking_system=_TEXT,
    booking_system_source_type=_TEXT,
    site_country=_TEXT,
    currency=_TEXT,
    is_canceled=T.IntegerType(),
    is_changed=T.IntegerType(),
    partner=_TEXT,
    cancel_reason=_TEXT,
    change_reason=_TEXT,
)

CONTACTS = _struct(
    errand_id=T.LongType(),
    order_number=_TEXT,
    created=T.TimestampNTZType(),
    is_test_errand=T.IntegerType(),
    errand_category=_TEXT,
    errand_channel=_TEXT,
    errand_type=_TEXT,
    errand_action=_TEXT,
)
