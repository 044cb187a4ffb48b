"""Bookings and contacts derived from a star schema of orders and line items.

``bookings`` and ``contacts`` have the shapes of the two input tables, so every
operator can run on any data set that has the star-schema tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ID_BASE = 4_600_000_000  # makes every base-36 key seven characters long

IS_CANCELED = "cast(o_custkey % 10 = 0 as int)"
IS_CHANGED = "cast(o_custkey % 7 = 0 as int)"


# Declared, so that no job reads file footers while a query is being built.
SCHEMAS = {
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def booking_core(spark: SparkSession, folder: str) -> DataFrame:
    """The booking columns that need no customer lookup."""
    return _table(spark, folder, "orders").selectExpr(
        f"o_orderkey + {ID_BASE} as order_id",
        "o_orderdate + make_dt_interval(0, cast(o_custkey % 24 as int)) as order_created_at",
        "case when o_orderkey % 97 <> 0 then o_totalprice - 5000.0D end as order_amount",
        "o_orderpriority as device",
        """case o_orderstatus when 'F' then 'One-way' when 'O' then 'Round-trip'
           when 'P' then 'Multi-city' end as journey_type_id""",
        f"{IS_CANCELED} as is_canceled",
        f"{IS_CHANGED} as is_changed",
        "case when o_custkey % 3 <> 0 then concat('P', o_custkey % 5) end as partner",
        "concat('C', o_custkey % 50) as currency",
        "o_custkey as customer_key",
    )


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    """All booking columns."""
    places = _table(spark, folder, "nation").join(
        _table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
        "n_regionkey",
    )
    profile = (
        _table(spark, folder, "customer")
        .join(places.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
        .selectExpr(
            "c_custkey as customer_key",
            "c_acctbal as revenue",
            "c_mktsegment as brand",
            """case c_nationkey % 3 when 0 then 'FAMILY' when 1 then 'SINGLE' else 'GROUP' end
               as customer_group_type""",
            "case when n_regionkey <> 4 then r_name end as client_entry_type",
            "concat('S', c_nationkey % 4) as booking_system",
            "concat('T', c_nationkey % 2) as booking_system_source_type",
            "n_name as site_country",
        )
    )
    return booking_core(spark, folder).join(profile, "customer_key").drop("customer_key")


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw contacts: test records, undecodable keys and missing keys included."""
    order = _table(spark, folder, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey")
    return (
        _table(spark, folder, "lineitem")
        .where("l_discount >= 0.025D")  # the lowest of the bounds below: other rows need not be moved
        .join(order, "l_orderkey")
        .where(
            f"""l_discount >= case when {IS_CANCELED} = 1 then 0.025D
                when {IS_CHANGED} = 1 then 0.045D else 0.085D end"""
        )
        .selectExpr(
            "l_orderkey * 10 + l_linenumber as errand_id",
            f"""case when l_quantity = 50 then concat('#', l_orderkey) when l_quantity <> 49
                then conv(cast(l_orderkey + {ID_BASE} as string), 10, 36) end as order_number""",
            "l_shipdate + make_dt_interval(0, cast(l_partkey % 24 as int)) as created",
            "cast(l_tax >= 0.075D as int) as is_test_errand",
            """case when l_quantity <> 1 then concat('cat', l_suppkey % 12) end
               as errand_category""",
            """case l_partkey % 4 when 0 then 'chat' when 1 then 'phone' when 2 then 'email'
               else 'form' end as errand_channel""",
        )
    )
