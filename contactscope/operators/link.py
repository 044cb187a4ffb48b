"""Linking contacts to orders.

Contacts are merged per order before they are joined wherever a report allows it,
so an order with very many contacts is one row in the join. Only
``link_contacts`` and ``orphan_contacts`` return contact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.functions.numeric import share
from contactscope.functions.timeparts import hours_between

KEY = "order_id"


def contacts_per_order(contacts: DataFrame) -> DataFrame:
    """Number of contacts per decodable key, unknown orders included."""
    # Contacts without a key count as 0 and leave after the grouping: a filter before it
    # would be pushed to the scan and decode every key a second time.
    return contacts.groupBy(KEY).agg(F.count(KEY).alias("n_contacts")).where("n_contacts > 0")


def contact_keys(contacts: DataFrame) -> DataFrame:
    """The distinct order keys that occur among the contacts."""
    return contacts_per_order(contacts).select(KEY)


def with_contact_counts(orders: DataFrame, contacts: DataFrame) -> DataFrame:
    """Orders with ``n_contacts`` (0 when there is none) and the flag ``contacted``."""
    return orders.join(contacts_per_order(contacts), KEY, "left").withColumns(
        {
            "n_contacts": F.coalesce(F.col("n_contacts"), F.lit(0).cast("bigint")),
            "contacted": F.col("n_contacts").isNotNull().cast("int"),
        }
    )


def flag_contacted(orders: DataFrame, contacts: DataFrame) -> DataFrame:
    """Orders with the flag ``contacted``: 1 if the key occurs among the contacts."""
    keys = contact_keys(contacts).withColumn("__hit", F.lit(1))
    return orders.join(keys, KEY, "left").withColumn(
        "contacted", F.coalesce(F.col("__hit"), F.lit(0))
    ).drop("__hit")


def uncontacted(orders: DataFrame, contacts: DataFrame) -> DataFrame:
    """Orders without any contact."""
    return orders.join(contact_keys(contacts), KEY, "left_anti")


def uncontacted_share(orders: DataFrame, contacts: DataFrame) -> DataFrame:
    """Orders without any contact: count and percentage."""
    none = F.count_if(F.col("contacted") == 0)
    total = F.count(F.lit(1))
    return flag_contacted(orders.select(KEY), contacts).agg(
        total.alias("orders"),
        none.alias("uncontacted"),
        (share(none, total) * 100).alias("uncontacted_pct"),
    )


def _spread() -> Column:
    """0 for a contact with a key; without one, which matches nothing, a hash of the contact."""
    return F.when(F.col(KEY).isNull(), F.xxhash64("errand_id", "created")).otherwise(F.lit(0))


def _known(orders: DataFrame) -> DataFrame:
    """Orders with the counterpart of ``_spread``; a remainder, since a literal would be no join key."""
    return orders.where(F.col(KEY).isNotNull()).withColumn("__spread", F.pmod(F.xxhash64(KEY), F.lit(1)).cast("bigint"))


def link_contacts(contacts: DataFrame, orders: DataFrame) -> DataFrame:
    """Every contact with the time of its order and the hours between the two.

    Contacts without a known order keep NULL in both. An order key that occurs
    twice among the orders gives two rows per contact. Contacts without a key are dealt out by
    a hash; an order with very many contacts is for the skew join of adaptive execution.
    """
    left = contacts.withColumn("__spread", _spread())
    right = _known(orders.select(KEY, "order_created_at"))
    return (
        left.join(right, [KEY, "__spread"], "left")
        .drop("__spread")
        .withColumn(
            "hours_to_contact", hours_between(F.col("order_created_at"), F.col("created"))
        )
    )


def orphan_contacts(contacts: DataFrame, orders: DataFrame) -> DataFrame:
    """Contacts without a known order, undecodable keys included."""
    left = contacts.withColumn("__spread", _spread())
    return left.join(_known(orders.select(KEY)), [KEY, "__spread"], "left_anti").drop("__spread")


def first_contact(
    contacts: DataFrame, orders: DataFrame, with_category: bool = True
) -> DataFrame:
    """Per contacted key: number of contacts, first contact, order time, hours between.

    ``first_category`` is the category of the earliest contact that has one. Equal
    times are settled by contact id, contacts without a time come last. Should an
    order key occur twice among the orders, its earliest time counts.
    """
    aggs = [F.count(KEY).alias("n_contacts"), F.min("created").alias("first_at")]
    if with_category:
        aggs.append(first_by("errand_category").alias("first_category"))
    per_key = contacts.groupBy(KEY).agg(*aggs).where("n_contacts > 0")
    times = (
        orders.where(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(F.min("order_created_at").alias("order_created_at"))
    )
    return per_key.join(times, KEY, "left").withColumn(
        "hours_ttfc", hours_between(F.col("order_created_at"), F.col("first_at"))
    )


def first_by(value: str, ts: str = "created", tiebreak: str = "errand_id"):
    """Aggregate: the first non-NULL value in time order, with ties settled by id."""
    rank = F.struct(
        F.col(ts).isNull().alias("late"),
        F.col(ts).alias("ts"),
        F.col(tiebreak).alias("id"),
        F.col(value).alias("value"),
    )
    return F.min(F.when(F.col(value).isNotNull(), rank))["value"]


def decode_audit(contacts: DataFrame, orders: DataFrame) -> DataFrame:
    """Real contacts, failed decodes, and how many find their order.

    ``raw_matched`` counts what a join on the undecoded text would have found.
    Contacts are merged per key before they meet the orders.
    """
    key_kinds = F.array(
        F.struct(F.col("order_number").try_cast("bigint").alias(KEY), F.lit(1).alias("raw")),
        F.struct(F.col(KEY).alias(KEY), F.lit(0).alias("raw")),
    )
    per_key = (
        contacts.select(F.inline(key_kinds))
        .groupBy(KEY)
        .agg(
            F.count_if(F.col("raw") == 1).alias("n_raw"),
            F.count_if(F.col("raw") == 0).alias("n_decoded"),
        )
    )
    known = orders.where(F.col(KEY).isNotNull()).select(KEY).distinct().withColumn("hit", F.lit(1))
    hit = F.col("hit").isNotNull()

    def total(name: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0)).cast("bigint")

    return (
        per_key.join(known, KEY, "left")
        .agg(
            total("n_decoded", F.lit(True)).alias("real_contacts"),
            total("n_decoded", F.col(KEY).isNull()).alias("failed_decodes"),
            total("n_decoded", hit).alias("matched"),
            total("n_raw", hit).alias("raw_matched"),
        )
        .withColumn("match_rate", share(F.col("matched"), F.col("real_contacts")))
        .withColumn("raw_match_rate", share(F.col("raw_matched"), F.col("real_contacts")))
    )
