"""Orders and contacts stored by order, so that linking them moves no rows.

Both tables are cut into the same number of buckets by a hash of the order id and sorted by it. Counting the
contacts of orders, flagging orders and giving contacts their order's time then are joins of bucket with
bucket, without a shuffle. Contacts come in batches, such as a day's; a batch is decoded once, when it is
appended, and shuffled once, to its buckets.

What a bucket could not hold evenly lies apart, in a table without buckets: contacts without a key, and
those of orders with more contacts in a batch than a bucket has on average. A batch has no more such orders
than there are buckets, so what they are joined with is a short list, which is counted before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactscope.functions.timeparts import hours_between
from contactscope.operators.link import KEY, contacts_per_order
from contactscope.sources.tables import materialise

BUCKETS = 64
BROADCAST_ORDERS = 100_000  # rows of the list of orders whose contacts lie apart


class OrderLayout:
    """Three tables, ``<name>_orders``, ``<name>_contacts`` and ``<name>_apart``, below ``path``."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets

    def _table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def _write(self, df: DataFrame, part: str, bucketed: bool = True, batches: bool = False) -> None:
        if bucketed:
            df = df.repartition(self.buckets, KEY)
        writer = df.write.mode("append").option("path", f"{self.path}/{part}")
        if batches:
            writer = writer.partitionBy("batch")
        if bucketed:
            writer = writer.bucketBy(self.buckets, KEY).sortBy(KEY)
        writer.saveAsTable(f"{self.name}_{part}")

    def create(self, orders: DataFrame) -> OrderLayout:
        """Store the orders. A layout has them once; orders without an id match nothing and are kept too."""
        if self.spark.catalog.tableExists(f"{self.name}_orders"):
            raise ValueError(f"{self.name} has its orders already")
        self._write(orders, "orders")
        return self

    def batches(self) -> list[str]:
        """The batches that have been appended."""
        held = self.spark.catalog.tableExists(f"{self.name}_apart")
        return sorted(r.batch for r in self._table("apart").select("batch").distinct().collect()) if held else []

    def append(self, contacts: DataFrame, batch: str) -> OrderLayout:
        """Add a batch of real contacts with decoded keys. A batch that is there already is an error.

        The contacts that lie apart are written last, with one row that only marks the batch; a batch
        whose writing broke off is not there, and ``clear`` removes what it left.
        """
        if batch in self.batches():
            raise ValueError(f"the batch {batch} is there already")
        contacts = materialise(contacts, "layout-batch")
        counts = contacts_per_order(contacts)
        hot = materialise(counts.where(F.col("n_contacts") > F.lit(contacts.count()) / self.buckets), "layout-hot")
        named = contacts.withColumn("batch", F.lit(batch))
        keys = F.broadcast(hot.select(KEY))  # fewer than there are buckets
        even = named.where(F.col(KEY).isNotNull()).join(keys, KEY, "left_anti").select(named.columns)
        odd = named.where(F.col(KEY).isNull()).unionByName(named.join(keys, KEY, "left_semi").select(named.columns))
        self._write(even, "contacts", batches=True)
        marks = self.spark.createDataFrame([(batch,)], "batch string")
        odd = odd.withColumn("is_mark", F.lit(False))
        marks = marks.withColumn("is_mark", F.lit(True))
        self._write(odd.unionByName(marks, allowMissingColumns=True), "apart", bucketed=False, batches=True)
        return self

    def clear(self, batch: str) -> None:
        """Remove what a batch left whose writing broke off."""
        if batch in self.batches():
            raise ValueError(f"the batch {batch} is whole")
        if self.spark.catalog.tableExists(f"{self.name}_contacts"):
            self.spark.sql(f"ALTER TABLE {self.name}_contacts DROP IF EXISTS PARTITION (batch = '{batch}')")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/contacts/batch={batch}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop(self) -> None:
        """Remove the tables and their files."""
        for part in ("orders", "contacts", "apart"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def orders(self) -> DataFrame:
        return self._table("orders")

    def contacts(self) -> DataFrame:
        """The contacts in buckets; those that lie apart are not among them."""
        return self._table("contacts").where(F.col("batch").isin(self.batches()))

    def apart(self) -> DataFrame:
        return self._table("apart").where("not is_mark").drop("is_mark")

    def _short(self, df: DataFrame) -> DataFrame:
        df = materialise(df, "layout-short")
        return F.broadcast(df) if df.count() <= BROADCAST_ORDERS else df

    def contact_counts(self) -> DataFrame:
        """Orders with ``n_contacts`` (0 when there is none) and the flag ``contacted``."""
        more = self._short(contacts_per_order(self.apart()).withColumnRenamed("n_contacts", "__more"))
        met = self.orders().join(contacts_per_order(self.contacts()), KEY, "left").join(more, KEY, "left")
        n = F.coalesce("n_contacts", F.lit(0)) + F.coalesce("__more", F.lit(0))
        met = met.withColumn("n_contacts", n.cast("bigint")).drop("__more")
        return met.withColumn("contacted", (F.col("n_contacts") > 0).cast("int"))

    def contact_flag(self) -> DataFrame:
        """Orders with the flag ``contacted``."""
        return self.contact_counts().drop("n_contacts")

    def link_contacts(self) -> DataFrame:
        """Every contact with the time of its order and the hours between the two, as ``link.link_contacts``."""
        times = self.orders().select(KEY, "order_created_at")
        even = self.contacts().join(times, KEY, "left")
        keys = self._short(self.apart().where(F.col(KEY).isNotNull()).select(KEY).distinct())
        some = self._short(times.join(keys, KEY, "left_semi"))
        linked = even.unionByName(self.apart().join(some, KEY, "left"))
        return linked.drop("batch").withColumn("hours_to_contact", hours_between(F.col("order_created_at"), F.col("created")))


def stored_by_order(
    spark: SparkSession,
    name: str,
    path: str,
    orders: DataFrame,
    contacts: Iterable[tuple[str, DataFrame]],
    buckets: int = BUCKETS,
) -> OrderLayout:
    """A new layout of orders and batches of contacts (name, rows)."""
    layout = OrderLayout(spark, name, path, buckets).create(orders)
    for batch, rows in contacts:
        layout.append(rows, batch)
    return layout
