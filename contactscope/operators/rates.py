"""Contact rates, concentration and headline figures.

``orders`` here means orders with ``contacted`` and ``n_contacts`` (see ``link``),
``counts`` one row per contacted key with ``n_contacts``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.functions.numeric import clip, share
from contactscope.operators.link import contacts_per_order
from contactscope.operators.metrics import roc_auc
from contactscope.operators.ranking import capped_sums


def contact_baseline(orders: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row: orders, contacted orders, contact rate; mean contacts and share with two or more.

    The rate is over orders. The mean and the repeat share are over contacted keys,
    unknown orders included.
    """
    per_key = contacts_per_order(contacts).agg(
        F.struct(
            F.count(F.lit(1)).alias("keys"),
            F.avg("n_contacts").alias("mean"),
            F.avg((F.col("n_contacts") >= 2).cast("int")).alias("repeat"),
        ).alias("s")
    )
    return orders.agg(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum("contacted"), F.lit(0)).cast("bigint").alias("contacted_orders"),
        F.avg("contacted").alias("contact_rate"),
    ).select(
        "*",
        per_key.scalar()["keys"].alias("contacted_keys"),
        per_key.scalar()["mean"].alias("mean_contacts"),
        per_key.scalar()["repeat"].alias("repeat_share"),
    )


def top_share(contacts: DataFrame, q: float = 0.9) -> DataFrame:
    """Share of all contacts that falls on keys at or above the q-quantile of counts.

    Counts repeat, so they are first merged into (count, number of keys).
    """
    histogram = (
        contacts_per_order(contacts).groupBy("n_contacts").agg(F.count(F.lit(1)).alias("keys"))
    )
    threshold = histogram.agg(F.percentile("n_contacts", q, F.col("keys"))).scalar()
    total = contacts.agg(F.count(F.lit(1))).scalar()
    above = F.col("n_contacts") >= F.col("threshold")
    volume = F.col("n_contacts") * F.col("keys")
    return (
        histogram.withColumn("threshold", threshold)
        .agg(
            F.max("threshold").alias("threshold"),
            F.coalesce(F.sum(F.when(above, volume)), F.lit(0)).cast("bigint").alias("top_contacts"),
        )
        .withColumn("contacts", total)
        .withColumn("top_share", share(F.col("top_contacts"), F.col("contacts")))
    )


def rate_by(
    df: DataFrame,
    dims: Sequence[str],
    flag: str = "contacted",
    overall: Column | None = None,
    dropna: bool = True,
) -> DataFrame:
    """Flag rate per level of every dimension, in one pass over the rows.

    With ``overall`` (one number, e.g. a scalar subquery) a column tells whether the
    level lies above it.
    """
    long = df.select(flag, *[F.col(d).cast("string").alias(d) for d in dims]).unpivot(
        [flag], list(dims), "dimension", "level"
    )
    if dropna:
        long = long.where(F.col("level").isNotNull())
    out = long.groupBy("dimension", "level").agg(
        F.coalesce(F.sum(flag), F.lit(0)).cast("bigint").alias("contacts"),
        F.count(flag).alias("orders"),
        F.avg(flag).alias("contact_rate"),
    )
    if overall is not None:
        out = out.withColumn("overall_rate", overall).withColumn(
            "above_overall", (F.col("contact_rate") > F.col("overall_rate")).cast("int")
        )
    return out


def ranked_rates(rates: DataFrame) -> DataFrame:
    """Rates sorted within each dimension, highest first."""
    return rates.orderBy("dimension", F.desc("contact_rate"), "level")


def extreme_levels(rates: DataFrame) -> DataFrame:
    """Per dimension the levels with the highest and the lowest rate; ties go to the first name."""
    highest = F.min(F.struct((-F.col("contact_rate")).alias("r"), F.col("level").alias("level")))
    lowest = F.min(F.struct(F.col("contact_rate").alias("r"), F.col("level").alias("level")))
    return rates.groupBy("dimension").agg(
        highest["level"].alias("highest_level"),
        (-highest["r"]).alias("highest_rate"),
        lowest["level"].alias("lowest_level"),
        lowest["r"].alias("lowest_rate"),
    )


def rate_grid(
    df: DataFrame, a: str = "is_canceled", b: str = "is_changed", flag: str = "contacted"
) -> DataFrame:
    """Flag rate per pair of levels; pairs that do not occur have no row."""
    return (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(a, b)
        .agg(F.count(F.lit(1)).alias("orders"), F.avg(flag).alias("contact_rate"))
    )


def rate_grid_wide(
    df: DataFrame,
    a: str = "is_canceled",
    b: str = "is_changed",
    b_levels: Sequence = (0, 1),
    flag: str = "contacted",
) -> DataFrame:
    """The same as a grid: one row per level of ``a``, NULL where a pair does not occur."""
    return (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(a)
        .agg(*[F.avg(F.when(F.col(b) == F.lit(v), F.col(flag))).alias(f"{b}_{v}") for v in b_levels])
    )


def disruption_rates(df: DataFrame, flag: str = "contacted") -> DataFrame:
    """Contact rate of undisturbed, changed and cancelled orders; cancellation goes first."""
    canceled, changed = F.col("is_canceled"), F.col("is_changed")
    bucket = (
        F.when(canceled == 1, "cancelled")
        .when((canceled == 0) & (changed == 1), "changed only")
        .when((canceled == 0) & (changed == 0), "neither")
    )
    return (
        df.select(flag, bucket.alias("disruption"))
        .where(F.col("disruption").isNotNull())
        .groupBy("disruption")
        .agg(F.count(F.lit(1)).alias("orders"), F.avg(flag).alias("contact_rate"))
    )


def count_histogram(counts: DataFrame, cap: int = 10) -> DataFrame:
    """How many keys have 1, 2, ... contacts; ``cap`` stands for that many or more."""
    return (
        counts.groupBy(clip(F.col("n_contacts"), hi=F.lit(cap)).cast("bigint").alias("n_contacts"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("n_contacts")
    )


def winsor_mean(df: DataFrame, group: str, col: str, q: float = 0.95) -> DataFrame:
    """Mean per group after clipping to [0, q-quantile of the clipped values]; NULLs are ignored."""
    values = df.where(F.col(group).isNotNull()).select(
        group, clip(F.col(col), lo=F.lit(0.0)).alias("__x")
    )
    found = capped_sums(values, "__x", q, [group])
    return found.select(
        group,
        F.col("n_rows").alias("n"),
        F.try_divide("capped_sum", F.when(F.col("n") > 0, F.col("n"))).alias("winsor_mean"),
    )


def _largest(level: str) -> Column:
    """Aggregate over level counts ``n``: the most frequent level, ties in name order."""
    size = F.struct((-F.col("n")).alias("n"), F.col(level).alias("level"))
    return F.min(F.when(F.col(level).isNotNull(), size))


def _tile(metric: str, label: Column, value: Column) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        label.cast("string").alias("label"),
        value.cast("double").alias("value"),
    )


def kpis(orders: DataFrame, contacts: DataFrame, channel: str = "phone") -> DataFrame:
    """The headline tiles, computed: (metric, label, value).

    Shares of channels and categories are over all contacts, the brand share is over
    all orders. Each table is counted per level once, all tiles come from the counts.
    """
    brands = orders.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("contacted").alias("hits")
    )
    no_label = F.lit(None)
    brand = _largest("brand")
    order_tiles = brands.agg(
        F.array(
            _tile("contact_rate", no_label, share(F.sum("hits"), F.sum("n"))),
            _tile("largest_brand", brand["level"], share(-brand["n"], F.sum("n"))),
        ).alias("tiles")
    )
    dims = ["errand_channel", "errand_category", "order_id"]
    levels = (
        contacts.select(*[F.col(c).cast("string").alias(c) for c in dims])
        .unpivot([], dims, "dimension", "level")
        .groupBy("dimension", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top, total = _largest("level"), F.sum("n")
    named = F.coalesce(F.sum(F.when(F.col("level") == channel, F.col("n"))), F.lit(0))
    top_share_of = share(-top["n"], total)
    repeats = F.avg(F.when(F.col("level").isNotNull(), (F.col("n") >= 2).cast("int")))
    contact_tiles = levels.groupBy("dimension").agg(
        F.when(
            F.col("dimension") == "errand_channel",
            F.array(
                _tile("top_channel", top["level"], top_share_of),
                _tile("channel_share", F.lit(channel), share(named, total)),
            ),
        )
        .when(
            F.col("dimension") == "errand_category",
            F.array(_tile("top_category", top["level"], top_share_of)),
        )
        .otherwise(F.array(_tile("repeat_share", no_label, repeats)))
        .alias("tiles")
    )
    return order_tiles.unionByName(contact_tiles.select("tiles")).select(F.inline("tiles"))


def key_stats(
    orders: DataFrame, contacts: DataFrame, scored: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The closing summary as rows (metric, value); ``scored`` adds the ROC area of each model."""
    canceled, changed, hit = F.col("is_canceled"), F.col("is_changed"), F.col("contacted")
    row = orders.agg(
        F.avg(hit).alias("contact_rate"),
        F.avg(F.when(canceled == 1, hit)).alias("cancelled_contact_rate"),
        F.avg(F.when(changed == 1, hit)).alias("changed_contact_rate"),
        F.avg(F.when((canceled == 0) & (changed == 0), hit)).alias("normal_contact_rate"),
        F.count(F.lit(1)).cast("double").alias("orders"),
    )
    totals = contacts.agg(F.count(F.lit(1)).cast("double")).scalar()
    repeat = contacts_per_order(contacts).agg(F.avg((F.col("n_contacts") >= 2).cast("int"))).scalar()
    wide = row.withColumn("real_contacts", totals).withColumn("repeat_share", repeat)
    for name, table in (scored or {}).items():
        wide = wide.withColumn(f"{name}_auc", roc_auc(table).select("roc_auc").scalar())
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns]
    return wide.select(F.inline(F.array(*pairs)))


def lorenz(counts: DataFrame) -> DataFrame:
    """Lorenz curve of contacts over keys, one point per distinct count.

    Between two points the curve is straight, so no point is lost. N contacts allow
    fewer than sqrt(2 N) distinct counts: the window over them stays small.
    """
    histogram = counts.groupBy("n_contacts").agg(F.count(F.lit(1)).alias("orders"))
    upto = Window.orderBy("n_contacts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("n_contacts").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    volume = F.col("n_contacts") * F.col("orders")
    return histogram.select(
        "n_contacts",
        "orders",
        share(F.sum("orders").over(upto), F.sum("orders").over(everything)).alias("cum_orders"),
        share(F.sum(volume).over(upto), F.sum(volume).over(everything)).alias("cum_contacts"),
    )
