"""Every operator as a named query over a folder of star-schema tables.

Each query is a function of (session, folder). ``B``, ``C`` and ``L`` build the
three inputs all of them start from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactscope.functions.keys import decode_base36, encode_base36, row_hash
from contactscope.functions.numeric import clip, log_amount, relabel, round_even
from contactscope.functions.timeparts import parse_ts, plus_days
from contactscope.operators import (
    audit_state,
    bursts,
    clean,
    curves,
    features,
    link,
    metrics,
    mix,
    models,
    quality,
    ranking,
    rates,
    repeat,
    sampling,
    segments,
    sketches,
    stats,
)
from contactscope.operators.silhouette import euclidean_silhouette
from contactscope.sources import schemas, star
from contactscope.sources.layout import stored_by_order
from contactscope.sources.tables import malformed_rows, materialise, read_table, replace_periods, shared_folder, write_result

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The rate dimensions of the descriptive report.
DIMENSIONS = ["brand", "device", "journey_type_id", "customer_group_type", "client_entry_type"]

MIN_VOLUME = 50  # the test tables are smaller than what the default of 500 is meant for
NAMED = ["cat0", "cat1", "cat2", "cat3", "cat4"]
SEED = 42


def query(func: Query) -> Query:
    QUERIES[func.__name__] = func
    return func


def B(spark: SparkSession, folder: str) -> DataFrame:
    return star.bookings(spark, folder)


def K(spark: SparkSession, folder: str) -> DataFrame:
    return star.booking_core(spark, folder)


def C(spark: SparkSession, folder: str) -> DataFrame:
    return clean.real_contacts(star.contacts(spark, folder))


def L(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings with contact counts and flag."""
    return link.with_contact_counts(B(spark, folder), C(spark, folder))


def LK(spark: SparkSession, folder: str) -> DataFrame:
    """The same without customer columns."""
    return link.with_contact_counts(K(spark, folder), C(spark, folder))


# Scans and sinks ------------------------------------------------------------


@query
def table_shape(spark, folder):
    return quality.table_shape(
        read_table(spark, f"{folder}/orders.parquet", spark.read.parquet(f"{folder}/orders.parquet").schema)
    )


@query
def csv_round_trip(spark, folder):
    """Bookings written as CSV and read back with the declared schema."""
    core = K(spark, folder).select(
        "order_id", "order_created_at", "order_amount", "is_canceled", "partner"
    )
    out = f"{shared_folder(spark).rstrip('/')}/contactscope"
    target = write_result(core, f"bookings-{uuid.uuid4().hex}", out, "csv")
    back = read_table(spark, target, schemas.ORDERS, "csv")
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("order_id").alias("sum_id"),
        F.count("order_amount").alias("amounts"),
        F.max("order_amount").alias("max_amount"),
        F.min("order_created_at").alias("first_time"),
        F.max("order_created_at").alias("last_time"),
        F.sum("is_canceled").alias("canceled"),
        F.count("partner").alias("partners"),
    )


@query
def key_stats(spark, folder):
    return rates.key_stats(LK(spark, folder), C(spark, folder))


# Projection, parsing, cleaning ----------------------------------------------


@query
def parse_times(spark, folder):
    """Lenient parsing of text times, some of them unreadable."""
    text = F.when(F.col("order_id") % 11 == 0, "n/a").otherwise(
        F.col("order_created_at").cast("string")
    )
    return K(spark, folder).select("order_id", parse_ts(text).alias("parsed"))


@query
def parse_times_strict(spark, folder):
    text = F.col("order_created_at").cast("string")
    return K(spark, folder).select("order_id", parse_ts(text, strict=True).alias("parsed"))


@query
def decode_keys(spark, folder):
    return C(spark, folder).select("errand_id", "order_number", "order_id")


@query
def decode_keys_strict(spark, folder):
    """Encode the booking id and decode it in strict mode."""
    text = encode_base36(F.col("order_id"))
    return K(spark, folder).select(
        "order_id", text.alias("text"), decode_base36(text, strict=True).alias("decoded")
    )


@query
def decode_audit(spark, folder):
    return link.decode_audit(C(spark, folder), K(spark, folder))


@query
def test_flag_audit(spark, folder):
    return quality.test_flag_audit(star.contacts(spark, folder))


@query
def in_window(spark, folder):
    real = C(spark, folder)
    return clean.in_window(real, K(spark, folder), 30).select("errand_id", "created", "order_id")


@query
def clipped_values(spark, folder):
    return LK(spark, folder).select(
        "order_id",
        clip(F.col("order_amount"), lo=F.lit(0.0)).alias("amount_floor"),
        clip(F.col("n_contacts"), F.lit(0), F.lit(3)).cast("bigint").alias("contacts_capped"),
    )


@query
def fill_missing(spark, folder):
    df = B(spark, folder).select("order_id", "client_entry_type", "partner", "order_amount")
    return clean.fill_zero(
        clean.fill_unknown(df, ["client_entry_type", "partner"]), ["order_amount"]
    )


@query
def scalar_functions(spark, folder):
    """Log amount, missing flag, label mapping, added days, rounding."""
    return K(spark, folder).select(
        "order_id",
        F.round(log_amount(F.col("order_amount")), 9).alias("order_amt_log"),
        F.col("partner").isNull().cast("int").alias("is_direct"),
        relabel(F.col("is_canceled"), {0: "Not Cancelled", 1: "Cancelled"}).alias("cancel_label"),
        plus_days(F.col("order_created_at"), 90).alias("plus_90"),
        F.to_date("order_created_at").alias("created_date"),
        round_even(F.col("order_amount") / 1000, 3).alias("amount_k"),
    )


# Data quality ---------------------------------------------------------------


@query
def null_counts(spark, folder):
    return quality.null_counts(B(spark, folder))


@query
def null_counts_contacts(spark, folder):
    return quality.null_counts(C(spark, folder))


@query
def duplicate_keys(spark, folder):
    return quality.duplicate_keys(K(spark, folder), "order_id").unionByName(
        quality.duplicate_keys(star.contacts(spark, folder), "errand_id")
    )


@query
def threshold_audit(spark, folder):
    df = B(spark, folder).select("order_amount", "revenue")
    rules = quality.financial_rules()
    rules["amount_above_400k"] = F.col("order_amount") > 400_000
    return quality.threshold_audit(df, rules)


@query
def date_coverage(spark, folder):
    return quality.date_coverage(
        {
            "orders": (K(spark, folder), "order_created_at"),
            "contacts": (star.contacts(spark, folder), "created"),
        }
    )


@query
def test_share_by_month(spark, folder):
    return quality.flag_share_by_period(star.contacts(spark, folder), "is_test_errand", "created")


# Links ----------------------------------------------------------------------


@query
def contact_flag(spark, folder):
    return link.flag_contacted(K(spark, folder), C(spark, folder)).select("order_id", "contacted")


@query
def contact_counts(spark, folder):
    return LK(spark, folder).select("order_id", "n_contacts", "contacted")


@query
def contacts_per_order(spark, folder):
    return link.contacts_per_order(C(spark, folder))


@query
def link_contacts(spark, folder):
    linked = link.link_contacts(C(spark, folder), K(spark, folder))
    return linked.select("errand_id", "order_id", "order_created_at", "hours_to_contact")


def _layout(spark, folder):
    """Orders and contacts of the folder stored by order, the contacts in two batches by time."""
    contacts = C(spark, folder)
    early = F.coalesce(F.year("created") < 1995, F.lit(False))
    name = f"layout_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/contactscope/{name}"
    batches = [("early", contacts.where(early)), ("late", contacts.where(~early))]
    return stored_by_order(spark, name, path, K(spark, folder), batches, 16)


@query
def layout_counts(spark, folder):
    """Contact counts over tables stored by order."""
    return _layout(spark, folder).contact_counts().select("order_id", "n_contacts", "contacted")


@query
def layout_links(spark, folder):
    """Linked contacts over tables stored by order."""
    linked = _layout(spark, folder).link_contacts()
    return linked.select("errand_id", "order_id", "order_created_at", "hours_to_contact")


@query
def uncontacted_orders(spark, folder):
    return link.uncontacted(K(spark, folder), C(spark, folder)).select("order_id", "device")


@query
def uncontacted_share(spark, folder):
    return link.uncontacted_share(K(spark, folder), C(spark, folder))


@query
def orphan_contacts(spark, folder):
    return link.orphan_contacts(C(spark, folder), K(spark, folder)).select(
        "errand_id", "order_number", "order_id"
    )


# Rates ----------------------------------------------------------------------


@query
def contact_baseline(spark, folder):
    return rates.contact_baseline(LK(spark, folder), C(spark, folder))


@query
def top_share(spark, folder):
    return rates.top_share(C(spark, folder))


@query
def rate_by_dimension(spark, folder):
    return rates.ranked_rates(rates.rate_by(L(spark, folder), DIMENSIONS))


@query
def rate_by_factor_baseline(spark, folder):
    linked = L(spark, folder)
    overall = linked.agg(F.avg("contacted")).scalar()
    return rates.rate_by(linked, list(stats.CHI2_FACTORS), overall=overall)


@query
def extreme_levels(spark, folder):
    return rates.extreme_levels(rates.rate_by(L(spark, folder), DIMENSIONS))


@query
def rate_grid(spark, folder):
    return rates.rate_grid(LK(spark, folder))


@query
def rate_grid_wide(spark, folder):
    return rates.rate_grid_wide(LK(spark, folder))


@query
def disruption_rates(spark, folder):
    return rates.disruption_rates(LK(spark, folder))


@query
def count_histogram(spark, folder):
    return rates.count_histogram(link.contacts_per_order(C(spark, folder)), cap=5)


@query
def winsor_mean(spark, folder):
    out = rates.winsor_mean(B(spark, folder), "brand", "order_amount")
    return out.withColumn("winsor_mean", F.round("winsor_mean", 4))


@query
def median_amount(spark, folder):
    return ranking.median(K(spark, folder), "order_amount")


@query
def quantiles_by_group(spark, folder):
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    out = ranking.quantiles(B(spark, folder), "order_amount", probs, ["customer_group_type"])
    return out.select("customer_group_type", "n", *[F.round(p, 6).alias(p) for p in probs])


@query
def kpis(spark, folder):
    return rates.kpis(L(spark, folder), C(spark, folder))


@query
def lorenz(spark, folder):
    return rates.lorenz(link.contacts_per_order(C(spark, folder)))


# Volumes and mixes ----------------------------------------------------------


@query
def weekly_volume(spark, folder):
    return mix.volume_by_period(C(spark, folder), "week")


@query
def weekly_rate(spark, folder):
    return mix.rate_by_period(LK(spark, folder), "week")


@query
def top_categories(spark, folder):
    return mix.top_categories(C(spark, folder), "errand_category", 6)


@query
def keep_top_categories(spark, folder):
    kept = mix.keep_top(C(spark, folder), "errand_category", 4)
    return kept.select("errand_id", "errand_category")


@query
def monthly_mix_all_denom(spark, folder):
    by_month = mix.with_period(C(spark, folder), "created", "month")
    return mix.category_mix(by_month, "month", "errand_category", k=6, denom="all")


@query
def channel_mix_top_denom(spark, folder):
    return mix.category_mix(
        C(spark, folder), "errand_channel", "errand_category", k=8, denom="top"
    )


@query
def channel_share_quarter(spark, folder):
    return mix.channel_share(C(spark, folder))


@query
def share_within_channel(spark, folder):
    cells = mix.cell_counts(C(spark, folder), "errand_channel", "errand_category")
    return mix.share_within(cells, "errand_channel")


@query
def cross_counts_wide(spark, folder):
    return mix.cross_counts(C(spark, folder), "errand_channel", "errand_category")


@query
def contingency(spark, folder):
    return mix.contingency(L(spark, folder), "customer_group_type", "contacted")


@query
def monthly_named_other(spark, folder):
    return mix.monthly_volume(C(spark, folder), NAMED)


@query
def linkage_report(spark, folder):
    return mix.linkage_report(K(spark, folder), C(spark, folder))


@query
def out_of_window_span(spark, folder):
    return mix.out_of_window_span(C(spark, folder), K(spark, folder), 30)


@query
def out_of_window_categories(spark, folder):
    late = mix.out_of_window(C(spark, folder), K(spark, folder), 30)
    return mix.top_categories(late, "errand_category", 6)


@query
def head_tail(spark, folder):
    ranking_table = rates.rate_by(LK(spark, folder), ["currency"])
    return mix.head_tail(ranking_table, 8, 4, "contact_rate", "level").select(
        "level", "orders", "contact_rate"
    )


@query
def union_results(spark, folder):
    linked = LK(spark, folder)
    return mix.union_results(
        {
            "disruption": rates.disruption_rates(linked),
            "grid": rates.rate_grid(linked),
            "baseline": rates.contact_baseline(linked, C(spark, folder)),
        }
    )


# Time to first contact and repeats ------------------------------------------


@query
def first_contact(spark, folder):
    return link.first_contact(C(spark, folder), K(spark, folder))


@query
def ttfc_hours(spark, folder):
    return curves.ttfc(C(spark, folder), K(spark, folder))


@query
def ttfc_summary(spark, folder):
    return curves.ttfc_summary(curves.ttfc(C(spark, folder), K(spark, folder)))


@query
def order_statistic(spark, folder):
    """The value at position int(0.99 n) of the sorted times to first contact."""
    times = curves.ttfc(C(spark, folder), K(spark, folder))
    return ranking.order_statistics(
        times, "hours_ttfc", {"value": lambda n: F.floor(n.cast("double") * F.lit(0.99))}
    )


@query
def survival_curve(spark, folder):
    out = curves.survival_curve(curves.ttfc(C(spark, folder), K(spark, folder)))
    return out.withColumn("hours", F.round("hours", 6))


@query
def survival_steps(spark, folder):
    return curves.survival_steps(curves.ttfc(C(spark, folder), K(spark, folder)))


@query
def ttfc_histogram(spark, folder):
    out = curves.ttfc_histogram(curves.ttfc(C(spark, folder), K(spark, folder)), bins=50)
    return out.select("bin", F.round("left_edge", 6).alias("left_edge"), "n",
                      F.round("median_days", 6).alias("median_days"))


@query
def amount_histogram(spark, folder):
    out = curves.equal_width_hist(K(spark, folder), "order_amount", 50)
    return out.select("bin", F.round("left_edge", 4).alias("left_edge"),
                      F.round("right_edge", 4).alias("right_edge"), "n")


@query
def repeat_by_first(spark, folder):
    per_order = repeat.repeat_per_order(C(spark, folder))
    return repeat.repeat_by_first(per_order, MIN_VOLUME).orderBy(
        F.desc("repeat_rate"), "first_category"
    )


@query
def overall_repeat(spark, folder):
    return repeat.overall_repeat(repeat.repeat_per_order(C(spark, folder)))


# Samples and tests ----------------------------------------------------------


@query
def sample_n(spark, folder):
    return sampling.sample_n(K(spark, folder), 5_000, SEED, ["order_id"]).select(
        "order_id", "order_amount"
    )


@query
def sample_per_group(spark, folder):
    out = sampling.sample_per_group(K(spark, folder), "device", 200, SEED, ["order_id"])
    return out.select("order_id", "device")


@query
def stratified_split(spark, folder):
    out = sampling.stratified_split(LK(spark, folder), "contacted", 0.2, SEED, ["order_id"])
    return out.select("order_id", "contacted", "is_test")


def _chi2(factor: str) -> Query:
    def run(spark, folder):
        orders = L if factor == "customer_group_type" else LK
        out = stats.chi2_test(orders(spark, folder), factor)
        return out.select(
            "factor",
            F.round("statistic", 4).alias("statistic"),
            "dof",
            "n",
            F.round("p_value", 6).alias("p_value"),
        )

    return run


for _factor in [*stats.CHI2_FACTORS, "currency"]:
    QUERIES[f"chi2_{_factor}"] = _chi2(_factor)


def _rounded_test(df: DataFrame) -> DataFrame:
    df = df.drop("rank_biserial")
    return df.withColumn("z", F.round("z", 6)).withColumn("p_value", F.round("p_value", 6))


@query
def chi2_three_outcomes(spark, folder):
    """An outcome with three levels, over those that occur."""
    wide = LK(spark, folder).withColumn("times", F.least("n_contacts", F.lit(2)))
    out = stats.chi2_test(wide, "journey_type_id", "times")
    return out.select("factor", F.round("statistic", 4).alias("statistic"), "dof", "n",
                      F.round("p_value", 6).alias("p_value"))


@query
def effect_sizes(spark, folder):
    """Cramer's V of each factor, and the rank-biserial correlation of the value split."""
    linked = L(spark, folder)
    tables = stats.chi2_tests(linked, list(stats.CHI2_FACTORS)).select(
        "factor", F.lit("cramers_v").alias("measure"), F.round("cramers_v", 6).alias("value")
    )
    ranks = stats.value_test(linked).select(
        F.lit("value_group").alias("factor"), F.lit("rank_biserial").alias("measure"),
        F.round("rank_biserial", 6).alias("value"),
    )
    return tables.unionByName(ranks)


@query
def contact_flag_in_window(spark, folder):
    """The label of in-window modelling: contacted within the time the orders cover."""
    recent = clean.in_window(C(spark, folder), K(spark, folder))
    linked = link.with_contact_counts(K(spark, folder), recent)
    return linked.select("order_id", "n_contacts", "contacted")


@query
def csv_quoted_text(spark, folder):
    """Texts with quotes, separators and line breaks, written as CSV and read back."""
    hard = F.concat(F.lit('A "'), F.col("device"), F.lit('", b\n'), F.coalesce("partner", F.lit("-")))
    core = K(spark, folder).select("order_id", hard.alias("device"))
    out = f"{shared_folder(spark).rstrip('/')}/contactscope"
    target = write_result(core, f"quoted-{uuid.uuid4().hex}", out, "csv")
    back = read_table(spark, target, schemas.ORDERS, "csv")
    return back.select("order_id", F.replace("device", F.lit("\n"), F.lit("|")).alias("device")).join(
        F.broadcast(malformed_rows(spark, target)), how="cross"
    ).drop("n_rows")


@query
def repeat_chi2(spark, folder):
    out = stats.repeat_chi2(repeat.repeat_per_order(C(spark, folder)), min_volume=MIN_VOLUME)
    return out.select("factor", F.round("statistic", 4).alias("statistic"), "dof", "n",
                      F.round("p_value", 6).alias("p_value"))


@query
def mwu_value_split(spark, folder):
    return _rounded_test(stats.value_test(LK(spark, folder)))


@query
def mwu_family_single(spark, folder):
    return _rounded_test(stats.family_single_test(L(spark, folder)))


@query
def mwu_amount_contacted(spark, folder):
    """A continuous value: amounts of contacted against other orders."""
    return _rounded_test(stats.mann_whitney(LK(spark, folder), "order_amount", "contacted", 1, 0))


@query
def propensity(spark, folder):
    out = stats.propensity(L(spark, folder))
    return out.withColumn("statistic", F.round("statistic", 4)).withColumn(
        "p_value", F.round("p_value", 6)
    )


# Features and metrics -------------------------------------------------------


def _scored(spark, folder) -> DataFrame:
    """Contact flag with a score that is a fixed rule of the key and the cancellation."""
    points = (row_hash(SEED, "order_id") % 997).cast("double") / 997.0
    score = points + F.col("is_canceled").cast("double") * 0.25
    return LK(spark, folder).select(
        "order_id", F.col("contacted").alias("label"), score.alias("score")
    )


@query
def booking_features(spark, folder):
    out = features.booking_features(L(spark, folder))
    return out.withColumn("order_amt_log", F.round("order_amt_log", 9))


@query
def label_encode(spark, folder):
    base = features.booking_features(L(spark, folder)).select("order_id", *features.CATEGORICAL)
    coded = features.label_encode(base, features.CATEGORICAL)
    return coded.select("order_id", *[f"{c}_enc" for c in features.CATEGORICAL])


@query
def class_weights(spark, folder):
    out = features.balanced_weights(LK(spark, folder))
    return out.select("order_id", "contacted", F.round("weight", 9).alias("weight"))


@query
def standardise(spark, folder):
    cols = ["order_amount", "n_contacts", "is_changed"]
    out = features.standardise(clean.fill_zero(LK(spark, folder), cols), cols)
    return out.select("order_id", *[F.round(f"{c}_std", 6).alias(f"{c}_std") for c in cols])


@query
def roc_auc(spark, folder):
    return metrics.roc_auc(_scored(spark, folder)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query
def average_precision(spark, folder):
    out = metrics.average_precision(_scored(spark, folder))
    return out.select(F.round("average_precision", 9).alias("average_precision"))


@query
def roc_curve(spark, folder):
    return metrics.roc_curve(_scored(spark, folder))


@query
def sketch_ranks(spark, folder):
    """Amount quantiles by customer group from sketches by group and month, written and merged, and whether their exact
    ranks are as near as the sketch promises."""
    bookings = B(spark, folder)
    path = f"{shared_folder(spark).rstrip('/')}/contactscope/sketches-{uuid.uuid4().hex}"
    monthly = sketches.sketch_by_period(bookings, ["customer_group_type"], "order_created_at", "order_amount", "month")
    replace_periods(monthly, path, "period")
    by_group = sketches.merged(spark.read.parquet(path), ["customer_group_type"])
    found = sketches.quantiles(by_group, ["customer_group_type"], [0.05, 0.25, 0.5, 0.9, 0.99])
    ranks = sketches.exact_ranks(found, bookings, ["customer_group_type"], "order_amount")
    error = 2 * sketches.rank_error()
    near = (F.col("share_below") <= F.col("prob") + error) & (F.col("share_upto") >= F.col("prob") - error)
    return ranks.select("customer_group_type", "prob", "n", near.alias("rank_is_near"))


@query
def audit_by_period(spark, folder):
    """The audit of all contacts from states kept by month; the latest months are written again, as a rerun would."""
    raw = star.contacts(spark, folder).withColumn("order_id", decode_base36(F.col("order_number")))
    raw = materialise(raw, "audit-contacts")  # four states are made of it: one join of the tables, not four
    rules = {
        "test": F.col("is_test_errand") == 1,
        "undecodable": F.col("order_number").isNotNull() & F.col("order_id").isNull(),
    }
    columns = ["order_number", "errand_category", "errand_channel"]
    path = f"{shared_folder(spark).rstrip('/')}/contactscope/audit-{uuid.uuid4().hex}"
    latest = F.year("created") >= 1998
    for part in (raw, raw.where(latest)):
        replace_periods(audit_state.period_state(part, "created", columns, rules, "month"), f"{path}/state", "period")
        replace_periods(audit_state.key_state(part, "created", "errand_id", "month"), f"{path}/keys", "period")
    return audit_state.audit(spark.read.parquet(f"{path}/state"), spark.read.parquet(f"{path}/keys"))


@query
def test_burst(spark, folder):
    """The weeks in which test records cluster most, over all windows of weeks, with a p-value between 0 and 1."""
    found = bursts.burst(star.contacts(spark, folder), "is_test_errand", "created", "week", draws=199)
    p = F.col("p_value")
    return found.select("first_period", "last_period", "n", "flagged", F.round("ratio", 6).alias("ratio"),
                        ((p > 0) & (p <= 1)).alias("p_is_share"))


@query
def roc_corners(spark, folder):
    """The ROC curve without the points on its straight stretches."""
    return metrics.roc_curve(_scored(spark, folder), drop_straight=True)


@query
def pr_curve(spark, folder):
    return metrics.pr_curve(_scored(spark, folder))


# Models and segments --------------------------------------------------------


@query
def assemble(spark, folder):
    """The feature vector, as its length and sum."""
    vector = vector_to_array("features")
    out = features.assemble(features.booking_features(L(spark, folder)), features.NUMERIC)
    return out.select(
        "order_id",
        F.size(vector).alias("size"),
        F.round(F.aggregate(vector, F.lit(0.0), lambda a, b: a + b), 6).alias("total"),
    )


@query
def kmeans_check(spark, folder):
    """Rows assigned, rows that lie nearer to the centre of another cluster, the profile's rows, and whether the
    fit's squared distance and centres are those of the assigned rows."""
    table = segments.segment_table(L(spark, folder))
    model = segments.kmeans(table, segments.FINAL_K, segments.FINAL_RESTARTS)
    clustered = segments.assign(model, table)
    x = vector_to_array("features")
    far = [
        F.aggregate(
            F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0), lambda a, b: a + b,
        )
        for centre in model.clusterCenters()
    ]
    own = F.element_at(F.array(*far), F.col("cluster") + 1)
    profile = segments.cluster_profile(clustered).agg(F.sum("n")).scalar()
    return clustered.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.least(*far) < own - 1e-9).alias("nearer_elsewhere"),
        (F.abs(F.sum(own) / F.lit(model.trainingCost) - 1) < 1e-9).cast("int").alias("cost_agrees"),
    ).withColumn("profile_rows", profile)


@query
def logistic_check(spark, folder):
    """Held-out rows and scores in [0, 1] per label, and whether the fit is at its optimum.

    There the penalised gradient vanishes: it is compared with the mean absolute feature values.
    """
    table = models.training_table(L(spark, folder))
    train = table.where("is_test = 0")
    model = models.fit_logistic(train)
    scored = models.score(model, table.where("is_test = 1"))
    beta = [*model.coefficients.toArray().tolist()]
    p = vector_to_array("probability")[1]
    x = vector_to_array("features")
    miss = F.col("weight") * (p - F.col("label"))
    row = model.transform(train).agg(
        F.sum("weight").alias("w"),
        *[F.sum(miss * x[i]).alias(f"g{i}") for i in range(len(beta))],
        *[F.sum(F.col("weight") * F.abs(x[i])).alias(f"a{i}") for i in range(len(beta))],
    ).first()
    reg = 1.0 / (models.INVERSE_PENALTY * row["w"])
    worst = max(abs(row[f"g{i}"] / row["w"] + reg * b) / max(row[f"a{i}"] / row["w"], 1e-9) for i, b in enumerate(beta))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("score").between(0, 1)).alias("in_range"),
    ).withColumn("at_optimum", F.lit(int(worst < 1e-2)))


@query
def forest_check(spark, folder):
    """Held-out rows, scores in [0, 1], the ten largest importances, and the sum of all."""
    table = models.training_table(L(spark, folder))
    model = models.fit_forest(table.where("is_test = 0"))
    scored = models.score(model, table.where("is_test = 1"))
    top = models.top_importances(model, table).agg(F.count(F.lit(1))).scalar()
    total = models.importances(model, table).agg(F.round(F.sum("importance"), 6)).scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").between(0, 1)).alias("in_range")
    ).withColumns({"top": top, "total_importance": total})


@query
def compare_check(spark, folder):
    """The comparison of a scored table, and whether its area is that of the rank test."""
    table = _scored(spark, folder)
    ranks = stats.mann_whitney(table, "score", "label", 1, 0)
    area = ranks.select(F.col("statistic") / (F.col("n_x").cast("double") * F.col("n_y"))).scalar()
    out = models.compare_models({"rule": table}).withColumn("__area", area)
    return out.select(
        "model",
        "positives",
        "negatives",
        F.round("roc_auc", 9).alias("roc_auc"),
        F.round("average_precision", 9).alias("average_precision"),
        (F.abs(F.col("roc_auc") - F.col("__area")) < 1e-9).cast("int").alias("same_auc"),
    )


@query
def logistic_scores(spark, folder):
    table = models.training_table(L(spark, folder))
    return models.score(models.fit_logistic(table.where("is_test = 0")), table.where("is_test = 1"))


@query
def forest_scores(spark, folder):
    table = models.training_table(L(spark, folder))
    return models.score(models.fit_forest(table.where("is_test = 0")), table.where("is_test = 1"))


@query
def top_importances(spark, folder):
    table = models.training_table(L(spark, folder))
    return models.top_importances(models.fit_forest(table.where("is_test = 0")), table)


@query
def model_compare(spark, folder):
    return models.compare_models(models.fit_contact_models(L(spark, folder)).scored())


@query
def kmeans_scan(spark, folder):
    return segments.silhouette_scan(segments.segment_table(L(spark, folder)))


@query
def kmeans_profile(spark, folder):
    table = segments.segment_table(L(spark, folder))
    model = segments.kmeans(table, segments.FINAL_K, segments.FINAL_RESTARTS)
    return segments.name_segments(segments.cluster_profile(segments.assign(model, table)))


def _ruled(spark, folder) -> DataFrame:
    """Orders with a cluster number given by a rule, so that results can be recomputed."""
    rule = (F.col("is_canceled") * 2 + F.col("is_changed")).cast("int")
    return L(spark, folder).withColumn("cluster", rule)


@query
def silhouette(spark, folder):
    """Silhouette of the ruled clusters in the plane of log amount and contacts, with plain distances, over all orders."""
    table = _ruled(spark, folder).withColumn("order_amt_log", log_amount(F.col("order_amount")))
    table = features.assemble(table, ["order_amt_log", "n_contacts"])
    found = euclidean_silhouette(table, tolerance=1e-4)
    return found.select(
        "n", F.round("silhouette", 3).alias("silhouette"), (F.col("high") - F.col("low") <= 2e-4).alias("is_known")
    )


def _rounded_profile(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 9) for c in [*segments.PROFILE_RATES, "avg_contacts"]}
    return df.withColumns({**rounded, "avg_order_amt": F.round("avg_order_amt", 4)})


@query
def cluster_profile(spark, folder):
    return _rounded_profile(segments.cluster_profile(_ruled(spark, folder)))


@query
def segment_names(spark, folder):
    named = segments.name_segments(segments.cluster_profile(_ruled(spark, folder)))
    return named.select("cluster", "segment", "n")


@query
def profile_long(spark, folder):
    return segments.profile_long(_rounded_profile(segments.cluster_profile(_ruled(spark, folder))))


@query
def segment_points(spark, folder):
    out = segments.segment_points(_ruled(spark, folder), n=200)
    return out.withColumn("order_amt_log", F.round("order_amt_log", 9))
