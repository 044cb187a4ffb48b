"""The three reports as named result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactscope.operators import (
    clean,
    curves,
    link,
    metrics,
    mix,
    models,
    quality,
    rates,
    repeat,
    sampling,
    segments,
    stats,
)
from contactscope.plans.linked import Linked

# Rate dimensions, the categories shown by name, and the seed.
DIMENSIONS = ["brand", "device", "journey_type_id", "customer_group_type", "client_entry_type"]
NAMED_CATEGORIES = [
    "Cancellation / refund",
    "Rebooking",
    "Schedule change",
    "Document & travel info",
    "Change of name & passenger info",
]
SEED = 42


def descriptive(data: Linked) -> dict[str, DataFrame]:
    """Audit, baseline, time, mix and linkage tables."""
    orders, contacts, counts = data.orders, data.contacts, data.counts
    audit = {
        "shape": quality.table_shape(data.raw_orders)
        .withColumn("table", F.lit("orders"))
        .unionByName(quality.table_shape(data.raw_contacts).withColumn("table", F.lit("contacts"))),
        "nulls_orders": quality.null_counts(data.raw_orders),
        "nulls_contacts": quality.null_counts(data.raw_contacts),
        "duplicates": quality.duplicate_keys(data.raw_orders, "order_id").unionByName(
            quality.duplicate_keys(data.raw_contacts, "errand_id")
        ),
        "financial": quality.threshold_audit(data.raw_orders, quality.financial_rules()),
        "test_contacts": quality.test_flag_audit(data.raw_contacts),
        "test_share_by_month": quality.flag_share_by_period(
            data.raw_contacts, "is_test_errand", "created"
        ),
        "coverage": quality.date_coverage(
            {
                "orders": (data.raw_orders, "order_created_at"),
                "contacts": (data.raw_contacts, "created"),
            }
        ),
        "decode": link.decode_audit(contacts, data.raw_orders),
    }
    baseline = {
        "baseline": rates.contact_baseline(orders, contacts),
        "top_share": rates.top_share(contacts),
        "rate_by_dimension": rates.ranked_rates(rates.rate_by(orders, DIMENSIONS)),
        "lorenz": rates.lorenz(counts),
        "count_histogram": rates.count_histogram(counts),
    }
    time = {
        "weekly_volume": mix.volume_by_period(contacts, "week").orderBy("period"),
        "weekly_rate": mix.rate_by_period(orders, "week").orderBy("period"),
        "monthly_mix": mix.category_mix(
            mix.with_period(contacts, "created", "month"), "month", "errand_category", 6, "all"
        ),
        "channel_mix": mix.category_mix(contacts, "errand_channel", "errand_category", 8, "top"),
        "channel_share": mix.channel_share(contacts, "quarter"),
    }
    linkage = {
        "linkage": mix.linkage_report(orders.drop("contacted", "n_contacts"), contacts),
        "out_of_window_span": mix.out_of_window_span(contacts, orders),
        "out_of_window_categories": mix.top_categories(
            mix.out_of_window(contacts, orders), "errand_category", 6
        ),
    }
    return {**audit, **baseline, **time, **linkage}


def statistics(
    data: Linked, test_rows: int | None = None, min_volume: int = 500
) -> dict[str, DataFrame]:
    """Tests, time to first contact and repeat contacts.

    The propensity tests run over all orders; ``test_rows`` takes a sample instead.
    """
    orders, contacts = data.orders, data.contacts
    tested = orders
    if test_rows is not None:
        tested = sampling.sample_n(orders, test_rows, SEED, ["order_id"])
    overall = orders.agg(F.avg("contacted")).scalar()
    times = curves.ttfc(contacts, orders)
    per_order = repeat.repeat_per_order(contacts)
    ranking = repeat.repeat_by_first(per_order, min_volume)
    return {
        "propensity": stats.propensity(tested),
        "rate_by_factor": rates.rate_by(tested, list(stats.CHI2_FACTORS), overall=overall),
        "ttfc_summary": curves.ttfc_summary(times),
        "survival_curve": curves.survival_curve(times),
        "survival_steps": curves.survival_steps(times),
        "ttfc_histogram": curves.ttfc_histogram(times),
        "repeat_by_first": ranking.orderBy(F.desc("repeat_rate"), "first_category"),
        "repeat_top_12": ranking.orderBy(F.desc("repeat_rate"), "first_category").limit(12),
        "repeat_overall": repeat.overall_repeat(per_order),
        "repeat_chi2": stats.repeat_chi2(per_order, min_volume=min_volume),
        "family_single": stats.family_single_test(orders),
    }


def modelling(
    data: Linked, rows: int | None = models.FIT_ROWS, in_window_only: bool = False
) -> dict[str, DataFrame]:
    """Contact prediction: model comparison, curves and feature importances.

    ``in_window_only`` labels an order by contacts within the order window.
    """
    orders = data.orders
    if in_window_only:
        recent = clean.in_window(data.contacts, data.raw_orders)
        orders = link.with_contact_counts(data.raw_orders, recent)
    fitted = models.fit_contact_models(orders, rows)
    scored = fitted.scored()
    return {
        "model_compare": models.compare_models(scored),
        "importances": models.importances(fitted.forest, orders),
        "top_importances": models.top_importances(fitted.forest, orders),
        "roc_curves": mix.union_results({n: metrics.roc_curve(d) for n, d in scored.items()}, "model"),
        "pr_curves": mix.union_results({n: metrics.pr_curve(d) for n, d in scored.items()}, "model"),
    }


def segmentation(data: Linked, rows: int | None = None) -> dict[str, DataFrame]:
    """Silhouettes, the four-cluster profile with names, and plot data."""
    table = segments.segment_table(data.orders, rows)
    model = segments.kmeans(table, segments.FINAL_K, segments.FINAL_RESTARTS)
    clustered = segments.assign(model, table)
    profile = segments.cluster_profile(clustered)
    return {
        "silhouettes": segments.silhouette_scan(table),
        "segments": segments.name_segments(profile),
        "segment_points": segments.segment_points(clustered),
        "segment_rates": segments.profile_long(profile),
    }


def executive(data: Linked, named: Sequence[str] = NAMED_CATEGORIES) -> dict[str, DataFrame]:
    """Headline volume, tiles and root causes."""
    return {
        "monthly_volume": mix.monthly_volume(data.contacts, named),
        "kpis": rates.kpis(data.orders, data.contacts),
        "rate_grid": rates.rate_grid(data.orders),
        "disruption_rates": rates.disruption_rates(data.orders),
        "key_stats": rates.key_stats(data.orders, data.contacts),
    }
