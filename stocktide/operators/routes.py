"""Route labels of the feature matrix and masks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.operators.labels import lookup

# Routes in order with their reason, signal status and scoring policy.
ROUTES = (
    ("stock_constrained", "observed prior stock is low/zero versus recent demand; not a sellability gate", "observed",
     "low_stock_position_context_quantity"),
    ("bf_campaign_sensitive", "BF/pre-BF/post-BF calendar or BF-contaminated recent history", "inferred",
     "campaign_sensitive_quantity"),
    ("seasonal_active", "seasonal SKU appears active for the target period", "inferred", "seasonal_active_quantity"),
    ("seasonal_quiet", "seasonal SKU appears outside active demand period", "inferred", "seasonal_quiet_phantom_reactivation"),
    ("dormant_or_reactivation", "mostly dormant SKU with recent or seasonal reactivation evidence", "inferred",
     "reactivation_detection"),
    ("sparse_intermittent", "low occurrence / high zero-week-share demand pattern", "inferred", "intermittent_sale_then_quantity"),
    ("lifecycle_decline", "recent demand is materially below rolling demand and seasonal analog", "inferred",
     "lifecycle_decline_quantity"),
    ("available_regular", "positive stock position observed with recurring demand signal; SKU may still sell without this stock",
     "observed", "stock_position_regular_quantity"),
    ("proxy_available_regular", "recurring demand signal with no hard stock-position constraint", "proxy",
     "proxy_stock_position_regular_quantity"),
    ("availability_unknown", "insufficient reliable pre-target signal", "unknown", "low_stock_position_confidence_quantity"),
)
REGULAR_ROUTES = ("available_regular", "proxy_available_regular")
ROUTE_COLUMNS = ("primary_route", "route_reason", "route_signal_status", "scoring_policy_routed", "intermittency_bucket",
                 "stock_position_confidence", "calendar_route_context", "sku_bf_contamination_context",
                 "zero_week_share_52", "avg_demand_interval_weeks_52")


def add_route_labels(matrix: DataFrame) -> DataFrame:
    """First matching route per row, with reason, status and the contexts beside it."""
    c = F.col
    r4 = c("pos_units_13w") / 13 * 4
    active, avg4, sold = c("active_weeks_52"), c("avg_units_per_4w_52"), c("pos_units_13w") > 0
    zero = 1 - F.least(F.greatest(active, F.lit(0)), F.lit(52)) / 52
    seen, stock = c("combined_stock_observed_prev_month") == 1, c("combined_stock_prev_month_qty")
    ample = F.greatest(F.lit(1.0), r4 * 0.75)
    available = seen & ((stock > ample) | (c("store_or_supplier_available_before_target") == 1)
                        | (c("supplier_stock_prev_month_qty") > ample))
    constrained = seen & (
        (c("likely_true_stockout_before_target") == 1) | ((stock <= F.greatest(F.lit(1.0), r4 * 0.5)) & sold)
        | (F.greatest("sales_with_low_ending_stock", "sales_with_low_combined_stock") == 1))
    unseen = ~seen & (F.greatest("stock_months_observed_6m", "supplier_stock_months_observed_6m") == 0)
    proxy = unseen & (active >= 24) & (avg4 >= 2) & (zero < 0.55)
    step = matrix.withColumns({
        "zero_week_share_52": zero,
        "avg_demand_interval_weeks_52": F.when(active > 0, 52 / active).otherwise(999.0),
        "intermittency_bucket": F.when((active >= 36) & (c("monthly_cv_104") < 0.70), "regular")
        .when((active >= 24) & (zero < 0.55), "moderately_intermittent")
        .when((active >= 10) & (zero < 0.80), "sparse_intermittent")
        .when(active > 0, "highly_intermittent").otherwise("dormant"),
        "stock_position_confidence": F.when(available, "observed_positive_stock_position")
        .when(constrained, "observed_low_stock_position").when(seen, "observed_unclear_stock_position")
        .when(proxy, "proxy_recurring_demand_no_stock_context").when(unseen, "stock_position_unobserved")
        .otherwise("stock_position_unknown"),
        "calendar_route_context": F.when(c("target_is_bf_window") == 1, "bf_window")
        .when(c("target_is_post_bf_4w") == 1, "post_bf_window").when(c("target_is_pre_bf_4w") == 1, "pre_bf_window")
        .when(c("horizon_bf_overlap_days") > 0, "horizon_overlaps_bf")
        .when(c("horizon_post_bf_overlap_days") > 0, "horizon_overlaps_post_bf").otherwise("normal_calendar"),
        "sku_bf_contamination_context": F.when(c("bf_unit_share_4w") >= 0.35, "recent_units_bf_contaminated")
        .when(c("bf_txn_share_13w") >= 0.20, "recent_transactions_bf_contaminated").otherwise("no_bf_contamination_signal"),
        "_constrained": constrained, "_available": available, "_proxy": proxy,
    })
    seasonal = (
        c("active_months_104").between(2, 7) & (c("top3_month_unit_share_104") >= 0.60) & (c("monthly_cv_104") >= 0.90)
        & (c("active_years_104") >= 2) & (c("recurring_active_months_104") >= 1))
    alive = (c("seasonal52") > 0) | sold
    sensitive = (c("calendar_route_context") != "normal_calendar") | (c("sku_bf_contamination_context") != "no_bf_contamination_signal")
    dormant = (active <= 4) & alive
    sparse = (c("intermittency_bucket").isin("sparse_intermittent", "highly_intermittent")
              | ((avg4 < 3) & (c("zero_week_share_52") >= 0.45))) & ~dormant
    decline = ((c("roll13_mean") >= 2) & (c("last4_to_roll13") < 0.50)
               & (c("seasonal52") <= F.greatest(F.lit(1.0), c("roll13_mean") * 0.50)) & ~seasonal)
    tests = (c("_constrained"), sensitive, seasonal & alive, seasonal, dormant, sparse, decline,
             c("_available") & ~sparse, c("_proxy") & ~sparse)
    route = F.lit(ROUTES[-1][0])
    for cond, r in reversed(list(zip(tests, ROUTES))):
        route = F.when(cond, r[0]).otherwise(route)
    step = step.withColumn("primary_route", route).drop("_constrained", "_available", "_proxy")
    return step.withColumns({
        "route_reason": lookup({r[0]: r[1] for r in ROUTES}, c("primary_route")),
        "route_signal_status": lookup({r[0]: r[2] for r in ROUTES}, c("primary_route")),
        "scoring_policy_routed": lookup({r[0]: r[3] for r in ROUTES}, c("primary_route")),
    })


def route_masks() -> dict[str, Column]:
    """Named row masks used by policies and candidates."""
    c = F.col
    positive_value = lambda name: F.coalesce(c(name), F.lit(0.0)) > 0
    is_one = lambda name: F.coalesce(c(name), F.lit(0.0)) == 1
    normal = c("calendar_route_context") == "normal_calendar"
    on_campaign_route = c("primary_route") == "bf_campaign_sensitive"
    regular = c("primary_route").isin(*REGULAR_ROUTES) & normal
    campaign = on_campaign_route | positive_value("campaign_txn_13w") | positive_value("bf_txn_13w")
    return {
        "regular": regular,
        "guarded_regular": regular & ~campaign,
        "supplier_available": (is_one("store_or_supplier_available_before_target") & is_one("combined_stock_observed_prev_month")
                               & normal & ~on_campaign_route),
        "campaign": campaign,
        "stock_constrained": c("primary_route") == "stock_constrained",
        "bf_calendar": ~normal | positive_value("bf_txn_13w"),
        "demand_regular": ((F.coalesce(c("active_weeks_52"), F.lit(0)) >= 24)
                           & (F.coalesce(c("avg_units_per_4w_52"), F.lit(0.0)) >= 2.0) & normal),
    }
