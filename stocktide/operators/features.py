"""Leak-safe feature blocks for a four-week target, all targets in one job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.calendar import non_bf_calendar_weeks, target_calendar
from stocktide.functions.numbers import clean_numeric, flag, median3, positive, safe_ratio
from stocktide.operators.score import KEY, around_targets

WINDOWS = (4, 8, 13, 26, 52)
# Feature names in model order.
CATEGORICAL_FEATURES = (
    "category_norm", "product_family_v2", "category_signal_status", "revenue_bucket", "volume_bucket", "stock_signal_status",
    "stock_coverage_bucket", "supplier_stock_signal_status", "supplier_stock_coverage_bucket", "combined_stock_coverage_bucket",
)
NUMERIC_FEATURES = (
    "target_month", "target_quarter", "target_weekofyear", "target_is_q4", "target_is_black_friday_month", "target_is_bf_window",
    "target_is_pre_bf_4w", "target_is_post_bf_4w", "target_days_from_bf_start", "target_days_from_bf_end", "horizon_bf_overlap_days",
    "horizon_pre_bf_overlap_days", "horizon_post_bf_overlap_days", "trailing_52w_revenue", "trailing_52w_pos_units", "active_weeks_52",
    "active_4w_windows_52", "avg_units_per_4w_52", "revenue_rank", "cumulative_revenue_share", "active_months_104", "top3_month_unit_share_104",
    "monthly_cv_104", "active_years_104", "recurring_active_months_104", "last4", "roll8_mean", "roll13_mean", "seasonal52", "median_naive",
    "last4_to_roll13", "seasonal_to_roll13", "median_to_avg4w", "pos_units_4w", "pos_units_8w", "pos_units_13w", "pos_units_26w", "pos_units_52w",
    "revenue_4w", "revenue_13w", "revenue_52w", "transactions_4w", "transactions_13w", "avg_unit_price_13w", "avg_unit_price_52w",
    "return_rate_units_13w", "return_rate_units_52w", "avg_discount_4w", "avg_discount_13w", "max_discount_13w", "campaign_txn_4w",
    "campaign_txn_13w", "campaign_txn_52w", "campaign_units_4w", "campaign_units_13w", "campaign_units_52w", "campaign_revenue_13w",
    "campaign_revenue_52w", "non_bf_campaign_txn_13w", "non_bf_campaign_units_13w", "campaign_unit_share_13w", "campaign_revenue_share_13w",
    "non_bf_campaign_unit_share_13w", "campaign_active_weeks_13w", "campaign_active_weeks_52w", "product_program_txn_13w",
    "avg_campaign_discount_13w", "max_campaign_discount_13w", "days_since_campaign_txn", "days_since_bf_txn", "bf_txn_4w", "bf_txn_8w", "bf_txn_13w",
    "bf_units_4w", "bf_units_8w", "bf_units_13w", "non_bf_pos_units_4w", "non_bf_pos_units_13w", "non_bf_pos_units_4w_equiv",
    "non_bf_pos_units_13w_equiv", "bf_unit_share_4w", "bf_unit_share_13w", "bf_txn_share_4w", "bf_txn_share_13w", "last4_non_bf_to_last4",
    "post_bf_last4_bf_unit_share", "post_bf_last4_to_roll13", "online_txn_share_13w", "outlet_txn_share_13w", "max_stores_selling_13w",
    "max_hyperstores_selling_13w", "max_smaller_stores_selling_13w", "stock_prev_month_qty", "stock_two_months_before_qty",
    "stock_three_months_before_qty", "stock_trailing_3m_avg", "stock_trailing_3m_trend", "stock_months_observed_6m", "stock_zero_months_6m",
    "stock_observed_prev_month", "in_stock_before_target", "likely_stockout_before_target", "stock_coverage_ratio_4w", "stock_coverage_ratio_13w",
    "chain_stock_qty_before_target", "stores_with_stock_prev_month", "hyperstores_with_stock_prev_month", "stores_observed_stock_prev_month",
    "no_sales_despite_stock", "sales_with_low_ending_stock", "supplier_stock_prev_month_qty", "supplier_stock_two_months_before_qty",
    "supplier_stock_three_months_before_qty", "supplier_stock_trailing_3m_avg", "supplier_stock_trailing_3m_trend",
    "supplier_stock_months_observed_6m", "supplier_stock_zero_months_6m", "supplier_stock_observed_prev_month", "supplier_available_before_target",
    "supplier_stock_value_prev_month", "supplier_stock_value_trailing_3m_avg", "suppliers_observed_prev_month", "suppliers_with_stock_prev_month",
    "combined_stock_prev_month_qty", "combined_stock_observed_prev_month", "combined_stock_coverage_ratio_4w", "combined_stock_coverage_ratio_13w",
    "store_or_supplier_available_before_target", "likely_true_stockout_before_target", "no_sales_despite_combined_stock",
    "sales_with_low_combined_stock",
)


def window_features(weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """15 aggregates for each of five look-backs in one pass over the weekly table."""
    w = around_targets(weekly, targets, max(WINDOWS))
    bf = F.col("bf_transaction_count") > 0
    ok = lambda c: F.when(F.col(c).between(0, 1), F.col(c))
    sums = {
        "pos_units": F.col("pos_units"), "revenue": F.col("net_revenue"), "gross_units": F.col("gross_units"),
        "returned_units": F.col("returned_units"), "transactions": F.col("num_transactions"), "bf_txn": F.col("bf_transaction_count"),
        "bf_units": F.when(bf, F.col("pos_units")), "non_bf_pos_units": F.when(~bf, F.col("pos_units")),
        "online_txn": F.col("online_transaction_count"), "outlet_txn": F.col("outlet_transaction_count"),
    }
    tops = {"max_discount": ok("max_discount_pct"), "max_stores_selling": F.col("num_stores_selling"),
            "max_hyperstores_selling": F.col("num_hyperstores_selling"), "max_smaller_stores_selling": F.col("num_smaller_stores_selling")}
    aggs = []
    for k in WINDOWS:
        near = lambda c: F.when(F.col("age") <= k, c)
        aggs += [F.coalesce(F.sum(near(c)).cast("double"), F.lit(0.0)).alias(f"{n}_{k}w") for n, c in sums.items()]
        aggs += [F.coalesce(F.max(near(c)).cast("double"), F.lit(0.0)).alias(f"{n}_{k}w") for n, c in tops.items()]
        aggs.append(F.coalesce(F.avg(near(ok("avg_discount_pct"))), F.lit(0.0)).alias(f"avg_discount_{k}w"))
    return w.groupBy(*KEY).agg(*aggs)


def target_dim(labels: DataFrame) -> DataFrame:
    """Calendar columns of every target start in ``labels``."""
    t = F.col("target_start")
    return labels.select("target_start").distinct().select(
        "target_start", *[x.alias(n) for n, x in target_calendar(t).items()],
        *[non_bf_calendar_weeks(t, k).alias(f"non_bf_calendar_weeks_{k}w") for k in WINDOWS])


def window_ratios(df: DataFrame) -> DataFrame:
    """Price, return rate, channel and campaign shares of the look-backs; needs ``target_dim``."""
    c, out = F.col, {}
    for k in ("13w", "52w"):
        out[f"avg_unit_price_{k}"] = safe_ratio(c(f"revenue_{k}"), c(f"pos_units_{k}"))
        out[f"return_rate_units_{k}"] = safe_ratio(c(f"returned_units_{k}"), c(f"gross_units_{k}"))
        out[f"online_txn_share_{k}"] = safe_ratio(c(f"online_txn_{k}"), c(f"transactions_{k}"))
        out[f"outlet_txn_share_{k}"] = safe_ratio(c(f"outlet_txn_{k}"), c(f"transactions_{k}"))
    for k in (4, 13):
        out[f"bf_unit_share_{k}w"] = safe_ratio(c(f"bf_units_{k}w"), c(f"pos_units_{k}w"))
        out[f"bf_txn_share_{k}w"] = safe_ratio(c(f"bf_txn_{k}w"), c(f"transactions_{k}w"))
        out[f"non_bf_pos_units_{k}w_equiv"] = safe_ratio(
            c(f"non_bf_pos_units_{k}w"), c(f"non_bf_calendar_weeks_{k}w")) * 4
    return df.withColumns(out)


def campaign_history_features(weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Campaign lines, units, revenue and discounts before the target, product programs left out."""
    w = around_targets(weekly, targets, 52)
    on = lambda k, name: F.coalesce(F.sum(F.when(F.col("age") <= k, F.col(name))).cast("double"), F.lit(0.0))
    weeks = lambda k: F.count(F.when((F.col("age") <= k) & (F.col("promo_txn") > 0), 1)).cast("double")
    since = lambda name: F.coalesce(F.datediff("target_start", F.max(name)).cast("double"), F.lit(999.0))
    g = w.groupBy(*KEY).agg(
        *[on(k, "promo_txn").alias(f"campaign_txn_{k}w") for k in (4, 13, 52)],
        *[on(k, "promo_units").alias(f"campaign_units_{k}w") for k in (4, 13, 52)],
        *[on(k, "promo_revenue").alias(f"campaign_revenue_{k}w") for k in (13, 52)],
        on(13, "fresh_txn").alias("non_bf_campaign_txn_13w"), on(13, "fresh_units").alias("non_bf_campaign_units_13w"),
        weeks(13).alias("campaign_active_weeks_13w"), weeks(52).alias("campaign_active_weeks_52w"),
        on(13, "program_txn").alias("product_program_txn_13w"),
        safe_ratio(on(13, "promo_discount_sum"), on(13, "promo_discount_n")).alias("avg_campaign_discount_13w"),
        F.coalesce(F.max(F.when(F.col("age") <= 13, F.col("promo_discount_max"))), F.lit(0.0)).alias("max_campaign_discount_13w"),
        since("last_promo_date").alias("days_since_campaign_txn"), since("last_bf_date").alias("days_since_bf_txn"))
    return g


#: Last week (by age before the target) of each band that weekly rows are added up in; every look-back is a union of bands. Band 0 is the horizon.
BANDS = (0, 4, 8, 13, 26, 48, 52)


def history_blocks(weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Naive forecasts, look-backs, campaign history and actuals of every target from one unfolding of the weekly table.

    A weekly row goes once to every target it lies near. Plain sums per (target,
    sku, band of ages) combine before the shuffle, so a key has at most seven rows
    after it, and all look-backs are sums over bands. Columns are those of
    ``naive_wide``, ``window_features``, ``campaign_history_features`` and
    ``actuals_4w``; keys without history have zeros.
    """
    c = F.col
    w = around_targets(weekly, targets, max(WINDOWS), 4)
    band = F.lit(BANDS[-1])
    for last in reversed(BANDS[:-1]):
        band = F.when(c("age") <= last, last).otherwise(band)
    bf, ok = c("bf_transaction_count") > 0, lambda n: F.when(c(n).between(0, 1), c(n))
    sums = {
        "pos_units": c("pos_units"), "revenue": c("net_revenue"), "gross_units": c("gross_units"), "returned_units": c("returned_units"),
        "transactions": c("num_transactions"), "bf_txn": c("bf_transaction_count"), "bf_units": F.when(bf, c("pos_units")),
        "non_bf_pos_units": F.when(~bf, c("pos_units")), "online_txn": c("online_transaction_count"), "outlet_txn": c("outlet_transaction_count"),
    }
    tops = {"max_discount": ok("max_discount_pct"), "max_stores_selling": c("num_stores_selling"), "max_hyperstores_selling": c("num_hyperstores_selling"),
            "max_smaller_stores_selling": c("num_smaller_stores_selling")}
    campaign = {n: c(n) for n in ("promo_txn", "promo_units", "promo_revenue", "fresh_txn", "fresh_units", "program_txn", "promo_discount_sum", "promo_discount_n")}
    campaign["promo_weeks"] = F.when(c("promo_txn") > 0, 1)
    shares = {"discount_sum": ok("avg_discount_pct"), "discount_n": F.when(ok("avg_discount_pct").isNotNull(), 1)}
    actual = {
        "actual_pos_units_4w": c("pos_units"), "actual_net_units_4w": c("net_units"), "actual_net_revenue_4w": c("net_revenue"),
        "negative_unit_weeks": F.when(c("net_units") < 0, 1), "bf_txn_count": c("bf_transaction_count"), "bf_observed_txn_count": c("bf_observed_transaction_count"),
        "bf_inferred_txn_count": c("bf_inferred_transaction_count"), "campaign_observed_txn_count": c("campaign_lines"),
        "unknown_campaign_label_txn_count": c("unknown_label_lines"),
    }
    back, ahead = c("age") >= 1, c("age") <= 0
    bands = w.groupBy(*KEY, band.alias("band")).agg(
        *[F.sum(x).alias(f"s_{n}") for n, x in (sums | campaign | shares).items()], *[F.max(x).alias(f"m_{n}") for n, x in tops.items()],
        F.max("promo_discount_max").alias("m_promo_discount"), *[F.max(F.when(back, c(n))).alias(n) for n in ("last_promo_date", "last_bf_date")],
        *[F.sum(F.when(ahead, x)).alias(n) for n, x in actual.items()])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    near = lambda k, n: F.when((c("band") >= 1) & (c("band") <= k), c(n))
    total = lambda k, n: zero(F.sum(near(k, f"s_{n}")).cast("double"))
    since = lambda n: F.coalesce(F.datediff("target_start", F.max(n)).cast("double"), F.lit(999.0))
    g = bands.groupBy(*KEY).agg(
        total(4, "pos_units").alias("last4"), (total(8, "pos_units") / 8 * 4).alias("roll8_mean"), (total(13, "pos_units") / 13 * 4).alias("roll13_mean"),
        zero(F.sum(F.when(c("band") == 52, c("s_pos_units")))).alias("seasonal52"),
        *[total(k, n).alias(f"{n}_{k}w") for k in WINDOWS for n in sums],
        *[zero(F.max(near(k, f"m_{n}")).cast("double")).alias(f"{n}_{k}w") for k in WINDOWS for n in tops],
        *[zero(F.sum(near(k, "s_discount_sum")) / F.nullif(F.sum(near(k, "s_discount_n")), F.lit(0))).alias(f"avg_discount_{k}w") for k in WINDOWS],
        *[total(k, f"promo_{n}").alias(f"campaign_{n}_{k}w") for n, ks in (("txn", (4, 13, 52)), ("units", (4, 13, 52)), ("revenue", (13, 52))) for k in ks],
        total(13, "fresh_txn").alias("non_bf_campaign_txn_13w"), total(13, "fresh_units").alias("non_bf_campaign_units_13w"),
        total(13, "promo_weeks").alias("campaign_active_weeks_13w"), total(52, "promo_weeks").alias("campaign_active_weeks_52w"),
        total(13, "program_txn").alias("product_program_txn_13w"),
        safe_ratio(total(13, "promo_discount_sum"), total(13, "promo_discount_n")).alias("avg_campaign_discount_13w"),
        zero(F.max(near(13, "m_promo_discount"))).alias("max_campaign_discount_13w"),
        since("last_promo_date").alias("days_since_campaign_txn"), since("last_bf_date").alias("days_since_bf_txn"),
        *[F.sum(n).alias(n) for n in actual])
    return g.withColumn("median_naive", median3(c("last4"), c("roll13_mean"), c("seasonal52")))


#: Columns of ``history_blocks`` that are known only after the horizon.
ACTUALS = ("actual_pos_units_4w", "actual_net_units_4w", "actual_net_revenue_4w", "negative_unit_weeks", "bf_txn_count", "bf_observed_txn_count", "bf_inferred_txn_count",
           "campaign_observed_txn_count", "unknown_campaign_label_txn_count")


def recent_demand() -> Column:
    return F.col("pos_units_13w") / 13 * 4


def availability_features(df: DataFrame) -> DataFrame:
    """Coverage ratios and stock-position flags from the joined blocks."""
    c = F.col
    r4 = recent_demand()
    low = F.greatest(F.lit(1.0), r4 * 0.5)
    sold = c("pos_units_13w") > 0
    seen, seen_sup = c("stock_observed_prev_month") == 1, c("supplier_stock_observed_prev_month") == 1
    q, s = c("stock_prev_month_qty"), c("supplier_stock_prev_month_qty")
    both, any_seen = q + s, seen | seen_sup
    out = df.withColumns({
        "stock_coverage_ratio_4w": safe_ratio(q, r4),
        "stock_coverage_ratio_13w": safe_ratio(q, c("pos_units_13w")),
        "no_sales_despite_stock": flag((q > 0) & ~sold),
        "sales_with_low_ending_stock": flag(sold & seen & (q <= low)),
        "combined_stock_prev_month_qty": both,
        "combined_stock_observed_prev_month": flag(any_seen),
        "combined_stock_coverage_ratio_4w": safe_ratio(both, r4),
        "combined_stock_coverage_ratio_13w": safe_ratio(both, c("pos_units_13w")),
        "store_or_supplier_available_before_target": flag((q > 0) | (s > 0)),
        "likely_true_stockout_before_target": flag(sold & any_seen & (~seen | (q <= low)) & seen_sup & (s <= low)),
        "no_sales_despite_combined_stock": flag((both > 0) & ~sold),
        "sales_with_low_combined_stock": flag(sold & any_seen & (both <= low)),
    })
    return out.withColumn("combined_stock_coverage_bucket", (
        F.when(c("combined_stock_observed_prev_month") == 0, "missing")
        .when(c("likely_true_stockout_before_target") == 1, "likely_stockout")
        .when(c("store_or_supplier_available_before_target") == 1, "available")
        .when(c("combined_stock_prev_month_qty") <= 0, "observed_zero").otherwise("observed_unclear")))


def population_filter(labels: DataFrame, population: str = "headline", rank_limit: int | None = None) -> DataFrame:
    if population not in ("headline", "business_target", "all"):
        raise ValueError("population must be headline, business_target or all")
    out = labels if population == "all" else labels.where(F.col(f"{population}_eligible") == 1)
    return out if rank_limit is None else out.where(F.col("revenue_rank") <= rank_limit)


def feature_matrix(labels: DataFrame, history: DataFrame, stock: DataFrame, supplier: DataFrame, actuals: bool = True) -> DataFrame:
    """Join the blocks on (target_start, sku_id); every block is hashed on that key, so exchanges are shared.

    ``history`` is what ``history_blocks`` gives; without ``actuals`` its columns of the horizon are left out.
    """
    df = labels
    for block in (history, stock, supplier):
        df = df.join(block, KEY, "left")
    zero = [n for b in (history, stock, supplier) for n, t in b.dtypes if t in ("double", "bigint", "int")]
    df = df.fillna(999.0, ["days_since_campaign_txn", "days_since_bf_txn"]).fillna(0, [z for z in zero if not z.startswith("days_since")])
    df = df.fillna("missing", ["stock_signal_status", "stock_coverage_bucket", "supplier_stock_signal_status", "supplier_stock_coverage_bucket"])
    c = F.col
    # one row per target start asked for
    df = window_ratios(df.join(F.broadcast(target_dim(labels)), "target_start"))
    df = df.withColumns({
        "last4_to_roll13": safe_ratio(c("last4"), c("roll13_mean")),
        "seasonal_to_roll13": safe_ratio(c("seasonal52"), c("roll13_mean")),
        "median_to_avg4w": safe_ratio(c("median_naive"), c("avg_units_per_4w_52")),
        "campaign_unit_share_13w": safe_ratio(c("campaign_units_13w"), c("pos_units_13w")),
        "campaign_revenue_share_13w": safe_ratio(c("campaign_revenue_13w"), c("revenue_13w")),
        "non_bf_campaign_unit_share_13w": safe_ratio(c("non_bf_campaign_units_13w"), c("pos_units_13w")),
        "last4_non_bf_to_last4": safe_ratio(c("non_bf_pos_units_4w"), c("pos_units_4w")),
    })
    df = df.withColumns({
        "post_bf_last4_bf_unit_share": c("target_is_post_bf_4w") * c("bf_unit_share_4w"),
        "post_bf_last4_to_roll13": c("target_is_post_bf_4w") * c("last4_to_roll13"),
    })
    df = availability_features(df)
    extra = ["regime", "headline_eligible", "business_target_eligible", "scoring_policy"]
    return df.select(
        *KEY, *extra, *[clean_numeric(c(n)).alias(n) for n in NUMERIC_FEATURES],
        *[F.coalesce(c(n), F.lit("unknown")).alias(n) for n in CATEGORICAL_FEATURES], *(ACTUALS if actuals else ()))


def feature_matrix_audit(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("target_start").agg(
        F.count(F.lit(1)).alias("skus"), F.count(F.when(F.col("actual_pos_units_4w") >= 4, 1)).alias("scored_rows"),
        F.sum("actual_pos_units_4w").alias("actual_units"), F.avg("stock_observed_prev_month").alias("store_stock_share"),
        F.avg("supplier_stock_observed_prev_month").alias("supplier_stock_share"),
        F.avg("combined_stock_observed_prev_month").alias("combined_stock_share"))


def headline_or_proxy(labels: DataFrame | None, weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Headline skus of every target when labels exist, else skus with steady sales over the year before it."""
    if labels is not None:
        return labels.where((F.col("headline_eligible") == 1) & F.col("target_start").isin(targets)).select(*KEY)
    w = around_targets(weekly, targets, 52)
    g = w.groupBy(*KEY).agg(
        F.count(F.when(F.col("pos_units") > 0, 1)).alias("active_weeks"), F.sum("pos_units").alias("units"),
        F.sum("net_revenue").alias("revenue"))
    return g.where((F.col("active_weeks") >= 12) & (F.col("units") >= 26) & (F.col("revenue") > 0))
