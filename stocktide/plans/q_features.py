"""Feature blocks, feature matrix and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktide.functions.calendar import non_bf_calendar_weeks, previous_months, target_calendar
from stocktide.operators import features as ft
from stocktide.operators import routes as rt
from stocktide.operators import score as sc
from stocktide.operators import stock as sk
from stocktide.plans import fixtures as fx
from stocktide.plans.fixtures import TARGETS
from stocktide.plans.oracle import BLOCKS
from stocktide.plans.q_core import chain, labels_of
from stocktide.plans.registry import query


def stock_tables(spark, d):
    return fx.stock_monthly_store(spark, d), sk.join_name_mapping(fx.supplier_stock_lines(spark, d), fx.sales_names(spark, d))


def matrix(spark, d):
    """Feature matrix of all targets, all skus."""
    weekly = chain(spark, d)
    store, sup = stock_tables(spark, d)
    return ft.feature_matrix(labels_of(spark, d), ft.history_blocks(weekly, TARGETS), sk.stock_features(store, TARGETS), sk.supplier_stock_features(sup, TARGETS))


def routed(spark, d):
    """Feature matrix with routes; policies, candidates and audits all read it."""
    return fx.shared(spark, d, "routed", lambda: rt.add_route_labels(matrix(spark, d)))


def rat(a, b):
    return f"CASE WHEN abs({b}) > 1e-9 THEN ({a}) / ({b}) ELSE 0 END"


# ---- comparison SQL -------------------------------------------------------
_W = []
for k in ft.WINDOWS:
    f = f"FILTER (week_start >= target_start - {7 * k})"
    fb = f"FILTER (week_start >= target_start - {7 * k} AND bf_transaction_count > 0)"
    fn = f"FILTER (week_start >= target_start - {7 * k} AND bf_transaction_count = 0)"
    for out, src in (("pos_units", "pos_units"), ("revenue", "net_revenue"), ("gross_units", "gross_units"), ("returned_units", "returned_units"),
                     ("transactions", "num_transactions"), ("bf_txn", "bf_transaction_count"), ("online_txn", "online_transaction_count"),
                     ("outlet_txn", "outlet_transaction_count")):
        _W.append(f"coalesce(CAST(sum({src}) {f} AS DOUBLE), 0) AS {out}_{k}w")
    _W.append(f"coalesce(sum(pos_units) {fb}, 0) AS bf_units_{k}w")
    _W.append(f"coalesce(sum(pos_units) {fn}, 0) AS non_bf_pos_units_{k}w")
    _W.append(f"coalesce(avg(avg_discount_pct) {f}, 0) AS avg_discount_{k}w")
    for out, src in (("max_discount", "max_discount_pct"), ("max_stores_selling", "num_stores_selling"),
                     ("max_hyperstores_selling", "num_hyperstores_selling"), ("max_smaller_stores_selling", "num_smaller_stores_selling")):
        _W.append(f"coalesce(CAST(max({src}) {f} AS DOUBLE), 0) AS {out}_{k}w")
BLOCKS["win0"] = f"""SELECT target_start, sku_id, {', '.join(_W)}
FROM wpos JOIN targets ON week_start >= target_start - 364 AND week_start < target_start GROUP BY ALL"""
WIN_COLS = [w.rsplit(" AS ", 1)[1] for w in _W]
BLOCKS["bfwin"] = """
SELECT target_start, make_date(year(target_start), 11, 3) AS s, make_date(year(target_start), 11, 24) AS e, target_start + 28 AS h FROM targets"""
BLOCKS["nonbf"] = """
SELECT target_start, k, CAST(count(*) FILTER (w + 7 <= make_date(year(w), 11, 3) OR w >= make_date(year(w), 11, 24)) AS DOUBLE) AS n FROM (
 SELECT target_start, k, target_start - CAST(7 * i AS INTEGER) AS w FROM (SELECT target_start, k, unnest(range(1, k + 1)) AS i
  FROM targets, (SELECT unnest([4, 8, 13, 26, 52]) AS k))) GROUP BY ALL"""
BLOCKS["nonbf_w"] = "SELECT target_start, " + ", ".join(f"max(n) FILTER (k = {k}) AS non_bf_calendar_weeks_{k}w" for k in ft.WINDOWS) + " FROM nonbf GROUP BY ALL"
BLOCKS["tcal"] = """
SELECT target_start, month(target_start)::DOUBLE AS target_month, quarter(target_start)::DOUBLE AS target_quarter,
 weekofyear(target_start)::DOUBLE AS target_weekofyear, (quarter(target_start) = 4)::DOUBLE AS target_is_q4,
 (month(target_start) = 11)::DOUBLE AS target_is_black_friday_month, (target_start >= s AND target_start < e)::DOUBLE AS target_is_bf_window,
 (target_start >= s - 28 AND target_start < s)::DOUBLE AS target_is_pre_bf_4w, (target_start >= e AND target_start < e + 28)::DOUBLE AS target_is_post_bf_4w,
 (target_start - s)::DOUBLE AS target_days_from_bf_start, (target_start - (e - 1))::DOUBLE AS target_days_from_bf_end,
 greatest(0, least(h, e) - greatest(target_start, s))::DOUBLE AS horizon_bf_overlap_days,
 greatest(0, least(h, s) - greatest(target_start, s - 28))::DOUBLE AS horizon_pre_bf_overlap_days,
 greatest(0, least(h, e + 28) - greatest(target_start, e))::DOUBLE AS horizon_post_bf_overlap_days FROM bfwin"""
_PROMO = "campaign_raw = 'SPRING'"
BLOCKS["camp0"] = f"""
SELECT target_start, sku_id, {', '.join(f"count(*) FILTER ({_PROMO} AND sale_date >= target_start - {7*k})::DOUBLE AS campaign_txn_{k}w" for k in (4, 13, 52))},
 {', '.join(f"coalesce(sum(greatest(net_units, 0)) FILTER ({_PROMO} AND sale_date >= target_start - {7*k}), 0) AS campaign_units_{k}w" for k in (4, 13, 52))},
 {', '.join(f"coalesce(sum(net_revenue) FILTER ({_PROMO} AND sale_date >= target_start - {7*k}), 0) AS campaign_revenue_{k}w" for k in (13, 52))},
 count(*) FILTER ({_PROMO} AND is_bf_campaign = 0 AND sale_date >= target_start - 91)::DOUBLE AS non_bf_campaign_txn_13w,
 coalesce(sum(greatest(net_units, 0)) FILTER ({_PROMO} AND is_bf_campaign = 0 AND sale_date >= target_start - 91), 0) AS non_bf_campaign_units_13w,
 {', '.join(f"count(DISTINCT CASE WHEN {_PROMO} AND sale_date >= target_start - {7*k} THEN week_start END)::DOUBLE AS campaign_active_weeks_{k}w" for k in (13, 52))},
 count(*) FILTER (campaign_raw = 'FABRO LINE' AND sale_date >= target_start - 91)::DOUBLE AS product_program_txn_13w,
 coalesce(avg(discount_pct) FILTER ({_PROMO} AND sale_date >= target_start - 91), 0) AS avg_campaign_discount_13w,
 coalesce(max(discount_pct) FILTER ({_PROMO} AND sale_date >= target_start - 91), 0) AS max_campaign_discount_13w,
 coalesce(target_start - max(sale_date) FILTER ({_PROMO}), 999)::DOUBLE AS days_since_campaign_txn,
 coalesce(target_start - max(sale_date) FILTER (is_bf_timing = 1), 999)::DOUBLE AS days_since_bf_txn
FROM txn_mixed JOIN targets ON sale_date >= target_start - 364 AND sale_date < target_start WHERE is_non_product = 0 GROUP BY target_start, sku_id"""
CAMP_COLS = ([f"campaign_txn_{k}w" for k in (4, 13, 52)] + [f"campaign_units_{k}w" for k in (4, 13, 52)]
             + ["campaign_revenue_13w", "campaign_revenue_52w", "non_bf_campaign_txn_13w", "non_bf_campaign_units_13w",
                "campaign_active_weeks_13w", "campaign_active_weeks_52w", "product_program_txn_13w", "avg_campaign_discount_13w",
                "max_campaign_discount_13w"])
BLOCKS["stock_m"] = """
SELECT sku_id, store_id, store_type, stock_month, sum(q) AS stock_qty, count(*) AS source_row_count FROM (
 SELECT DISTINCT sku_id, store_id, store_type, CAST(date_trunc('month', sale_date) AS DATE) AS stock_month, l_partkey,
  CAST((12 * month(sale_date) + 5 * l_partkey + 11 * c_nationkey) % 25 AS DOUBLE) AS q
 FROM txn_mixed WHERE store_type <> 'hybrid') GROUP BY ALL"""
BLOCKS["names_m"] = "SELECT DISTINCT upper(p_name) || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE ' ' || l_partkey END AS product_name_key, sku_id FROM txn_mixed"
BLOCKS["sup_m"] = """
SELECT upper(p_name) || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE ' ' || l_partkey END || CASE WHEN l_partkey % 7 = 0 THEN ' NEW' ELSE '' END AS product_name_key,
 'S' || l_suppkey AS supplier_key, CAST(date_trunc('month', sale_date) AS DATE) AS stock_month,
 CAST(sum(l_quantity) % 30 AS DOUBLE) AS supplier_stock_qty, sum(l_extendedprice) AS supplier_stock_value FROM txn_mixed GROUP BY ALL"""
BLOCKS["map_m"] = """
SELECT product_name_key, count(*) AS candidate_skus, CASE WHEN count(*) = 1 THEN min(sku_id) END AS sku_id,
 CASE WHEN count(*) = 1 THEN 'exact_unique' ELSE 'ambiguous' END AS mapping_confidence FROM names_m GROUP BY ALL"""
BLOCKS["sup_map"] = """
SELECT s.*, coalesce(candidate_skus, 0) AS candidate_skus, sku_id, coalesce(mapping_confidence, 'unmapped') AS mapping_confidence
FROM sup_m s LEFT JOIN map_m USING (product_name_key)"""
_LAG = "(year(target_start) - year(stock_month)) * 12 + month(target_start) - month(stock_month)"


def level_sql(pre, counts, value=False):
    v = (f", coalesce(sum(v) FILTER (lag = 1), 0) AS {pre}_value_prev_month, coalesce(sum(v) FILTER (lag <= 3), 0) / 3 AS {pre}_value_trailing_3m_avg" if value else "")
    return f"""SELECT *, ({pre}_prev_month_qty + {pre}_two_months_before_qty + {pre}_three_months_before_qty) / 3 AS {pre}_trailing_3m_avg,
 {pre}_prev_month_qty - ({pre}_prev_month_qty + {pre}_two_months_before_qty + {pre}_three_months_before_qty) / 3 AS {pre}_trailing_3m_trend
 FROM (SELECT target_start, sku_id, coalesce(sum(q) FILTER (lag = 1), 0) AS {pre}_prev_month_qty, coalesce(sum(q) FILTER (lag = 2), 0) AS {pre}_two_months_before_qty,
 coalesce(sum(q) FILTER (lag = 3), 0) AS {pre}_three_months_before_qty, count(*)::DOUBLE AS {pre}_months_observed_6m,
 count(*) FILTER (q <= 0)::DOUBLE AS {pre}_zero_months_6m, max(CASE WHEN lag = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS {pre}_observed_prev_month,
 {', '.join(f'coalesce(sum({c}) FILTER (lag = 1), 0)::DOUBLE AS {c}_prev_month' for c in counts)}{v} FROM m GROUP BY ALL)"""


BLOCKS["stk0"] = f"""
WITH m AS (SELECT target_start, sku_id, {_LAG} AS lag, sum(stock_qty) AS q, count(DISTINCT store_id) AS stores_observed_stock,
 count(DISTINCT store_id) FILTER (stock_qty > 0) AS stores_with_stock,
 count(DISTINCT store_id) FILTER (stock_qty > 0 AND store_type = 'hyperstore') AS hyperstores_with_stock
 FROM stock_m JOIN targets ON {_LAG} BETWEEN 1 AND 6 GROUP BY ALL)
{level_sql('stock', ['stores_observed_stock', 'stores_with_stock', 'hyperstores_with_stock'])}"""
BLOCKS["stk1"] = """
SELECT *, (stock_prev_month_qty > 0)::DOUBLE AS in_stock_before_target,
 (stock_observed_prev_month = 1 AND stock_prev_month_qty <= 0)::DOUBLE AS likely_stockout_before_target,
 stock_prev_month_qty AS chain_stock_qty_before_target, 'observed' AS stock_signal_status,
 CASE WHEN stores_observed_stock_prev_month >= 5 THEN 'broad_store_context' WHEN stores_observed_stock_prev_month >= 2 THEN 'partial_store_context'
  WHEN stores_observed_stock_prev_month >= 1 THEN 'single_store_context' ELSE 'missing_prev_month' END AS stock_coverage_bucket FROM stk0"""
BLOCKS["sup0"] = f"""
WITH m AS (SELECT target_start, sku_id, {_LAG} AS lag, sum(supplier_stock_qty) AS q, sum(supplier_stock_value) AS v,
 count(DISTINCT supplier_key) AS suppliers_observed, count(DISTINCT supplier_key) FILTER (supplier_stock_qty > 0) AS suppliers_with_stock
 FROM sup_map JOIN targets ON {_LAG} BETWEEN 1 AND 6 WHERE mapping_confidence = 'exact_unique' GROUP BY ALL)
{level_sql('supplier_stock', ['suppliers_observed', 'suppliers_with_stock'], True)}"""
BLOCKS["sup1"] = """
SELECT *, (supplier_stock_prev_month_qty > 0)::DOUBLE AS supplier_available_before_target, 'observed' AS supplier_stock_signal_status,
 CASE WHEN supplier_stock_observed_prev_month = 0 THEN 'history_no_prev_month' WHEN supplier_stock_prev_month_qty > 0 THEN 'positive_supplier_stock'
  ELSE 'zero_supplier_stock' END AS supplier_stock_coverage_bucket FROM sup0"""
STK_COLS = ["stock_prev_month_qty", "stock_two_months_before_qty", "stock_three_months_before_qty", "stock_trailing_3m_avg",
            "stock_trailing_3m_trend", "stock_months_observed_6m", "stock_zero_months_6m", "stock_observed_prev_month", "in_stock_before_target",
            "likely_stockout_before_target", "chain_stock_qty_before_target", "stores_with_stock_prev_month",
            "hyperstores_with_stock_prev_month", "stores_observed_stock_prev_month"]
SUP_COLS = [f"supplier_stock_{x}" for x in ("prev_month_qty", "two_months_before_qty", "three_months_before_qty", "trailing_3m_avg",
            "trailing_3m_trend", "months_observed_6m", "zero_months_6m", "observed_prev_month", "value_prev_month", "value_trailing_3m_avg")]
SUP_COLS += ["supplier_available_before_target", "suppliers_observed_prev_month", "suppliers_with_stock_prev_month"]
_CO = lambda cols, v=0: ", ".join(f"coalesce({c}, {v}) AS {c}" for c in cols)
BLOCKS["fm0"] = f"""
SELECT l.target_start, l.sku_id, regime, headline_eligible, business_target_eligible, scoring_policy, trailing_52w_revenue, trailing_52w_pos_units,
 active_weeks_52::DOUBLE AS active_weeks_52, active_4w_windows_52::DOUBLE AS active_4w_windows_52, avg_units_per_4w_52, coalesce(revenue_rank, 0)::DOUBLE AS revenue_rank, coalesce(cumulative_revenue_share, 0) AS cumulative_revenue_share,
 active_months_104::DOUBLE AS active_months_104, top3_month_unit_share_104, monthly_cv_104, active_years_104::DOUBLE AS active_years_104, recurring_active_months_104::DOUBLE AS recurring_active_months_104, category_norm, product_family_v2,
 category_signal_status, revenue_bucket, volume_bucket, n.last4, n.roll8_mean, n.roll13_mean, n.seasonal52, n.median_naive,
 {_CO(WIN_COLS)}, {_CO(CAMP_COLS)}, {_CO(['days_since_campaign_txn', 'days_since_bf_txn'], 999)}, {_CO(STK_COLS)}, {_CO(SUP_COLS)},
 {_CO(['stock_signal_status', 'stock_coverage_bucket', 'supplier_stock_signal_status', 'supplier_stock_coverage_bucket'], "'missing'")},
 t.* EXCLUDE (target_start), w.* EXCLUDE (target_start),
 actual_pos_units_4w, actual_net_units_4w, actual_net_revenue_4w, negative_unit_weeks, bf_txn_count, bf_observed_txn_count, bf_inferred_txn_count,
 campaign_observed_txn_count, unknown_campaign_label_txn_count
FROM labels_x l JOIN naive n USING (target_start, sku_id) LEFT JOIN win0 USING (target_start, sku_id) LEFT JOIN camp0 USING (target_start, sku_id)
LEFT JOIN stk1 USING (target_start, sku_id) LEFT JOIN sup1 USING (target_start, sku_id) JOIN tcal t USING (target_start) JOIN nonbf_w w USING (target_start)
JOIN actuals USING (target_start, sku_id)"""
BLOCKS["fm1"] = f"""
SELECT *, pos_units_13w / 13 * 4 AS r4, greatest(1, pos_units_13w / 13 * 4 * 0.5) AS lowq, stock_prev_month_qty + supplier_stock_prev_month_qty AS combined_stock_prev_month_qty,
 {rat('last4', 'roll13_mean')} AS last4_to_roll13, {rat('seasonal52', 'roll13_mean')} AS seasonal_to_roll13, {rat('median_naive', 'avg_units_per_4w_52')} AS median_to_avg4w,
 {', '.join(f"{rat(f'revenue_{k}', f'pos_units_{k}')} AS avg_unit_price_{k}, {rat(f'returned_units_{k}', f'gross_units_{k}')} AS return_rate_units_{k}" for k in ('13w', '52w'))},
 {rat('online_txn_13w', 'transactions_13w')} AS online_txn_share_13w, {rat('outlet_txn_13w', 'transactions_13w')} AS outlet_txn_share_13w,
 {', '.join(f"{rat(f'bf_units_{k}', f'pos_units_{k}')} AS bf_unit_share_{k}, {rat(f'bf_txn_{k}', f'transactions_{k}')} AS bf_txn_share_{k}, ({rat(f'non_bf_pos_units_{k}', f'non_bf_calendar_weeks_{k}')}) * 4 AS non_bf_pos_units_{k}_equiv" for k in ('4w', '13w'))},
 {rat('campaign_units_13w', 'pos_units_13w')} AS campaign_unit_share_13w, {rat('campaign_revenue_13w', 'revenue_13w')} AS campaign_revenue_share_13w,
 {rat('non_bf_campaign_units_13w', 'pos_units_13w')} AS non_bf_campaign_unit_share_13w, {rat('non_bf_pos_units_4w', 'pos_units_4w')} AS last4_non_bf_to_last4,
 (stock_observed_prev_month = 1 OR supplier_stock_observed_prev_month = 1)::DOUBLE AS combined_stock_observed_prev_month FROM fm0"""
BLOCKS["fm2"] = f"""
SELECT *, target_is_post_bf_4w * bf_unit_share_4w AS post_bf_last4_bf_unit_share, target_is_post_bf_4w * last4_to_roll13 AS post_bf_last4_to_roll13,
 {rat('stock_prev_month_qty', 'r4')} AS stock_coverage_ratio_4w, {rat('stock_prev_month_qty', 'pos_units_13w')} AS stock_coverage_ratio_13w,
 (stock_prev_month_qty > 0 AND pos_units_13w <= 0)::DOUBLE AS no_sales_despite_stock,
 (pos_units_13w > 0 AND stock_observed_prev_month = 1 AND stock_prev_month_qty <= lowq)::DOUBLE AS sales_with_low_ending_stock,
 {rat('combined_stock_prev_month_qty', 'r4')} AS combined_stock_coverage_ratio_4w, {rat('combined_stock_prev_month_qty', 'pos_units_13w')} AS combined_stock_coverage_ratio_13w,
 (stock_prev_month_qty > 0 OR supplier_stock_prev_month_qty > 0)::DOUBLE AS store_or_supplier_available_before_target,
 (pos_units_13w > 0 AND combined_stock_observed_prev_month = 1 AND (stock_observed_prev_month = 0 OR stock_prev_month_qty <= lowq)
  AND supplier_stock_observed_prev_month = 1 AND supplier_stock_prev_month_qty <= lowq)::DOUBLE AS likely_true_stockout_before_target,
 (combined_stock_prev_month_qty > 0 AND pos_units_13w <= 0)::DOUBLE AS no_sales_despite_combined_stock,
 (pos_units_13w > 0 AND combined_stock_observed_prev_month = 1 AND combined_stock_prev_month_qty <= lowq)::DOUBLE AS sales_with_low_combined_stock FROM fm1"""
BLOCKS["fmx"] = """
SELECT *, CASE WHEN combined_stock_observed_prev_month = 0 THEN 'missing' WHEN likely_true_stockout_before_target = 1 THEN 'likely_stockout'
 WHEN store_or_supplier_available_before_target = 1 THEN 'available' WHEN combined_stock_prev_month_qty <= 0 THEN 'observed_zero' ELSE 'observed_unclear' END
 AS combined_stock_coverage_bucket FROM fm2"""
ACT_D = "actual_pos_units_4w actual_net_units_4w actual_net_revenue_4w"
ACT_N = "negative_unit_weeks bf_txn_count bf_observed_txn_count bf_inferred_txn_count campaign_observed_txn_count unknown_campaign_label_txn_count"
FM_COLS = ["target_start", "sku_id", "regime", "headline_eligible", "business_target_eligible", "scoring_policy", *ft.NUMERIC_FEATURES,
           *ft.CATEGORICAL_FEATURES, *ACT_D.split(), *ACT_N.split()]
BLOCKS["rt0"] = """
SELECT *, 1 - least(active_weeks_52, 52) / 52 AS zs, combined_stock_observed_prev_month = 1 AS seen,
 active_months_104 BETWEEN 2 AND 7 AND top3_month_unit_share_104 >= 0.6 AND monthly_cv_104 >= 0.9 AND active_years_104 >= 2 AND recurring_active_months_104 >= 1 AS sea,
 seasonal52 > 0 OR pos_units_13w > 0 AS alive FROM fmx"""
BLOCKS["rt1"] = """
SELECT *, seen AND (combined_stock_prev_month_qty > greatest(1, 0.75 * r4) OR store_or_supplier_available_before_target = 1 OR supplier_stock_prev_month_qty > greatest(1, 0.75 * r4)) AS avail,
 seen AND (likely_true_stockout_before_target = 1 OR (combined_stock_prev_month_qty <= lowq AND pos_units_13w > 0) OR sales_with_low_ending_stock = 1 OR sales_with_low_combined_stock = 1) AS constr,
 NOT seen AND stock_months_observed_6m = 0 AND supplier_stock_months_observed_6m = 0 AS unseen,
 CASE WHEN active_weeks_52 >= 36 AND monthly_cv_104 < 0.7 THEN 'regular' WHEN active_weeks_52 >= 24 AND zs < 0.55 THEN 'moderately_intermittent'
  WHEN active_weeks_52 >= 10 AND zs < 0.8 THEN 'sparse_intermittent' WHEN active_weeks_52 > 0 THEN 'highly_intermittent' ELSE 'dormant' END AS intermittency_bucket,
 CASE WHEN target_is_bf_window = 1 THEN 'bf_window' WHEN target_is_post_bf_4w = 1 THEN 'post_bf_window' WHEN target_is_pre_bf_4w = 1 THEN 'pre_bf_window'
  WHEN horizon_bf_overlap_days > 0 THEN 'horizon_overlaps_bf' WHEN horizon_post_bf_overlap_days > 0 THEN 'horizon_overlaps_post_bf' ELSE 'normal_calendar' END AS calendar_route_context,
 CASE WHEN bf_unit_share_4w >= 0.35 THEN 'recent_units_bf_contaminated' WHEN bf_txn_share_13w >= 0.2 THEN 'recent_transactions_bf_contaminated'
  ELSE 'no_bf_contamination_signal' END AS sku_bf_contamination_context,
 active_weeks_52 <= 4 AND alive AS dorm FROM rt0"""
BLOCKS["rt2"] = """
SELECT *, unseen AND active_weeks_52 >= 24 AND avg_units_per_4w_52 >= 2 AND zs < 0.55 AS proxy,
 (intermittency_bucket IN ('sparse_intermittent', 'highly_intermittent') OR (avg_units_per_4w_52 < 3 AND zs >= 0.45)) AND NOT dorm AS sparse,
 roll13_mean >= 2 AND last4_to_roll13 < 0.5 AND seasonal52 <= greatest(1, 0.5 * roll13_mean) AND NOT sea AS decl,
 target_is_bf_window = 1 OR target_is_pre_bf_4w = 1 OR target_is_post_bf_4w = 1 OR horizon_bf_overlap_days > 0 OR horizon_post_bf_overlap_days > 0
  OR bf_unit_share_4w >= 0.35 OR bf_txn_share_13w >= 0.2 AS bfs FROM rt1"""
BLOCKS["rtx"] = """
SELECT *, zs AS zero_week_share_52, CASE WHEN active_weeks_52 > 0 THEN 52.0 / active_weeks_52 ELSE 999 END::DOUBLE AS avg_demand_interval_weeks_52,
 CASE WHEN avail THEN 'observed_positive_stock_position' WHEN constr THEN 'observed_low_stock_position' WHEN seen THEN 'observed_unclear_stock_position'
  WHEN proxy THEN 'proxy_recurring_demand_no_stock_context' WHEN unseen THEN 'stock_position_unobserved' ELSE 'stock_position_unknown' END AS stock_position_confidence,
 CASE WHEN constr THEN 'stock_constrained' WHEN bfs THEN 'bf_campaign_sensitive' WHEN sea AND alive THEN 'seasonal_active' WHEN sea THEN 'seasonal_quiet'
  WHEN dorm THEN 'dormant_or_reactivation' WHEN sparse THEN 'sparse_intermittent' WHEN decl THEN 'lifecycle_decline' WHEN avail THEN 'available_regular'
  WHEN proxy THEN 'proxy_available_regular' ELSE 'availability_unknown' END AS primary_route FROM rt2"""

_TWIN = " ".join(x for x in WIN_COLS)


@query("window_features", "SELECT * FROM win0", _TWIN)
def _(spark, d):
    return ft.window_features(chain(spark, d), TARGETS)


@query("campaign_history_features", "SELECT * FROM camp0", " ".join(CAMP_COLS) + " days_since_campaign_txn days_since_bf_txn")
def _(spark, d):
    return ft.campaign_history_features(chain(spark, d), TARGETS)


@query("stock_features", "SELECT * FROM stk1", " ".join(STK_COLS))
def _(spark, d):
    return sk.stock_features(fx.stock_monthly_store(spark, d), TARGETS)


@query("supplier_stock_features", "SELECT * FROM sup1", " ".join(SUP_COLS))
def _(spark, d):
    return sk.supplier_stock_features(stock_tables(spark, d)[1], TARGETS)


_AV = """stock_coverage_ratio_4w stock_coverage_ratio_13w no_sales_despite_stock sales_with_low_ending_stock combined_stock_prev_month_qty
combined_stock_observed_prev_month combined_stock_coverage_ratio_4w combined_stock_coverage_ratio_13w store_or_supplier_available_before_target
likely_true_stockout_before_target no_sales_despite_combined_stock sales_with_low_combined_stock"""


@query("availability_features", f"SELECT target_start, sku_id, combined_stock_coverage_bucket, {', '.join(_AV.split())} FROM fmx", _AV)
def _(spark, d):
    return routed(spark, d).select(*sc.KEY, "combined_stock_coverage_bucket", *_AV.split())


@query("feature_matrix", f"SELECT {', '.join(FM_COLS)} FROM fmx", " ".join(ft.NUMERIC_FEATURES) + " " + ACT_D,
       "headline_eligible business_target_eligible " + ACT_N)
def _(spark, d):
    return matrix(spark, d)


@query("feature_matrix_audit", """
SELECT target_start, count(*) AS skus, count(*) FILTER (actual_pos_units_4w >= 4) AS scored_rows, sum(actual_pos_units_4w) AS actual_units,
 avg(stock_observed_prev_month) AS store_stock_share, avg(supplier_stock_observed_prev_month) AS supplier_stock_share,
 avg(combined_stock_observed_prev_month) AS combined_stock_share FROM fmx GROUP BY ALL""",
       "actual_units store_stock_share supplier_stock_share combined_stock_share", "skus scored_rows")
def _(spark, d):
    return ft.feature_matrix_audit(routed(spark, d))


_REASON = "CASE primary_route " + " ".join(f"WHEN '{r[0]}' THEN '{r[1]}'" for r in rt.ROUTES) + " END AS route_reason"
_STATUS = "CASE primary_route " + " ".join(f"WHEN '{r[0]}' THEN '{r[2]}'" for r in rt.ROUTES) + " END AS route_signal_status"
_POLICY = "CASE primary_route " + " ".join(f"WHEN '{r[0]}' THEN '{r[3]}'" for r in rt.ROUTES) + " END AS scoring_policy_routed"


@query("route_labels", f"""
SELECT target_start, sku_id, primary_route, {_REASON}, {_STATUS}, {_POLICY}, intermittency_bucket, stock_position_confidence,
 calendar_route_context, sku_bf_contamination_context, zero_week_share_52, avg_demand_interval_weeks_52 FROM rtx""",
       "zero_week_share_52 avg_demand_interval_weeks_52")
def _(spark, d):
    return routed(spark, d).select(*sc.KEY, *rt.ROUTE_COLUMNS)


@query("route_masks", """
SELECT target_start, count(*) FILTER (primary_route IN ('available_regular', 'proxy_available_regular') AND calendar_route_context = 'normal_calendar') AS regular,
 count(*) FILTER (primary_route IN ('available_regular', 'proxy_available_regular') AND calendar_route_context = 'normal_calendar'
  AND coalesce(campaign_txn_13w, 0) <= 0 AND coalesce(bf_txn_13w, 0) <= 0) AS guarded_regular,
 count(*) FILTER (coalesce(store_or_supplier_available_before_target, 0) = 1 AND coalesce(combined_stock_observed_prev_month, 0) = 1
  AND calendar_route_context = 'normal_calendar' AND primary_route <> 'bf_campaign_sensitive') AS supplier_available,
 count(*) FILTER (primary_route = 'bf_campaign_sensitive' OR coalesce(campaign_txn_13w, 0) > 0 OR coalesce(bf_txn_13w, 0) > 0) AS campaign, count(*) FILTER (primary_route = 'stock_constrained') AS stock_constrained,
 count(*) FILTER (calendar_route_context <> 'normal_calendar' OR coalesce(bf_txn_13w, 0) > 0) AS bf_calendar,
 count(*) FILTER (active_weeks_52 >= 24 AND avg_units_per_4w_52 >= 2 AND calendar_route_context = 'normal_calendar') AS demand_regular
FROM rtx GROUP BY ALL""", "", "regular guarded_regular supplier_available campaign stock_constrained bf_calendar demand_regular")
def _(spark, d):
    r = routed(spark, d)
    return r.groupBy("target_start").agg(*[F.count(F.when(m, 1)).alias(n) for n, m in rt.route_masks().items()])


@query("population_filter", "SELECT target_start, sku_id, regime, revenue_rank FROM labels_x WHERE business_target_eligible = 1 AND revenue_rank <= 100", "", "revenue_rank")
def _(spark, d):
    return ft.population_filter(labels_of(spark, d), "business_target", 100).select(*sc.KEY, "regime", "revenue_rank")


@query("headline_or_proxy", """
SELECT target_start, sku_id, count(*) FILTER (pos_units > 0) AS active_weeks, sum(pos_units) AS units, sum(net_revenue) AS revenue
FROM wpos JOIN targets ON week_start >= target_start - 364 AND week_start < target_start GROUP BY ALL
HAVING count(*) FILTER (pos_units > 0) >= 12 AND sum(pos_units) >= 26 AND sum(net_revenue) > 0""", "units revenue", "active_weeks")
def _(spark, d):
    return ft.headline_or_proxy(None, chain(spark, d), TARGETS)


_TC = "target_month target_quarter target_weekofyear target_is_q4 target_is_black_friday_month target_is_bf_window target_is_pre_bf_4w target_is_post_bf_4w target_days_from_bf_start target_days_from_bf_end horizon_bf_overlap_days horizon_pre_bf_overlap_days horizon_post_bf_overlap_days"


@query("target_calendar_features", """
SELECT week_start AS target_start, count(*) AS line_count, month(week_start)::DOUBLE AS target_month, quarter(week_start)::DOUBLE AS target_quarter, weekofyear(week_start)::DOUBLE AS target_weekofyear,
 (quarter(week_start) = 4)::DOUBLE AS target_is_q4, (month(week_start) = 11)::DOUBLE AS target_is_black_friday_month,
 (week_start BETWEEN make_date(y0, 11, 3) AND make_date(y0, 11, 23))::DOUBLE AS target_is_bf_window,
 (week_start BETWEEN make_date(y0, 11, 3) - 28 AND make_date(y0, 11, 2))::DOUBLE AS target_is_pre_bf_4w,
 (week_start BETWEEN make_date(y0, 11, 24) AND make_date(y0, 11, 24) + 27)::DOUBLE AS target_is_post_bf_4w,
 (week_start - make_date(y0, 11, 3))::DOUBLE AS target_days_from_bf_start, (week_start - make_date(y0, 11, 23))::DOUBLE AS target_days_from_bf_end,
 greatest(0, least(week_start + 28, make_date(y0, 11, 24)) - greatest(week_start, make_date(y0, 11, 3)))::DOUBLE AS horizon_bf_overlap_days,
 greatest(0, least(week_start + 28, make_date(y0, 11, 3)) - greatest(week_start, make_date(y0, 11, 3) - 28))::DOUBLE AS horizon_pre_bf_overlap_days,
 greatest(0, least(week_start + 28, make_date(y0, 11, 24) + 28) - greatest(week_start, make_date(y0, 11, 24)))::DOUBLE AS horizon_post_bf_overlap_days
FROM (SELECT week_start, year(week_start) AS y0 FROM txn_sparse) GROUP BY week_start, y0""", _TC, "line_count")
def _(spark, d):
    w = fx.txn(spark, d, parts=False, stores=False).groupBy(F.col("week_start").alias("target_start")).agg(F.count(F.lit(1)).alias("line_count"))
    return w.select("target_start", "line_count", *[c.alias(n) for n, c in target_calendar(F.col("target_start")).items()])


@query("non_bf_calendar_weeks", """
WITH s AS (SELECT week_start, unnest(range(1, 14)) AS i FROM (SELECT DISTINCT week_start FROM txn_sparse))
SELECT week_start, count(*) FILTER (w + 7 <= make_date(year(w), 11, 3) OR w >= make_date(year(w), 11, 24))::DOUBLE AS non_bf_weeks_13w
FROM (SELECT week_start, week_start - CAST(7 * i AS INTEGER) AS w FROM s) GROUP BY ALL""", "non_bf_weeks_13w")
def _(spark, d):
    w = fx.txn(spark, d, parts=False, stores=False).select("week_start").distinct()
    return w.select("week_start", non_bf_calendar_weeks(F.col("week_start"), 13).alias("non_bf_weeks_13w"))


@query("previous_stock_months", """
WITH s AS (SELECT week_start, unnest(range(1, 7)) AS lag, n FROM (SELECT week_start, count(*) AS n FROM txn_sparse GROUP BY ALL))
SELECT week_start, lag AS month_lag, CAST(date_trunc('month', week_start) - to_months(CAST(lag AS INTEGER)) AS DATE) AS stock_month, n AS line_count FROM s""", "", "month_lag line_count")
def _(spark, d):
    w = fx.txn(spark, d, parts=False, stores=False).groupBy("week_start").agg(F.count(F.lit(1)).alias("line_count"))
    return w.select("week_start", "line_count", F.posexplode(previous_months(F.col("week_start"))).alias("p", "stock_month")).select(
        "week_start", (F.col("p") + 1).alias("month_lag"), "stock_month", "line_count")


# ---- stock queries ----------------------------------------------------------
@query("join_name_mapping", "SELECT * FROM sup_map", "supplier_stock_qty supplier_stock_value", "candidate_skus")
def _(spark, d):
    return stock_tables(spark, d)[1]


@query("supplier_map_profile", """
SELECT year(stock_month) AS stock_year, mapping_confidence, count(*) AS records, count(DISTINCT product_name_key) AS keys, count(DISTINCT sku_id) AS skus,
 count(*) FILTER (supplier_stock_qty = 0) AS zero_records, count(*) FILTER (supplier_stock_qty < 0) AS negative_records FROM sup_map GROUP BY ALL""",
       "", "stock_year records keys skus zero_records negative_records")
def _(spark, d):
    return sk.supplier_map_profile(stock_tables(spark, d)[1])


@query("stock_month_profile", """
SELECT store_id, stock_month, count(*) AS records, count(DISTINCT sku_id) AS skus, count(*) FILTER (stock_qty = 0) AS zero_records,
 count(*) FILTER (stock_qty < 0) AS negative_records, sum(stock_qty) AS total_qty FROM stock_m GROUP BY ALL""", "total_qty", "records skus zero_records negative_records")
def _(spark, d):
    return sk.stock_month_profile(fx.stock_monthly_store(spark, d))


@query("stock_overlap", """
WITH a AS (SELECT DISTINCT store_id, sku_id, 1 AS x FROM txn_mixed), b AS (SELECT DISTINCT store_id, sku_id, 1 AS z FROM stock_m WHERE stock_qty > 0)
SELECT store_id, count(x) AS sales_skus, count(z) AS stock_skus, count(x + z) AS both_skus, count(*) FILTER (x IS NULL) AS stock_only
FROM a FULL JOIN b USING (store_id, sku_id) GROUP BY ALL""", "", "sales_skus stock_skus both_skus stock_only")
def _(spark, d):
    return sk.stock_overlap(fx.txn(spark, d), fx.stock_monthly_store(spark, d).where("stock_qty > 0"))


@query("set_overlap", """
WITH a AS (SELECT DISTINCT sku_id, 1 AS x FROM txn_mixed WHERE is_non_product = 0), b AS (SELECT DISTINCT sku_id, 1 AS z FROM sup_map WHERE sku_id IS NOT NULL)
SELECT count(x) AS left_keys, count(z) AS right_keys, count(x + z) AS both_keys, count(*) FILTER (z IS NULL) AS only_left,
 count(*) FILTER (x IS NULL) AS only_right FROM a FULL JOIN b USING (sku_id)""", "", "left_keys right_keys both_keys only_left only_right")
def _(spark, d):
    return sk.set_overlap(fx.products(fx.txn(spark, d)), stock_tables(spark, d)[1].where("sku_id IS NOT NULL"), "sku_id")


@query("allowed_store_filter", """
SELECT store_id, count(*) AS records, sum(stock_qty) AS total_qty FROM stock_m WHERE store_id IN (SELECT store_id FROM txn_mixed WHERE raion_raw = 'ONLINE') GROUP BY ALL""",
       "total_qty", "records")
def _(spark, d):
    t = fx.txn(spark, d)
    s = sk.allowed_stores(fx.stock_monthly_store(spark, d), t.where("raion_raw = 'ONLINE'"))
    return s.groupBy("store_id").agg(F.count(F.lit(1)).alias("records"), F.sum("stock_qty").alias("total_qty"))


@query("coverage_delta", """
WITH b AS (SELECT store_id, count(*) r, count(DISTINCT sku_id) s, count(DISTINCT stock_month) m FROM stock_m WHERE stock_month < DATE '2000-01-01' GROUP BY ALL),
 a AS (SELECT store_id, count(*) r, count(DISTINCT sku_id) s, count(DISTINCT stock_month) m FROM stock_m GROUP BY ALL)
SELECT store_id, coalesce(b.r, 0) AS records_before, coalesce(b.s, 0) AS skus_before, coalesce(b.m, 0) AS months_before, coalesce(a.r, 0) AS records_after,
 coalesce(a.s, 0) AS skus_after, coalesce(a.m, 0) AS months_after, coalesce(a.r, 0) - coalesce(b.r, 0) AS records_delta,
 coalesce(a.s, 0) - coalesce(b.s, 0) AS skus_delta, coalesce(a.m, 0) - coalesce(b.m, 0) AS months_delta FROM b FULL JOIN a USING (store_id)""", "",
       "records_before skus_before months_before records_after skus_after months_after records_delta skus_delta months_delta")
def _(spark, d):
    s = fx.stock_monthly_store(spark, d)
    return sk.coverage_delta(s.where("stock_month < DATE '2000-01-01'"), s)


@query("new_file_profile", """
WITH g AS (SELECT 'F' || year(stock_month) AS source_file, store_id, stock_month, count(*) n, count(*) FILTER (stock_qty = 0) z, count(*) FILTER (stock_qty < 0) g
 FROM stock_m GROUP BY ALL)
SELECT source_file, sum(n) AS row_count, count(DISTINCT stock_month) AS months, sum(n - 1) AS duplicate_key_rows, 0 AS null_values, sum(z) AS zero_values,
 sum(g) AS negative_values FROM g GROUP BY ALL""", "", "row_count months duplicate_key_rows null_values zero_values negative_values")
def _(spark, d):
    s = fx.stock_monthly_store(spark, d).withColumn("source_file", F.concat(F.lit("F"), F.year("stock_month").cast("string")))
    return sk.new_file_profile(s, ["store_id"], "stock_qty", "stock_month")


BLOCKS["rot_m"] = """
SELECT 'P' || p AS sku_id, 'N' || n AS store_id, CASE WHEN p % 9 <> 0 THEN (p + n) % 12 / 2 END AS months_of_stock,
 CASE WHEN (p + n) % 5 <> 0 THEN (p * 3 + n) % 7 / 4 END AS rotation_speed FROM (SELECT DISTINCT l_partkey p, c_nationkey n FROM txn_sparse)"""


@query("rotation_profile", """
SELECT store_id, count(*) AS row_count, avg((k.sku_id IS NOT NULL)::DOUBLE) AS known_sku_share, avg((months_of_stock IS NULL)::DOUBLE) AS months_of_stock_missing_rate,
 avg((rotation_speed IS NULL)::DOUBLE) AS rotation_speed_missing_rate, avg(coalesce(months_of_stock > 0, false)::DOUBLE) AS months_of_stock_positive_rate,
 avg(coalesce(rotation_speed > 0, false)::DOUBLE) AS rotation_speed_positive_rate
FROM rot_m LEFT JOIN (SELECT DISTINCT sku_id FROM txn_sparse WHERE is_non_product = 0) k USING (sku_id) GROUP BY ALL""",
       "known_sku_share months_of_stock_missing_rate rotation_speed_missing_rate months_of_stock_positive_rate rotation_speed_positive_rate", "row_count")
def _(spark, d):
    t = fx.txn(spark, d, parts=False)
    rows = t.select("l_partkey", "c_nationkey", "sku_id", "store_id").distinct().select(
        "sku_id", "store_id", F.expr("CASE WHEN l_partkey % 9 <> 0 THEN (l_partkey + c_nationkey) % 12 / 2 END").alias("months_of_stock"),
        F.expr("CASE WHEN (l_partkey + c_nationkey) % 5 <> 0 THEN (l_partkey * 3 + c_nationkey) % 7 / 4 END").alias("rotation_speed"))
    return sk.rotation_profile(rows, ["months_of_stock", "rotation_speed"], fx.products(t))


_PREV = "date_trunc('month', target_start) - INTERVAL 1 MONTH"


def _side(tab, qty, pre, cond="true"):
    return f"""(SELECT target_start, sku_id, max((stock_month = {_PREV})::INT) AS {pre}_prev_observed, sum(q) FILTER (stock_month = {_PREV}) AS {pre}_prev_qty,
 1 AS {pre}_any_observed, max((q > 0)::INT) AS {pre}_any_positive FROM (SELECT sku_id, stock_month, sum({qty}) AS q FROM {tab} WHERE {cond} GROUP BY ALL)
 JOIN targets ON stock_month <= {_PREV} GROUP BY ALL)"""


BLOCKS["scov"] = f"""
SELECT target_start, sku_id, coalesce(store_prev_observed, 0) AS store_prev_observed, coalesce(store_prev_qty, 0) AS store_prev_qty,
 coalesce(store_any_observed, 0) AS store_any_observed, coalesce(store_any_positive, 0) AS store_any_positive,
 coalesce(supplier_prev_observed, 0) AS supplier_prev_observed, coalesce(supplier_prev_qty, 0) AS supplier_prev_qty,
 coalesce(supplier_any_observed, 0) AS supplier_any_observed, coalesce(supplier_any_positive, 0) AS supplier_any_positive,
 coalesce(rs, 0) AS recent_selling_stores, (coalesce(store_prev_qty, 0) > 0 OR coalesce(supplier_prev_qty, 0) > 0)::INT AS any_prev_positive
FROM labels_x LEFT JOIN {_side('stock_m', 'stock_qty', 'store')} USING (target_start, sku_id)
LEFT JOIN {_side('sup_map', 'supplier_stock_qty', 'supplier', "mapping_confidence = 'exact_unique'")} USING (target_start, sku_id)
LEFT JOIN (SELECT target_start, sku_id, max(num_stores_selling) AS rs FROM wpos JOIN targets ON week_start < target_start AND week_start >= target_start - 91 GROUP BY ALL)
 USING (target_start, sku_id)"""


def _coverage(spark, d):
    return sk.stock_coverage(labels_of(spark, d), *stock_tables(spark, d), chain(spark, d), TARGETS)


@query("stock_coverage", "SELECT * FROM scov", "store_prev_qty supplier_prev_qty",
       "store_prev_observed store_any_observed store_any_positive supplier_prev_observed supplier_any_observed supplier_any_positive recent_selling_stores any_prev_positive")
def _(spark, d):
    return _coverage(spark, d)


@query("stock_coverage_summary", """
SELECT *, CASE WHEN store_prev_share >= 0.8 THEN 'coverage_ready' WHEN greatest(store_prev_share, supplier_prev_share) >= 0.5 THEN 'coverage_partial' ELSE 'coverage_gap' END AS decision
FROM (SELECT target_start, count(*) AS skus, avg(store_prev_observed) AS store_prev_share, avg(supplier_prev_observed) AS supplier_prev_share,
 avg(store_any_observed) AS store_any_share, avg(supplier_any_observed) AS supplier_any_share, avg(any_prev_positive) AS positive_share FROM scov GROUP BY ALL)""",
       "store_prev_share supplier_prev_share store_any_share supplier_any_share positive_share", "skus")
def _(spark, d):
    return sk.stock_coverage_summary(_coverage(spark, d))


_LONGS = ["IANUARIE", "FEBRUARIE", "MARTIE", "APRILIE", "MAI", "IUNIE", "IULIE", "AUGUST", "SEPTEMBRIE", "OCTOMBRIE", "NOIEMBRIE", "DECEMBRIE"]


def _years(spark, d) -> list[int]:
    """Years of the order lines; a wide file has a column for each of their months."""
    years = fx.txn(spark, d, parts=False, stores=False).agg(F.min(F.year("sale_date")).alias("a"), F.max(F.year("sale_date")).alias("b")).first()
    return list(range(years["a"], years["b"] + 1)) if years["a"] is not None else []


# Month labels name years from 2000 on, so earlier ones are written LATER years on.
LATER = 20


@query("scan_monthly_store_stock", f"""
SELECT sku_id, store_id, CAST(stock_month + INTERVAL {LATER} YEAR AS DATE) AS stock_month, sum(stock_qty) AS stock_qty, count(*) AS source_row_count FROM stock_m
WHERE store_id IN (SELECT store_id FROM txn_mixed) GROUP BY ALL""", "stock_qty", "source_row_count")
def _(spark, d):
    """Wide text columns (all months of the stock rows) back to long."""
    s = fx.stock_monthly_store(spark, d)
    cell = lambda y, m: F.max(F.when((F.year("stock_month") == y) & (F.month("stock_month") == m), F.col("stock_qty"))).cast("string")
    wide = s.groupBy("sku_id", "store_id").agg(*[
        F.replace(cell(y, m), F.lit("."), F.lit(",")).alias(f"{n} {y + LATER}/STOC") for y in _years(spark, d) for m, n in enumerate(_LONGS, 1)])
    return sk.monthly_store_stock(wide, ["sku_id", "store_id"], fx.txn(spark, d, parts=False))


@query("scan_supplier_stock", f"""
SELECT stock_month, supplier_key, product_name_key, round(sum(q), 1) AS supplier_stock_qty, round(sum(v), 2) AS supplier_stock_value, count(*) AS source_row_count FROM (
 SELECT CAST(date_trunc('month', sale_date) + INTERVAL {LATER} YEAR AS DATE) AS stock_month, 'S' || l_suppkey AS supplier_key, upper(p_name) AS product_name_key, l_quantity AS q, l_extendedprice AS v
 FROM txn_sparse) GROUP BY ALL""", "supplier_stock_qty supplier_stock_value", "source_row_count")
def _(spark, d):
    """Text rows as suppliers send them, one per delivered line."""
    t = fx.txn(spark, d, "sparse", stores=False)
    label = F.element_at(F.array(*[F.lit(m) for m in _LONGS]), F.month("sale_date"))
    raw = t.select(F.concat_ws(" ", label, F.year("sale_date") + LATER).alias("period"), F.expr("concat('s', l_suppkey)").alias("supplier"),
                   F.col("product_name").alias("product"), F.replace(F.format_string("%.2f", "l_quantity"), F.lit("."), F.lit(",")).alias("qty"),
                   F.format_string("%.2f", "l_extendedprice").alias("value"))
    s = sk.supplier_stock(raw)
    return s.withColumns({"supplier_stock_qty": F.round("supplier_stock_qty", 1), "supplier_stock_value": F.round("supplier_stock_value", 2)})
