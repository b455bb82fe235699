"""Weekly tables, labels, naive forecasts and scorecard."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stocktide.operators import labels as lab
from stocktide.operators import score as sc
from stocktide.operators import weekly as wk
from stocktide.plans import fixtures as fx
from stocktide.plans.fixtures import TARGETS
from stocktide.plans.oracle import BLOCKS
from stocktide.plans.registry import query
from stocktide.session import cut_lineage, staged

CUTOFFS = [t - dt.timedelta(weeks=1) for t in TARGETS]
M = " ".join(wk.MEASURES)
COUNTS = " ".join(wk.COUNTS)


def cells(spark, d, grain="mixed"):
    """Weekly cells: the one scan of the lines behind labels, features and actuals."""
    return fx.shared(spark, d, f"cells_{grain}", lambda: wk.demand_cells(fx.txn(spark, d, grain)))


def chain(spark, d):
    return fx.shared(spark, d, "chain", lambda: wk.chain_weeks(cells(spark, d)))


def labels_of(spark, d):
    """Labels of all targets, keyed by target_start."""
    return fx.shared(spark, d, "labels", lambda: lab.regime_labels(cells(spark, d), chain(spark, d), CUTOFFS).withColumnRenamed(
        "horizon_start", "target_start"))


def naive_of(spark, d):
    return sc.with_naive(labels_of(spark, d).select(*sc.KEY), sc.naive_wide(chain(spark, d), TARGETS))


def actuals_of(spark, d):
    return sc.actuals_4w(labels_of(spark, d), chain(spark, d), TARGETS)


def naive_score_rows(spark, d):
    return fx.shared(spark, d, "naive_rows", lambda: sc.score_rows(
        labels_of(spark, d), sc.to_long(naive_of(spark, d), sc.NAIVE_MODELS), actuals_of(spark, d)), staged)


@query("weekly_store_demand", """
SELECT *, 'category_raw' AS category_source, 'observed' AS category_signal_status, 'group_raw' AS product_family_source,
  'observed' AS product_family_signal_status FROM store_week_mixed""",
       M + " avg_discount_pct max_discount_pct", COUNTS)
def _(spark, d):
    return wk.weekly_store_demand(fx.txn(spark, d))


@query("weekly_chain_demand", """
SELECT c.*, 'category_raw' AS category_source, 'observed' AS category_signal_status, 'group_raw' AS product_family_source,
  'observed' AS product_family_signal_status, r.num_return_lines FROM chain_week_mixed c
JOIN (SELECT sku_id, week_start, sum(num_return_lines) AS num_return_lines FROM store_week_mixed GROUP BY ALL) r USING (sku_id, week_start)""",
       M + " avg_discount_pct max_discount_pct",
       COUNTS + " num_stores_selling num_hyperstores_selling num_smaller_stores_selling")
def _(spark, d):
    return wk.weekly_chain_demand(wk.weekly_store_demand(fx.txn(spark, d)))


@query("store_week_coverage", """
WITH span AS (SELECT store_id, store_type, min(week_start) a, max(week_start) b FROM txn_sparse GROUP BY ALL),
 n AS (SELECT store_id, week_start, count(*) n FROM txn_sparse GROUP BY ALL),
 grid AS (SELECT store_id, store_type, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) week_start FROM span)
SELECT store_id, store_type, week_start, 1 AS has_source_coverage, coalesce(n, 0) AS transaction_count
FROM grid LEFT JOIN n USING (store_id, week_start)""", "", "has_source_coverage transaction_count")
def _(spark, d):
    return wk.store_week_coverage(fx.txn(spark, d, parts=False))


@query("import_totals", """
SELECT store_id, year(sale_date) AS sale_year, count(*) AS line_count, count(*) FILTER (order_date IS NULL) AS fallback_lines,
 sum(is_non_product) AS non_product_lines, count(DISTINCT sku_id) AS skus, min(sale_date) AS first_date, max(sale_date) AS last_date
FROM txn_mixed GROUP BY ALL""", "", "sale_year line_count fallback_lines non_product_lines skus")
def _(spark, d):
    return wk.import_totals(fx.txn(spark, d))


_SUMS = ", ".join(f"round(sum({m}), 2) AS {m}" for m in wk.MEASURES)


@query("conservation_check", f"""
SELECT 'lines' AS level, {_SUMS} FROM txn_mixed WHERE is_non_product = 0
UNION ALL SELECT 'store_week', {_SUMS} FROM store_week_mixed UNION ALL SELECT 'chain_week', {_SUMS} FROM chain_week_mixed""", M)
def _(spark, d):
    t = fx.txn(spark, d)
    store = cut_lineage(wk.weekly_store_demand(t))
    return wk.conservation(("lines", fx.products(t)), ("store_week", store), ("chain_week", wk.weekly_chain_demand(store)))


@query("product_rows", "SELECT sku_id, count(*) AS line_count, sum(net_units) AS net_units FROM txn_sparse WHERE is_non_product = 0 GROUP BY ALL",
       "net_units", "line_count")
def _(spark, d):
    return fx.products(fx.txn(spark, d, parts=False, stores=False)).groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("net_units").alias("net_units"))


@query("weekly_demand_legacy", """
SELECT sku_id, store_id, category_norm,
 CAST(date_trunc('week', sale_date - 1) AS DATE) AS week_start,
 sum(gross_units) AS units_sold, sum(returned_units) AS units_returned, sum(net_units) AS net_units, sum(net_revenue) AS net_revenue
FROM txn_dense GROUP BY ALL""", "units_sold units_returned net_units net_revenue")
def _(spark, d):
    return wk.weekly_demand_legacy(fx.txn(spark, d, "dense"))


@query("weekly_net_demand", """
SELECT sku_id, store_id, week_start, sum(greatest(gross_units - returned_units, 0)) AS net_units FROM txn_sparse GROUP BY ALL""", "net_units")
def _(spark, d):
    return wk.weekly_net_demand(fx.txn(spark, d, parts=False))


@query("weekly_daily_stats", """
WITH day AS (SELECT sku_id, store_id, week_start, sale_date, sum(greatest(net_units, 0)) u, sum(returned_units) r,
  max(CASE WHEN campaign_raw IS NULL THEN 0 ELSE 1 END) p FROM txn_sparse GROUP BY ALL)
SELECT sku_id, store_id, week_start, sum(u) AS net_units, sum(r) AS returned_units, count(*) FILTER (u > 0) AS selling_days,
  max(p) AS any_promo, max(CASE WHEN u = 0 THEN 1 ELSE 0 END) AS any_zero_day,
  coalesce(sum(u) / nullif(count(*) FILTER (u > 0), 0), 0) AS avg_per_selling_day FROM day GROUP BY ALL""",
       "net_units returned_units avg_per_selling_day", "selling_days any_promo any_zero_day")
def _(spark, d):
    return wk.weekly_daily_stats(fx.txn(spark, d, parts=False))


@query("store_year_profile", """
SELECT store_id, year(sale_date) AS sale_year, count(*) AS line_count, count(DISTINCT sku_id) AS skus, sum(net_units) AS net_units,
 sum(net_revenue) AS net_revenue, avg(CASE WHEN order_date IS NULL THEN 1.0 ELSE 0 END) AS fallback_share, sum(is_return) AS return_lines
FROM txn_mixed GROUP BY ALL""", "net_units net_revenue fallback_share", "sale_year line_count skus return_lines")
def _(spark, d):
    return wk.store_year_profile(fx.txn(spark, d))


@query("data_hygiene", """
SELECT count(*) AS line_count, count(*) FILTER (quantity < 0 AND line_value < 0) AS neg_qty_neg_value,
 count(*) FILTER (quantity < 0 AND line_value >= 0) AS neg_qty_pos_value, count(*) FILTER (quantity >= 0 AND line_value < 0) AS pos_qty_neg_value,
 count(*) FILTER (quantity >= 0 AND line_value >= 0) AS pos_qty_pos_value, count(*) FILTER (discount_raw IS NULL) AS discount_missing,
 count(*) FILTER (discount_raw < 0) AS discount_negative, count(*) FILTER (discount_raw BETWEEN 0 AND 1) AS discount_fraction,
 count(*) FILTER (abs(discount_raw) > 1) AS discount_over_one, count(campaign_raw) AS campaign_lines,
 sum(is_bf_timing) AS bf_timing_lines, sum(is_product_program) AS program_lines FROM txn_sparse""", "",
       "line_count neg_qty_neg_value neg_qty_pos_value pos_qty_neg_value pos_qty_pos_value discount_missing discount_negative "
       "discount_fraction discount_over_one campaign_lines bf_timing_lines program_lines")
def _(spark, d):
    return wk.data_hygiene(fx.txn(spark, d, parts=False, stores=False))


# ---- labels -------------------------------------------------------------
BLOCKS["cut"] = "SELECT target_start - 7 AS as_of_week, target_start FROM targets"
BLOCKS["wpos"] = "SELECT *, greatest(net_units, 0) AS pos_units FROM chain_week_mixed"
BLOCKS["lab_uni"] = """
SELECT as_of_week, sku_id, min(week_start) AS first_seen_week, max(week_start) AS last_seen_week
FROM wpos JOIN cut ON week_start <= as_of_week GROUP BY ALL"""
BLOCKS["lab_52"] = """
SELECT as_of_week, sku_id, sum(net_revenue) AS rev, sum(pos_units) AS units, count(*) FILTER (pos_units > 0) AS aw
FROM wpos JOIN cut ON week_start BETWEEN as_of_week - 357 AND as_of_week GROUP BY ALL"""
BLOCKS["lab_win"] = """
SELECT as_of_week, sku_id, count(DISTINCT k) AS nwin FROM (
  SELECT as_of_week, sku_id, unnest(range(greatest(0, i - 3), least(48, i) + 1)) AS k FROM (
    SELECT as_of_week, sku_id, CAST((week_start - (as_of_week - 357)) // 7 AS INTEGER) AS i
    FROM wpos JOIN cut ON week_start BETWEEN as_of_week - 357 AND as_of_week WHERE pos_units > 0)) GROUP BY ALL"""
BLOCKS["lab_act"] = """
SELECT as_of_week, sku_id, week_start, pos_units, month(week_start) AS m, year(week_start) AS yr
FROM wpos JOIN cut ON week_start BETWEEN as_of_week - 721 AND as_of_week WHERE pos_units > 0"""
BLOCKS["lab_mon"] = "SELECT as_of_week, sku_id, m, sum(pos_units) AS u, count(DISTINCT yr) AS ny FROM lab_act GROUP BY ALL"
BLOCKS["lab_sea"] = """
SELECT as_of_week, sku_id, count(*) AS months, sum(u) AS tot, list_sum(list_slice(list_reverse_sort(list(u)), 1, 3)) AS top3,
  sqrt(greatest(sum(u * u) / 12 - (sum(u) / 12) * (sum(u) / 12), 0)) / (sum(u) / 12) AS cv, count(*) FILTER (ny >= 2) AS rec
FROM lab_mon GROUP BY ALL"""
BLOCKS["lab_yrs"] = "SELECT as_of_week, sku_id, count(DISTINCT yr) AS yrs FROM lab_act GROUP BY ALL"
BLOCKS["lab_cat0"] = """
SELECT as_of_week, sku_id, category_norm, product_family_v2, sum(net_revenue) AS r,
  sum(net_revenue) FILTER (sale_date >= as_of_week - 357) AS r52
FROM txn_mixed JOIN cut ON sale_date <= as_of_week + 6 WHERE is_non_product = 0 GROUP BY ALL"""
BLOCKS["lab_cat"] = """
SELECT as_of_week, sku_id, category_norm, product_family_v2 FROM lab_cat0
QUALIFY row_number() OVER (PARTITION BY as_of_week, sku_id ORDER BY CASE WHEN r52 IS NULL THEN 1 ELSE 0 END,
  abs(coalesce(r52, r)) DESC, category_norm, product_family_v2) = 1"""
BLOCKS["lab_rank"] = """
SELECT as_of_week, sku_id, rev, row_number() OVER w AS revenue_rank, sum(rev) OVER w / sum(rev) OVER (PARTITION BY as_of_week) AS cum,
  CASE WHEN (sum(rev) OVER w - rev) / sum(rev) OVER (PARTITION BY as_of_week) < 0.8 THEN 1 ELSE 0 END AS top80
FROM lab_52 WHERE rev > 0
WINDOW w AS (PARTITION BY as_of_week ORDER BY rev DESC, sku_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
BLOCKS["lab0"] = """
SELECT u.as_of_week, u.sku_id, first_seen_week, last_seen_week, coalesce(f.rev, 0) AS trailing_52w_revenue,
  coalesce(f.units, 0) AS trailing_52w_pos_units, coalesce(f.aw, 0) AS active_weeks_52, coalesce(nwin, 0) AS active_4w_windows_52,
  coalesce(f.units, 0) / 13 AS avg_units_per_4w_52, revenue_rank, cum AS cumulative_revenue_share, coalesce(top80, 0) AS is_top_80_revenue,
  coalesce(months, 0) AS active_months_104, coalesce(top3 / tot, 0) AS top3_month_unit_share_104, coalesce(cv, 0) AS monthly_cv_104,
  coalesce(yrs, 0) AS active_years_104, coalesce(rec, 0) AS recurring_active_months_104, category_norm, product_family_v2,
  (SELECT min(k.rev) FROM lab_rank k WHERE k.as_of_week = u.as_of_week AND k.top80 = 1) AS top80_cutoff_revenue
FROM lab_uni u LEFT JOIN lab_52 f USING (as_of_week, sku_id) LEFT JOIN lab_win USING (as_of_week, sku_id)
LEFT JOIN lab_sea USING (as_of_week, sku_id) LEFT JOIN lab_yrs USING (as_of_week, sku_id)
LEFT JOIN lab_rank USING (as_of_week, sku_id) LEFT JOIN lab_cat USING (as_of_week, sku_id)"""
BLOCKS["lab1"] = """
SELECT *, active_weeks_52 >= 12 AND active_4w_windows_52 >= 26 AND avg_units_per_4w_52 >= 2 AS steady,
  is_top_80_revenue = 1 AND trailing_52w_pos_units >= 4 AND active_months_104 BETWEEN 2 AND 7 AND top3_month_unit_share_104 >= 0.6
  AND monthly_cv_104 >= 0.9 AND active_years_104 >= 2 AND recurring_active_months_104 >= 1 AS seas FROM lab0"""
BLOCKS["labels_m"] = """
SELECT *, as_of_week + 7 AS target_start, CASE WHEN is_top_80_revenue = 1 AND steady THEN 'forecastable_revenue_movers'
  WHEN seas THEN 'seasonal_revenue_movers' WHEN steady THEN 'active_movers' WHEN is_top_80_revenue = 1 THEN 'sparse_revenue_items'
  WHEN trailing_52w_pos_units > 0 THEN 'long_tail_active' ELSE 'dormant' END AS regime,
  CASE WHEN revenue_rank IS NULL THEN 'no_revenue' WHEN revenue_rank <= 100 THEN 'top_100' WHEN revenue_rank <= 500 THEN '101_500'
    WHEN revenue_rank <= 1000 THEN '501_1000' WHEN revenue_rank <= 5000 THEN '1001_5000' WHEN is_top_80_revenue = 1 THEN 'rest_to_80pct'
    ELSE 'outside_80pct' END AS revenue_bucket,
  CASE WHEN trailing_52w_pos_units <= 0 THEN 'zero_52w' WHEN trailing_52w_pos_units < 4 THEN '1_3_units_52w'
    WHEN trailing_52w_pos_units < 13 THEN '4_12_units_52w' WHEN trailing_52w_pos_units < 52 THEN '13_51_units_52w'
    WHEN trailing_52w_pos_units < 156 THEN '52_155_units_52w' ELSE '156_plus_units_52w' END AS volume_bucket FROM lab1"""
BLOCKS["labels_x"] = """
SELECT * EXCLUDE (steady, seas), CASE WHEN regime = 'forecastable_revenue_movers' THEN 1 ELSE 0 END AS headline_eligible,
  CASE WHEN regime IN ('forecastable_revenue_movers', 'seasonal_revenue_movers') THEN 1 ELSE 0 END AS business_target_eligible,
  CASE regime WHEN 'forecastable_revenue_movers' THEN 'quantity_4w_material' WHEN 'seasonal_revenue_movers' THEN 'seasonal_active_or_zero'
    WHEN 'active_movers' THEN 'quantity_secondary' WHEN 'sparse_revenue_items' THEN 'track_sparse_revenue'
    WHEN 'long_tail_active' THEN 'sale_probability' ELSE 'zero_or_reactivation' END AS scoring_policy,
  'observed' AS category_signal_status FROM labels_m"""

LAB_D = ("trailing_52w_revenue trailing_52w_pos_units avg_units_per_4w_52 cumulative_revenue_share top80_cutoff_revenue "
         "top3_month_unit_share_104 monthly_cv_104")
LAB_N = ("active_weeks_52 active_4w_windows_52 revenue_rank is_top_80_revenue active_months_104 active_years_104 "
         "recurring_active_months_104 headline_eligible business_target_eligible")


@query("regime_labels", "SELECT *, target_start + 27 AS horizon_end FROM labels_x", LAB_D, LAB_N)
def _(spark, d):
    return lab.regime_labels(cells(spark, d), chain(spark, d), CUTOFFS).withColumnRenamed("horizon_start", "target_start")


@query("trailing_52w", """
SELECT as_of_week, sku_id, coalesce(rev, 0) AS trailing_52w_revenue, coalesce(units, 0) AS trailing_52w_pos_units, coalesce(aw, 0) AS active_weeks_52
FROM lab_uni LEFT JOIN lab_52 USING (as_of_week, sku_id)""", "trailing_52w_revenue trailing_52w_pos_units", "active_weeks_52")
def _(spark, d):
    m = lab.history_metrics(chain(spark, d), CUTOFFS)
    return m.select("as_of_week", "sku_id", "trailing_52w_revenue", "trailing_52w_pos_units", "active_weeks_52")


@query("rolling_4w_activity", "SELECT as_of_week, sku_id, active_4w_windows_52, avg_units_per_4w_52 FROM lab0", "avg_units_per_4w_52", "active_4w_windows_52")
def _(spark, d):
    m = lab.history_metrics(chain(spark, d), CUTOFFS)
    return m.select("as_of_week", "sku_id", "active_4w_windows_52", "avg_units_per_4w_52")


@query("seasonality_metrics", """
SELECT as_of_week, sku_id, active_months_104, top3_month_unit_share_104, monthly_cv_104, active_years_104, recurring_active_months_104 FROM lab0""",
       "top3_month_unit_share_104 monthly_cv_104", "active_months_104 active_years_104 recurring_active_months_104")
def _(spark, d):
    m = lab.history_metrics(chain(spark, d), CUTOFFS)
    return m.select("as_of_week", "sku_id", "active_months_104", "top3_month_unit_share_104", "monthly_cv_104",
                    "active_years_104", "recurring_active_months_104")


@query("category_attribution", "SELECT *, 'observed' AS category_signal_status FROM lab_cat")
def _(spark, d):
    return lab.category_attribution(cells(spark, d), CUTOFFS)


@query("revenue_rank", """
SELECT as_of_week, sku_id, rev AS trailing_52w_revenue, revenue_rank, cum AS cumulative_revenue_share, top80 AS is_top_80_revenue FROM lab_rank""",
       "trailing_52w_revenue cumulative_revenue_share", "revenue_rank is_top_80_revenue")
def _(spark, d):
    return lab.revenue_rank(lab.history_metrics(chain(spark, d), CUTOFFS))


@query("regime_summary", """
WITH long AS (SELECT as_of_week, trailing_52w_revenue r, trailing_52w_pos_units u, unnest(['regime', 'revenue_bucket', 'volume_bucket']) AS "grouping",
  unnest([regime, revenue_bucket, volume_bucket]) AS "value" FROM labels_x),
 g AS (SELECT as_of_week, "grouping", "value", count(*) AS skus, sum(r) AS revenue, sum(u) AS units FROM long GROUP BY ALL)
SELECT g.*, coalesce(revenue / nullif(sum(revenue) OVER (PARTITION BY as_of_week, "grouping"), 0), 0) AS revenue_share FROM g""",
       "revenue units revenue_share", "skus")
def _(spark, d):
    return lab.regime_summary(labels_of(spark, d))


# ---- naive forecasts, actuals, scores -----------------------------------
BLOCKS["nv0"] = """
SELECT target_start, sku_id, coalesce(sum(pos_units) FILTER (week_start >= target_start - 28), 0) AS last4,
 coalesce(sum(pos_units) FILTER (week_start >= target_start - 56), 0) / 8 * 4 AS roll8_mean,
 coalesce(sum(pos_units) FILTER (week_start >= target_start - 91), 0) / 13 * 4 AS roll13_mean,
 coalesce(sum(pos_units) FILTER (week_start < target_start - 336), 0) AS seasonal52
FROM wpos JOIN targets ON week_start >= target_start - 364 AND week_start < target_start GROUP BY ALL"""
BLOCKS["naive"] = """
SELECT l.target_start, l.sku_id, 0.0::DOUBLE AS "zero", coalesce(last4, 0) AS last4, coalesce(roll8_mean, 0) AS roll8_mean,
 coalesce(roll13_mean, 0) AS roll13_mean, coalesce(seasonal52, 0) AS seasonal52,
 list_sort([coalesce(last4, 0), coalesce(roll13_mean, 0), coalesce(seasonal52, 0)])[2] AS median_naive
FROM labels_x l LEFT JOIN nv0 USING (target_start, sku_id)"""
BLOCKS["naive_long"] = """
SELECT target_start, sku_id, unnest(['zero', 'last4', 'roll8_mean', 'roll13_mean', 'seasonal52', 'median_naive']) AS model_name,
 unnest(["zero", last4, roll8_mean, roll13_mean, seasonal52, median_naive]) AS pred_units_4w FROM naive"""
BLOCKS["act0"] = """
SELECT target_start, sku_id, sum(pos_units) AS pu, sum(net_units) AS nu, sum(net_revenue) AS nr, count(*) FILTER (net_units < 0) AS nw
FROM wpos JOIN targets ON week_start >= target_start AND week_start < target_start + 28 GROUP BY ALL"""
BLOCKS["act1"] = """
SELECT target_start, sku_id, sum(is_bf_timing) AS c1, sum(is_bf_observed) AS c2, sum(is_bf_inferred) AS c3, count(campaign_raw) AS c4,
 count(*) FILTER (bf_signal_source = 'campaign_bf_outside_timing_window') AS c5
FROM txn_mixed JOIN targets ON sale_date >= target_start AND sale_date <= target_start + 27 WHERE is_non_product = 0 GROUP BY ALL"""
BLOCKS["actuals"] = """
SELECT l.target_start, l.sku_id, coalesce(pu, 0) AS actual_pos_units_4w, coalesce(nu, 0) AS actual_net_units_4w,
 coalesce(nr, 0) AS actual_net_revenue_4w, coalesce(nw, 0) AS negative_unit_weeks, coalesce(c1, 0) AS bf_txn_count,
 coalesce(c2, 0) AS bf_observed_txn_count, coalesce(c3, 0) AS bf_inferred_txn_count, coalesce(c4, 0) AS campaign_observed_txn_count,
 coalesce(c5, 0) AS unknown_campaign_label_txn_count
FROM labels_x l LEFT JOIN act0 USING (target_start, sku_id) LEFT JOIN act1 USING (target_start, sku_id)"""


def score_sql(pred: str, extra: str = "") -> str:
    """Score rows of a long prediction block."""
    return f"""
SELECT *, CASE WHEN actual_units >= 4 THEN abs_error / actual_units END AS abs_pct_error,
 CASE WHEN actual_units >= 4 THEN CAST(abs_error / actual_units <= 0.2 AS DOUBLE) END AS hit20,
 CASE WHEN actual_units >= 4 THEN CAST(abs_error / actual_units <= 0.3 AS DOUBLE) END AS hit30,
 CASE WHEN actual_units >= 4 THEN CAST(pred_units < 0.8 * actual_units AS DOUBLE) END AS under20,
 CASE WHEN actual_units >= 4 THEN CAST(pred_units > 1.2 * actual_units AS DOUBLE) END AS over20,
 CASE WHEN actual_units >= 4 THEN 1 ELSE 0 END AS quantity_scored,
 CASE WHEN actual_units = 0 AND pred_units >= 1 THEN 1 ELSE 0 END AS phantom,
 CASE WHEN pred_units >= 1 THEN 1 ELSE 0 END AS pred_sale, CASE WHEN actual_units > 0 THEN 1 ELSE 0 END AS actual_sale
FROM (SELECT target_start, sku_id, coalesce(model_name, 'missing_prediction') AS model_name, regime, headline_eligible, business_target_eligible,
  scoring_policy, revenue_bucket, volume_bucket, category_norm, product_family_v2, category_signal_status, {extra}
  CASE WHEN bf_observed_txn_count > 0 THEN 'bf_observed' WHEN bf_inferred_txn_count > 0 THEN 'bf_inferred'
   WHEN unknown_campaign_label_txn_count > 0 THEN 'unknown_campaign_label' WHEN campaign_observed_txn_count > 0 THEN 'campaign_observed_non_bf'
   ELSE 'non_campaign' END AS campaign_bucket,
  actual_pos_units_4w AS actual_units, actual_net_units_4w AS actual_net_units, actual_net_revenue_4w AS actual_revenue,
  greatest(coalesce(pred_units_4w, 0), 0) AS pred_units, abs(greatest(coalesce(pred_units_4w, 0), 0) - actual_pos_units_4w) AS abs_error,
  greatest(coalesce(pred_units_4w, 0), 0) - actual_pos_units_4w AS signed_error, CASE WHEN model_name IS NULL THEN 1 ELSE 0 END AS missing_prediction
 FROM labels_x JOIN actuals USING (target_start, sku_id) LEFT JOIN {pred} USING (target_start, sku_id))"""


BLOCKS["srows"] = score_sql("naive_long", "revenue_rank,")
METRICS_SQL = """count(*) AS n_population, count(*) FILTER (quantity_scored = 1) AS n_quantity_scored,
 count(*) FILTER (actual_units = 0) AS n_zero_actual, sum(phantom) AS n_phantom,
 coalesce(sum(actual_units) FILTER (quantity_scored = 1), 0) AS actual_units, coalesce(sum(pred_units) FILTER (quantity_scored = 1), 0) AS pred_units,
 sum(abs_error) FILTER (quantity_scored = 1) / nullif(sum(actual_units) FILTER (quantity_scored = 1), 0) AS wmape,
 avg(hit20) AS hit20, avg(hit30) AS hit30,
 sum(signed_error) FILTER (quantity_scored = 1) / nullif(sum(actual_units) FILTER (quantity_scored = 1), 0) AS bias_pct,
 avg(phantom) FILTER (actual_units = 0) AS phantom_rate, avg(under20) AS under20_rate, avg(over20) AS over20_rate"""
BLOCKS["srows_win"] = """
SELECT r.*, CASE WHEN r.quantity_scored = 1 AND r.model_name <> 'median_naive' AND b.abs_error IS NOT NULL
  THEN CAST(r.abs_error < b.abs_error AS DOUBLE) END AS win
FROM srows r LEFT JOIN (SELECT target_start, sku_id, abs_error FROM srows WHERE model_name = 'median_naive') b USING (target_start, sku_id)"""
SLICES_SQL = """SELECT *, 'all' AS slice_type, 'all' AS slice_value FROM srows_win
 UNION ALL SELECT *, 'headline', 'forecastable_revenue_movers' FROM srows_win WHERE headline_eligible = 1
 UNION ALL SELECT *, 'business_target', 'forecastable_plus_seasonal' FROM srows_win WHERE business_target_eligible = 1
 UNION ALL SELECT *, 'regime', regime FROM srows_win UNION ALL SELECT *, 'revenue_bucket', revenue_bucket FROM srows_win
 UNION ALL SELECT *, 'category_norm', category_norm FROM srows_win UNION ALL SELECT *, 'campaign_bucket', campaign_bucket FROM srows_win"""
BLOCKS["sliced"] = SLICES_SQL
SCORE_D = "actual_units actual_net_units actual_revenue pred_units abs_error signed_error abs_pct_error hit20 hit30 under20 over20"
SCORE_N = "headline_eligible business_target_eligible quantity_scored phantom pred_sale actual_sale missing_prediction"


@query("fc_naive_chain", "SELECT * FROM naive_long", "pred_units_4w")
def _(spark, d):
    return sc.to_long(naive_of(spark, d), sc.NAIVE_MODELS)


@query("naive_wide", 'SELECT * FROM naive', "zero last4 roll8_mean roll13_mean seasonal52 median_naive")
def _(spark, d):
    """Long predictions back to one column per model."""
    long = sc.to_long(naive_of(spark, d), sc.NAIVE_MODELS)
    return long.groupBy(*sc.KEY).pivot("model_name", list(sc.NAIVE_MODELS)).agg(F.first("pred_units_4w")).fillna(0.0)


@query("actuals_4w", "SELECT * FROM actuals", "actual_pos_units_4w actual_net_units_4w actual_net_revenue_4w",
       "negative_unit_weeks bf_txn_count bf_observed_txn_count bf_inferred_txn_count campaign_observed_txn_count unknown_campaign_label_txn_count")
def _(spark, d):
    return actuals_of(spark, d)


@query("score_rows", "SELECT * FROM srows", SCORE_D, SCORE_N + " revenue_rank")
def _(spark, d):
    return naive_score_rows(spark, d)


@query("score_slices", f"""
SELECT target_start, model_name, slice_type, slice_value, {METRICS_SQL}, avg(win) AS winrate_vs_median_naive FROM sliced GROUP BY ALL""",
       sc.METRIC_DOUBLES + " winrate_vs_median_naive", sc.METRIC_LONGS)
def _(spark, d):
    return sc.score_slices(naive_score_rows(spark, d))


@query("score_aggregate", f"""
SELECT model_name, slice_type, slice_value, {METRICS_SQL}, avg(win) AS winrate_vs_median_naive FROM sliced GROUP BY ALL""",
       sc.METRIC_DOUBLES + " winrate_vs_median_naive", sc.METRIC_LONGS)
def _(spark, d):
    return sc.score_slices(naive_score_rows(spark, d), by_run=False)


@query("winrate_vs_baseline", """
SELECT target_start, model_name, count(win) AS n_compared, avg(win) AS winrate_vs_median_naive FROM srows_win
WHERE model_name <> 'median_naive' GROUP BY ALL""", "winrate_vs_median_naive", "n_compared")
def _(spark, d):
    return sc.winrate_vs_baseline(naive_score_rows(spark, d))


@query("campaign_bucket", """
SELECT target_start, campaign_bucket, count(*) AS skus, sum(actual_units) AS actual_units FROM srows WHERE model_name = 'zero' GROUP BY ALL""",
       "actual_units", "skus")
def _(spark, d):
    a = actuals_of(spark, d).withColumn("campaign_bucket", sc.campaign_bucket())
    return a.groupBy("target_start", "campaign_bucket").agg(
        F.count(F.lit(1)).alias("skus"), F.sum("actual_pos_units_4w").alias("actual_units"))
