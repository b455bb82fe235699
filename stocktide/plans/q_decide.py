"""Buyer decisions on the sparse sku grain as of the fixture date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stocktide.operators import decide as de
from stocktide.plans import fixtures as fx
from stocktide.plans.fixtures import AS_OF
from stocktide.plans.oracle import BLOCKS
from stocktide.plans.registry import query
from stocktide.session import cut_lineage

BACKTEST = dt.date(2001, 1, 1)


def sales(spark, d, until=AS_OF):
    t = fx.txn(spark, d, parts=False).where(F.col("sale_date") <= F.lit(until))
    return t.select("sku_id", "store_id", "sale_date", F.col("gross_units").alias("units_sold"), F.col("returned_units").alias("units_returned"))


def dead(spark, d, anchor="as_of"):
    return de.dead_stock(sales(spark, d), fx.inventory(spark, d), fx.sku_dim(spark, d), fx.suppliers(spark, d), AS_OF, anchor)


def reliability(spark, d):
    return de.supplier_reliability(fx.supplier_orders(spark, d), fx.suppliers(spark, d))


def risk(spark, d, rel=None):
    return de.stockout_risk(fx.supplier_orders(spark, d), rel if rel is not None else reliability(spark, d), fx.sku_dim(spark, d))


def trend(spark, d, as_of=AS_OF):
    return de.demand_trend(sales(spark, d, as_of), fx.sku_dim(spark, d), as_of)


def queue(spark, d):
    rel = cut_lineage(reliability(spark, d))
    return de.decision_queue(cut_lineage(dead(spark, d)), rel, risk(spark, d, rel), cut_lineage(trend(spark, d)))


_A = f"DATE '{AS_OF}'"
BLOCKS["d_sales"] = f"SELECT sku_id, store_id, sale_date, gross_units AS units_sold, returned_units AS units_returned FROM txn_sparse WHERE sale_date <= {_A}"
BLOCKS["d_skus"] = "SELECT 'P' || p_partkey AS sku_id, p_name AS sku_name, p_type AS category, 'S' || (p_partkey % 100) AS supplier_id, p_retailprice AS selling_price, round(p_retailprice * 0.6, 2) AS purchase_cost FROM part"
BLOCKS["d_sup"] = "SELECT 'S' || s_suppkey AS supplier_id, s_name AS supplier_name, 60 + s_suppkey % 4 * 30 AS return_window_days FROM supplier"
BLOCKS["d_inv"] = """
SELECT 'P' || l_partkey AS sku_id, 'N' || c_nationkey AS store_id, CAST((l_partkey * 13 + c_nationkey * 7) % 40 AS DOUBLE) AS units_in_stock,
 CASE WHEN l_partkey % 17 <> 0 THEN max(order_date) + CAST(l_partkey % 20 AS INTEGER) END AS last_delivery_date, 'S' || min(l_suppkey) AS supplier_id
FROM txn_sparse GROUP BY l_partkey, c_nationkey"""
BLOCKS["d_ord"] = """
SELECT *, CASE WHEN o_orderstatus <> 'P' THEN promised_date + CAST((l_orderkey * 7 + l_linenumber * 3) % (5 + l_suppkey % 45) - 3 AS INTEGER) END AS actual_date FROM (
 SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS order_id, 'S' || l_suppkey AS supplier_id, 'P' || l_partkey AS sku_id,
 CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate AS DATE) + CAST(10 + l_suppkey % 15 AS INTEGER) AS promised_date, o_orderstatus, l_orderkey, l_linenumber, l_suppkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def traj_sql(ref):
    return f"""
WITH w AS (SELECT sku_id, store_id, CAST(date_trunc('week', sale_date) AS DATE) + 6 AS w, sum(units_sold - units_returned) AS net,
  max(CASE WHEN units_sold - units_returned > 0 THEN sale_date END) AS l FROM d_sales GROUP BY sku_id, store_id, CAST(date_trunc('week', sale_date) AS DATE) + 6),
 r AS (SELECT *, {ref} AS ref FROM w)
SELECT sku_id, store_id, max(l) AS last_sale_date, sum(net) AS lifetime_units, count(*) FILTER (w >= ref - 84 AND net > 0) AS active_recent_weeks,
 CASE WHEN sum(net) <= 5 THEN 'NEVER_MOVED' WHEN count(*) FILTER (w >= ref - 84 AND net > 0) >= 8 THEN 'SUDDEN_STOP' ELSE 'LIFECYCLE_DECLINE' END AS trajectory
FROM r GROUP BY sku_id, store_id"""


BLOCKS["d_traj"] = traj_sql(_A)
BLOCKS["d_dead0"] = f"""
SELECT i.sku_id, s.sku_name, i.store_id, s.category, coalesce(i.supplier_id, s.supplier_id) AS supplier_id,
 coalesce({_A} - t.last_sale_date, 9999) AS days_inactive, units_in_stock, purchase_cost, round(units_in_stock * purchase_cost, 2) AS capital_at_risk,
 coalesce(trajectory, 'NEVER_MOVED') AS trajectory, last_delivery_date
FROM d_inv i LEFT JOIN d_traj t USING (sku_id, store_id) LEFT JOIN d_skus s USING (sku_id) WHERE units_in_stock > 0"""
BLOCKS["d_dead1"] = f"""
SELECT d.*, last_delivery_date + CAST(coalesce(return_window_days, 90) AS INTEGER) - {_A} AS dl FROM d_dead0 d LEFT JOIN d_sup USING (supplier_id) WHERE days_inactive >= 60"""
BLOCKS["d_dead"] = """
SELECT sku_id, sku_name, store_id, category, supplier_id, days_inactive, units_in_stock, purchase_cost, capital_at_risk, round(days_inactive * capital_at_risk, 2) AS dead_stock_score,
 trajectory, coalesce(dl > 0, false)::INT AS return_window_open, CASE WHEN dl > 0 THEN dl WHEN dl <= 0 THEN 0 END AS return_window_days_remaining,
 coalesce(dl > 0 AND dl <= 14, false)::INT AS return_window_urgent, CASE WHEN dl > 0 THEN capital_at_risk ELSE 0 END AS budget_unlock FROM d_dead1"""
DEAD_D = "units_in_stock purchase_cost capital_at_risk dead_stock_score budget_unlock"
DEAD_N = "days_inactive return_window_open return_window_days_remaining return_window_urgent"


@query("dead_stock", "SELECT * FROM d_dead", DEAD_D, DEAD_N)
def _(spark, d):
    return dead(spark, d)


@query("trajectory", traj_sql("max(l) OVER (PARTITION BY sku_id, store_id)"), "lifetime_units", "active_recent_weeks")
def _(spark, d):
    return de.trajectories(sales(spark, d), AS_OF, anchor="last_sale")


@query("return_window", """
SELECT return_window_open, return_window_urgent, count(*) AS rows_n, sum(return_window_days_remaining) AS days_total, count(return_window_days_remaining) AS with_window
FROM d_dead GROUP BY ALL""", "", "return_window_open return_window_urgent rows_n days_total with_window")
def _(spark, d):
    return dead(spark, d).groupBy("return_window_open", "return_window_urgent").agg(
        F.count(F.lit(1)).alias("rows_n"), F.sum("return_window_days_remaining").alias("days_total"), F.count("return_window_days_remaining").alias("with_window"))


@query("dead_stock_summary", """
SELECT round(sum(capital_at_risk), 2) AS total_dead_stock, round(sum(budget_unlock), 2) AS total_budget_unlock, count(DISTINCT sku_id) AS sku_count,
 sum(return_window_urgent) AS urgent_return_count FROM d_dead""", "total_dead_stock total_budget_unlock", "sku_count urgent_return_count")
def _(spark, d):
    return de.dead_stock_summary(dead(spark, d))


@query("report_filters", """
SELECT sku_id, store_id, category, days_inactive, dead_stock_score FROM d_dead WHERE category = 'ECONOMY' AND store_id = 'N3' AND days_inactive >= 120
ORDER BY dead_stock_score DESC, sku_id LIMIT 50""", "dead_stock_score", "days_inactive")
def _(spark, d):
    r = dead(spark, d).where("category = 'ECONOMY' AND store_id = 'N3' AND days_inactive >= 120")
    return de.top_rows(r.select("sku_id", "store_id", "category", "days_inactive", "dead_stock_score"), [F.desc("dead_stock_score"), F.col("sku_id")], 50)


BLOCKS["d_rel0"] = """
SELECT *, actual_date - order_date AS ad, promised_date - order_date AS pd, actual_date - promised_date AS vd,
 row_number() OVER (PARTITION BY supplier_id ORDER BY order_date DESC, order_id DESC) AS rk FROM d_ord WHERE actual_date IS NOT NULL"""
BLOCKS["d_rel1"] = """
SELECT supplier_id, count(*) AS order_count, avg(pd) AS promised, avg(ad) AS actual, round_even(avg(ad) - avg(pd), 2) AS lead_time_gap_days,
 coalesce(round_even(stddev_samp(vd), 2), 0) AS delivery_consistency_std, round_even(avg(vd) FILTER (rk <= 6), 2) AS recent_avg_variance_days,
 round_even(CASE WHEN count(*) > 6 THEN avg(vd) FILTER (rk > 6) ELSE avg(vd) END, 2) AS historical_avg_variance_days FROM d_rel0 GROUP BY ALL"""
BLOCKS["d_rel2"] = """
SELECT *, round_even(recent_avg_variance_days - historical_avg_variance_days, 2) AS dlt FROM d_rel1 WHERE order_count >= 3"""
BLOCKS["d_rel3"] = """
SELECT *, round_even(least(100, greatest(0, 100 - least(40, lead_time_gap_days * 2) - least(30, delivery_consistency_std * 1.5) - greatest(dlt, 0) * 3)), 1) AS reliability_score,
 CASE WHEN dlt > 2 THEN 'WORSENING' WHEN dlt < -2 THEN 'IMPROVING' ELSE 'STABLE' END AS trend FROM d_rel2"""
BLOCKS["d_rel"] = """
SELECT supplier_id, supplier_name, reliability_score, CASE WHEN reliability_score >= 75 THEN 'GREEN' WHEN reliability_score >= 50 THEN 'YELLOW' ELSE 'RED' END AS status,
 round_even(promised, 1) AS avg_promised_lead_days, round_even(actual, 1) AS avg_actual_lead_days, lead_time_gap_days, delivery_consistency_std, trend,
 recent_avg_variance_days, historical_avg_variance_days, order_count FROM d_rel3 JOIN d_sup USING (supplier_id)"""
REL_D = "reliability_score avg_promised_lead_days avg_actual_lead_days lead_time_gap_days delivery_consistency_std recent_avg_variance_days historical_avg_variance_days"


@query("supplier_reliability", "SELECT * FROM d_rel", REL_D, "order_count")
def _(spark, d):
    return reliability(spark, d)


@query("recent_vs_history", "SELECT * FROM d_rel1",
       "promised actual lead_time_gap_days delivery_consistency_std recent_avg_variance_days historical_avg_variance_days", "order_count")
def _(spark, d):
    return de.recent_vs_history(fx.supplier_orders(spark, d))


_W = lambda c: f"CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR)"
BLOCKS["d_risk"] = f"""
SELECT supplier_id, supplier_name, p.sku_id, sku_name, avg_promised_lead_days, avg_actual_lead_days, round_even(lead_time_gap_days, 1) AS days_overdue,
 'promised ' || {_W('avg_promised_lead_days')} || ' days, actual ' || {_W('avg_actual_lead_days')} || ' days: order ' || {_W('lead_time_gap_days')} || ' days earlier' AS message
FROM (SELECT DISTINCT supplier_id, sku_id FROM d_ord WHERE actual_date IS NOT NULL) p JOIN d_rel USING (supplier_id) JOIN d_skus s ON s.sku_id = p.sku_id
WHERE lead_time_gap_days > 5"""


@query("stockout_risk", "SELECT * FROM d_risk", "avg_promised_lead_days avg_actual_lead_days days_overdue")
def _(spark, d):
    return risk(spark, d)


def trend_sql(src, as_of):
    last = as_of - dt.timedelta(days=as_of.weekday() + 7)
    m = dt.date(as_of.year - 1, as_of.month, 1)
    nxt = dt.date(m.year + (m.month == 12), m.month % 12 + 1, 1)
    return f"""
WITH s AS (SELECT *, CAST((DATE '{last}' - CAST(date_trunc('week', sale_date) AS DATE)) AS INTEGER) // 7 AS age0, units_sold - units_returned AS net FROM {src} WHERE sale_date <= DATE '{as_of}'),
 a AS (SELECT *, CASE WHEN sale_date >= DATE '{last + dt.timedelta(days=7)}' THEN -1 ELSE age0 END AS age FROM s),
 g AS (SELECT sku_id, coalesce(sum(units_sold) FILTER (age < 52), 0) / 12 AS apparent_demand_monthly, coalesce(sum(net) FILTER (age < 52), 0) / 12 AS real_demand_monthly,
  coalesce(sum(units_returned) FILTER (age < 52) / nullif(sum(units_sold) FILTER (age < 52 AND units_sold > 0), 0), 0) AS return_rate,
  coalesce(sum(net) FILTER (age BETWEEN 0 AND 7), 0) / 8 AS base_weekly, coalesce(sum((8 - age - 4.5) * net) FILTER (age BETWEEN 0 AND 7), 0) / 42 AS trend_slope,
  coalesce(sum(units_sold) FILTER (sale_date >= DATE '{m}' AND sale_date < DATE '{nxt}'), 0) / {(nxt - m).days} * 28 AS last_year_estimate_4_weeks FROM a GROUP BY ALL),
 h AS (SELECT *, (return_rate > 0.2)::INT AS return_flag, CASE WHEN trend_slope > 0.05 * abs(base_weekly) THEN 'GROWING' WHEN trend_slope < -0.05 * abs(base_weekly) THEN 'DECLINING' ELSE 'STABLE' END AS trend_status,
  greatest(0, base_weekly * 4 + trend_slope * 10) AS forecast_4_weeks, greatest(0, base_weekly * 8 + trend_slope * 36) AS forecast_8_weeks FROM g)
SELECT h.*, sku_name, category, last_year_estimate_4_weeks - forecast_4_weeks AS gap_units, (last_year_estimate_4_weeks - forecast_4_weeks) * purchase_cost AS gap_lei
FROM h JOIN d_skus USING (sku_id)"""


BLOCKS["d_trend"] = trend_sql("d_sales", AS_OF)
TREND_D = "apparent_demand_monthly real_demand_monthly return_rate base_weekly trend_slope last_year_estimate_4_weeks forecast_4_weeks forecast_8_weeks gap_units gap_lei"


@query("demand_trend", "SELECT * FROM d_trend", TREND_D, "return_flag")
def _(spark, d):
    return trend(spark, d)


@query("trend_slope_8w", "SELECT sku_id, base_weekly, trend_slope, trend_status FROM d_trend", "base_weekly trend_slope")
def _(spark, d):
    return trend(spark, d).select("sku_id", "base_weekly", "trend_slope", "trend_status")


@query("demand_history", """
SELECT sku_id, 'history' AS kind, CAST(date_trunc('week', sale_date) AS DATE) AS week_start, 0 AS step, sum(units_sold) AS apparent_units, sum(units_sold - units_returned) AS real_units
FROM d_sales GROUP BY ALL
UNION ALL SELECT sku_id, 'forecast', NULL, step, NULL, base_weekly + trend_slope * step FROM (SELECT *, unnest(range(1, 9)) AS step FROM d_trend)""",
       "apparent_units real_units", "step")
def _(spark, d):
    return de.demand_history(sales(spark, d), trend(spark, d))


BLOCKS["d_queue"] = f"""
SELECT 'RETURN_WINDOW_CLOSING' AS queue_type, sku_name || ' - RETURN_WINDOW_CLOSING' AS what, 'Return window closes in ' || return_window_days_remaining || ' days' AS why,
 capital_at_risk AS financial_impact, 'Return to supplier' AS recommended_action, 'URGENT' AS status, sku_id, supplier_id, store_id FROM d_dead WHERE return_window_urgent = 1
UNION ALL SELECT 'DEAD_STOCK', sku_name || ' - DEAD_STOCK', days_inactive || ' days inactive, ' || CAST(units_in_stock AS BIGINT) || ' units in stock', capital_at_risk,
 CASE WHEN return_window_open = 1 THEN 'Plan return' ELSE 'Clear or write off' END, CASE WHEN days_inactive > 120 THEN 'REVIEW' ELSE 'INFO' END, sku_id, supplier_id, store_id
 FROM d_dead WHERE return_window_urgent = 0 AND capital_at_risk > 5000
UNION ALL SELECT 'SUPPLIER_RED', supplier_name || ' - SUPPLIER_RED', 'Reliability ' || {_W('reliability_score')} || '/100, trend ' || trend, 0, 'Review contract', 'URGENT', NULL, supplier_id, NULL
 FROM d_rel WHERE status = 'RED'
UNION ALL SELECT 'STOCKOUT_RISK', sku_name || ' - STOCKOUT_RISK', message, 0, 'Order ' || {_W('days_overdue')} || ' days earlier', 'URGENT', sku_id, supplier_id, NULL FROM d_risk
UNION ALL SELECT 'DEMAND_DECLINING', sku_name || ' - DEMAND_DECLINING', 'Gap of ' || {_W('gap_units')} || ' units', gap_lei, 'Reduce order', 'REVIEW', sku_id, NULL, NULL
 FROM d_trend WHERE trend_status = 'DECLINING' AND gap_lei > 2000
UNION ALL SELECT 'OVER_ORDER_RISK', sku_name || ' - OVER_ORDER_RISK', 'Return rate ' || {_W('return_rate * 100')} || ' percent', gap_lei, 'Look into return reasons', 'REVIEW', sku_id, NULL, NULL
 FROM d_trend WHERE return_flag = 1 AND gap_lei > 1000"""


@query("decision_queue", """
SELECT queue_type, what, why, round(financial_impact, 2) AS financial_impact, recommended_action, status, sku_id, supplier_id, store_id,
 CASE status WHEN 'URGENT' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS priority FROM d_queue""", "financial_impact", "priority")
def _(spark, d):
    return queue(spark, d).withColumn("store_id", F.get_json_object("details", "$.store_id")).drop("details")


@query("queue_summary", """
SELECT count(*) AS total_items, count(*) FILTER (status = 'URGENT') AS urgent_count, count(*) FILTER (status = 'REVIEW') AS review_count,
 count(*) FILTER (status = 'INFO') AS info_count, sum(round(financial_impact, 2)) AS total_impact FROM d_queue""", "total_impact", "total_items urgent_count review_count info_count")
def _(spark, d):
    return de.queue_summary(queue(spark, d))


BLOCKS["d_bud"] = """
SELECT category, period, budget_lei, round(budget_lei * CASE period WHEN '2001-08' THEN 0.4 ELSE 0.5 END, 2) AS spent_lei FROM (
 SELECT category, unnest(['2001-07', '2001-08']) AS period, CAST(100000 + 1000 * length(category) AS DOUBLE) AS budget_lei FROM (SELECT DISTINCT p_type AS category FROM part))"""
BLOCKS["d_left"] = "SELECT *, greatest(0, budget_lei - spent_lei) AS remaining_lei FROM d_bud QUALIFY row_number() OVER (PARTITION BY category ORDER BY period DESC) = 1"


@query("category_budget", "SELECT * FROM d_left", "budget_lei spent_lei remaining_lei")
def _(spark, d):
    return de.category_budget(fx.budgets(spark, d))


BLOCKS["d_scen0"] = """
SELECT s.sku_id, s.sku_name, s.category, selling_price, purchase_cost, st.current_stock, forecast_8_weeks, remaining_lei,
 greatest(0, CAST(round_even(forecast_8_weeks - current_stock, 0) AS BIGINT)) AS recommended_qty
FROM d_skus s JOIN d_trend t USING (sku_id) JOIN (SELECT sku_id, sum(units_in_stock) AS current_stock FROM d_inv GROUP BY ALL) st USING (sku_id)
LEFT JOIN d_left b ON b.category = s.category"""
BLOCKS["d_scen1"] = """
SELECT d.*, a.scenario, b.demand_level, greatest(0, CAST(round_even(recommended_qty * a.qx, 0) AS BIGINT)) AS order_qty, forecast_8_weeks * b.dx AS fc
FROM d_scen0 d, (VALUES ('conservative', 0.8::DOUBLE), ('base', 1.0::DOUBLE), ('aggressive', 1.2::DOUBLE)) a(scenario, qx),
 (VALUES ('low_demand', 0.8::DOUBLE), ('base_demand', 1.0::DOUBLE), ('high_demand', 1.2::DOUBLE)) b(demand_level, dx)"""
BLOCKS["d_scen2"] = """
SELECT *, current_stock + order_qty AS have, round(order_qty * purchase_cost, 2) AS order_cost, least(current_stock + order_qty, fc) AS units_sold,
 round(least(current_stock + order_qty, fc) * selling_price, 2) AS revenue FROM d_scen1"""


@query("order_scenario_grid", """
SELECT sku_id, sku_name, category, scenario, demand_level, current_stock, recommended_qty, order_qty, order_cost, units_sold, revenue, greatest(0, have - fc) AS unsold_units,
 round(greatest(0, have - fc) * purchase_cost, 2) AS dead_stock_value, greatest(0, fc - have) AS shortage_units, round(greatest(0, fc - have) * selling_price, 2) AS lost_revenue,
 revenue - order_cost AS margin, CASE WHEN revenue > 0 THEN (revenue - order_cost) / revenue ELSE 0 END AS margin_pct, coalesce(order_cost <= remaining_lei, true)::INT AS within_budget,
 remaining_lei - order_cost AS budget_after FROM d_scen2""",
       "current_stock order_cost units_sold revenue unsold_units dead_stock_value shortage_units lost_revenue margin margin_pct budget_after", "recommended_qty order_qty within_budget")
def _(spark, d):
    skus = fx.sku_dim(spark, d).join(trend(spark, d).select("sku_id", "forecast_8_weeks"), "sku_id")
    skus = skus.join(de.stock_totals(fx.inventory(spark, d)), "sku_id").join(
        de.category_budget(fx.budgets(spark, d)).select("category", "remaining_lei"), "category", "left")
    g = de.order_scenario_grid(skus)
    return g.drop("supplier_id", "selling_price", "purchase_cost", "forecast_8_weeks", "stores_stocked", "remaining_lei")


BLOCKS["d_prof0"] = f"""
SELECT s.sku_id, s.sku_name, s.category, s.supplier_id, s.selling_price, s.purchase_cost, coalesce(current_stock, 0) AS current_stock, coalesce(stores_stocked, 0) AS stores_stocked,
 real_demand_monthly, forecast_8_weeks, trend_status, reliability_score, r.status, avg_actual_lead_days, (k.sku_id IS NOT NULL)::INT AS stockout_risk,
 dead_capital, dead_budget_unlock, any_window_open, any_window_urgent, coalesce(dead_stores, 0) AS dead_stores, worst_store, worst_trajectory
FROM d_skus s LEFT JOIN (SELECT sku_id, sum(units_in_stock) AS current_stock, count(*) AS stores_stocked FROM d_inv GROUP BY ALL) USING (sku_id)
LEFT JOIN (SELECT sku_id, real_demand_monthly, forecast_8_weeks, trend_status FROM d_trend) USING (sku_id) LEFT JOIN d_rel r ON r.supplier_id = s.supplier_id
LEFT JOIN (SELECT DISTINCT sku_id, supplier_id FROM d_risk) k ON k.sku_id = s.sku_id AND k.supplier_id = s.supplier_id
LEFT JOIN (SELECT sku_id, sum(capital_at_risk) AS dead_capital, sum(budget_unlock) AS dead_budget_unlock, max(return_window_open) AS any_window_open,
 max(return_window_urgent) AS any_window_urgent, count(*) AS dead_stores, arg_max(store_id, (capital_at_risk, store_id)) AS worst_store,
 arg_max(trajectory, (capital_at_risk, store_id)) AS worst_trajectory FROM d_dead GROUP BY ALL) dd ON dd.sku_id = s.sku_id"""
BLOCKS["d_prof1"] = """
SELECT *, CASE WHEN real_demand_monthly > 0 AND forecast_8_weeks > 0 THEN forecast_8_weeks / 8 END AS wd, coalesce(avg_actual_lead_days / 7, 3) AS lw FROM d_prof0"""
_COVER = """round_even(current_stock / wd, 1) AS weeks_of_cover, CASE WHEN wd IS NOT NULL THEN round_even(lw, 1) END AS lead_time_weeks,
 (round_even(current_stock / wd, 1) < lw + 1)::INT AS reorder_needed"""
PROF = ("sku_id sku_name category supplier_id selling_price purchase_cost current_stock stores_stocked real_demand_monthly forecast_8_weeks trend_status reliability_score status "
        "stockout_risk dead_capital dead_budget_unlock any_window_open any_window_urgent dead_stores worst_store worst_trajectory").split()


def profile(spark, d):
    rel = cut_lineage(reliability(spark, d))
    return de.sku_profile(fx.sku_dim(spark, d), fx.inventory(spark, d), trend(spark, d), rel, risk(spark, d, rel), dead(spark, d))


@query("sku_profile", f"SELECT {', '.join(PROF)}, {_COVER}, (dead_stores > 0)::INT AS is_dead_stock FROM d_prof1",
       "selling_price purchase_cost current_stock real_demand_monthly forecast_8_weeks reliability_score dead_capital dead_budget_unlock weeks_of_cover lead_time_weeks",
       "stores_stocked stockout_risk any_window_open any_window_urgent dead_stores reorder_needed is_dead_stock")
def _(spark, d):
    return profile(spark, d).select(*PROF, "weeks_of_cover", "lead_time_weeks", "reorder_needed", "is_dead_stock")


@query("stock_cover", f"SELECT sku_id, current_stock, {_COVER} FROM d_prof1", "current_stock weeks_of_cover lead_time_weeks", "reorder_needed")
def _(spark, d):
    rel = reliability(spark, d).select("supplier_id", "avg_actual_lead_days")
    p = (fx.sku_dim(spark, d).join(de.stock_totals(fx.inventory(spark, d)), "sku_id", "left").join(trend(spark, d).drop("sku_name", "category"), "sku_id", "left")
         .join(rel, "supplier_id", "left").fillna(0, ["current_stock"]))
    return de.stock_cover(p).select("sku_id", "current_stock", "weeks_of_cover", "lead_time_weeks", "reorder_needed")


@query("sku_search", """
SELECT sku_id, sku_name, category FROM d_skus WHERE sku_name ILIKE '%RING%' OR sku_id ILIKE '%RING%' ORDER BY sku_name, sku_id LIMIT 20""")
def _(spark, d):
    return de.sku_search(fx.sku_dim(spark, d).select("sku_id", "sku_name", "category"), "RING")


@query("topk_reports", """
SELECT * FROM (SELECT 'over_order' AS report, sku_id, gap_lei AS score FROM d_trend WHERE trend_status = 'DECLINING' AND gap_lei > 0 ORDER BY gap_lei DESC, sku_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'high_return', sku_id, return_rate FROM d_trend WHERE return_flag = 1 ORDER BY round(return_rate, 6) DESC, sku_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'growing', sku_id, real_demand_monthly FROM d_trend WHERE trend_status = 'GROWING' ORDER BY round(real_demand_monthly, 6) DESC, sku_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'declining', sku_id, abs(gap_lei) FROM d_trend WHERE trend_status = 'DECLINING' ORDER BY round(abs(gap_lei), 4) DESC, sku_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'dead_stock', sku_id || '/' || store_id, dead_stock_score FROM d_dead ORDER BY dead_stock_score DESC, sku_id || '/' || store_id LIMIT 5)""", "score")
def _(spark, d):
    t = cut_lineage(trend(spark, d))
    rep = lambda df, name, score, k: de.top_rows(df.select(F.lit(name).alias("report"), "sku_id", score.alias("score")), [F.desc(F.round("score", 6)), F.col("sku_id")], k)
    declining = t.where("trend_status = 'DECLINING'")
    dd = dead(spark, d).withColumn("sku_id", F.concat_ws("/", "sku_id", "store_id"))
    return (rep(declining.where("gap_lei > 0"), "over_order", F.col("gap_lei"), 3)
            .unionByName(rep(t.where("return_flag = 1"), "high_return", F.col("return_rate"), 10))
            .unionByName(rep(t.where("trend_status = 'GROWING'"), "growing", F.col("real_demand_monthly"), 10))
            .unionByName(rep(declining, "declining", F.abs("gap_lei"), 10)).unionByName(rep(dd, "dead_stock", F.col("dead_stock_score"), 5)))


@query("net_sales_clean", """
SELECT sku_id, sum(greatest(units_sold - units_returned, 0)) AS net_units, sum(units_sold - units_returned) AS raw_net FROM d_sales GROUP BY ALL""", "net_units raw_net")
def _(spark, d):
    s = de.net_sales_clean(sales(spark, d))
    return s.groupBy("sku_id").agg(F.sum("net_units").alias("net_units"), F.sum(F.col("units_sold") - F.col("units_returned")).alias("raw_net"))


BLOCKS["d_req"] = """
SELECT 'P' || l_partkey AS sku_id, CASE l_orderkey % 7 WHEN 0 THEN 'RETURN_WINDOW_CLOSING' WHEN 1 THEN 'dead_stock' WHEN 2 THEN 'STOCKOUT_RISK' WHEN 3 THEN 'DEMAND_DECLINING'
  WHEN 4 THEN 'OVER_ORDER_RISK' WHEN 5 THEN 'SUPPLIER_RED' END AS queue_type, CASE l_linenumber % 4 WHEN 0 THEN 'Approve' WHEN 1 THEN 'skip' WHEN 2 THEN 'override' ELSE 'hold' END AS action,
 CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS override_qty, l_extendedprice AS financial_impact,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id,
 make_date(2001, 1, 1) + CAST((l_orderkey * 31 + l_suppkey * 7) % 200 AS INTEGER) AS decided_at FROM lineitem"""
BLOCKS["d_dec"] = """
SELECT * REPLACE (lower(action) AS action, upper(queue_type) AS queue_type), CASE WHEN lower(action) NOT IN ('approve', 'skip', 'override') THEN 'bad_action'
 WHEN queue_type IS NULL OR upper(queue_type) NOT IN ('RETURN_WINDOW_CLOSING', 'DEAD_STOCK', 'STOCKOUT_RISK', 'DEMAND_DECLINING', 'OVER_ORDER_RISK') THEN 'bad_queue_type'
 WHEN lower(action) = 'override' AND override_qty IS NULL THEN 'override_without_qty' END AS rej FROM d_req"""


def requests(spark, d):
    return fx.table(spark, d, "lineitem").selectExpr(
        "concat('P', l_partkey) AS sku_id",
        """CASE l_orderkey % 7 WHEN 0 THEN 'RETURN_WINDOW_CLOSING' WHEN 1 THEN 'dead_stock' WHEN 2 THEN 'STOCKOUT_RISK' WHEN 3 THEN 'DEMAND_DECLINING'
           WHEN 4 THEN 'OVER_ORDER_RISK' WHEN 5 THEN 'SUPPLIER_RED' END AS queue_type""",
        "CASE l_linenumber % 4 WHEN 0 THEN 'Approve' WHEN 1 THEN 'skip' WHEN 2 THEN 'override' ELSE 'hold' END AS action",
        "CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS override_qty", "l_extendedprice AS financial_impact",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id",
        "date_add(DATE '2001-01-01', CAST((l_orderkey * 31 + l_suppkey * 7) % 200 AS INT)) AS decided_at")


@query("append_decision", """
SELECT coalesce(rej, 'accepted') AS outcome, count(*) AS rows_n, sum(financial_impact) AS impact FROM d_dec GROUP BY ALL""", "impact", "rows_n")
def _(spark, d):
    ok, bad = de.split_decisions(requests(spark, d))
    both = ok.withColumn("outcome", F.lit("accepted")).unionByName(bad.withColumnRenamed("reject_reason", "outcome"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows_n"), F.sum("financial_impact").alias("impact"))


_DECISION_DAY = dt.date(2001, 7, 1)


def _summary_sql(where: str) -> str:
    return f"""
WITH v AS (SELECT *, unnest(['ALL', queue_type]) AS scope FROM d_dec WHERE rej IS NULL{where})
SELECT scope, count(*) AS total, count(*) FILTER (action = 'approve') AS approve_count, count(*) FILTER (action = 'skip') AS skip_count, count(*) FILTER (action = 'override') AS override_count,
 coalesce(sum(financial_impact) FILTER (action = 'approve'), 0) AS approve_impact, coalesce(sum(financial_impact) FILTER (action = 'skip'), 0) AS skip_impact,
 coalesce(sum(financial_impact) FILTER (action = 'override'), 0) AS override_impact, coalesce(sum(financial_impact), 0) AS impact FROM v GROUP BY ALL"""


_SUMMARY = ("approve_impact skip_impact override_impact impact", "total approve_count skip_count override_count")


@query("decisions_summary", _summary_sql(""), *_SUMMARY)
def _(spark, d):
    return de.decisions_summary(de.split_decisions(requests(spark, d))[0])


@query("decisions_summary_day", _summary_sql(f" AND decided_at = DATE '{_DECISION_DAY}'"), *_SUMMARY)
def _(spark, d):
    return de.decisions_summary(de.split_decisions(requests(spark, d))[0], _DECISION_DAY)


@query("recent_decisions", """
SELECT id, sku_id, queue_type, action, override_qty, financial_impact, decided_at FROM d_dec WHERE rej IS NULL ORDER BY decided_at DESC, id DESC LIMIT 10""", "override_qty financial_impact")
def _(spark, d):
    return de.recent_decisions(de.split_decisions(requests(spark, d))[0])


BLOCKS["d_trend_b"] = trend_sql(f"(SELECT * FROM d_sales WHERE sale_date <= DATE '{BACKTEST}')", BACKTEST)
BLOCKS["d_fin"] = f"""
SELECT t.sku_id, last_year_estimate_4_weeks AS basic_order, forecast_4_weeks AS engine_order, coalesce(a.u, 0) AS actual_units, purchase_cost, selling_price
FROM d_trend_b t JOIN d_skus USING (sku_id) LEFT JOIN (SELECT sku_id, sum(greatest(units_sold - units_returned, 0)) AS u FROM d_sales
 WHERE sale_date > DATE '{BACKTEST}' AND sale_date <= DATE '{BACKTEST}' + 28 GROUP BY ALL) a USING (sku_id)"""


@query("financial_impact", """
SELECT *, basic_over_cost + basic_out_cost - engine_over_cost - engine_out_cost AS savings FROM (SELECT count(*) AS skus,
 sum(greatest(basic_order - actual_units, 0) * purchase_cost) AS basic_over_cost, sum(greatest(actual_units - basic_order, 0) * (selling_price - purchase_cost) * 1.5) AS basic_out_cost,
 sum(greatest(engine_order - actual_units, 0) * purchase_cost) AS engine_over_cost, sum(greatest(actual_units - engine_order, 0) * (selling_price - purchase_cost) * 1.5) AS engine_out_cost
FROM d_fin)""", "basic_over_cost basic_out_cost engine_over_cost engine_out_cost savings", "skus")
def _(spark, d):
    t = trend(spark, d, BACKTEST).select("sku_id", F.col("last_year_estimate_4_weeks").alias("basic_order"), F.col("forecast_4_weeks").alias("engine_order"))
    after = de.net_sales_clean(sales(spark, d)).where(
        (F.col("sale_date") > F.lit(BACKTEST)) & (F.col("sale_date") <= F.lit(BACKTEST + dt.timedelta(days=28))))
    act = after.groupBy("sku_id").agg(F.sum("net_units").alias("actual_units"))
    rows = t.join(fx.sku_dim(spark, d), "sku_id").join(act, "sku_id", "left").fillna(0.0, ["actual_units"])
    return de.financial_impact(rows)
