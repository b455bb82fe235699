"""Series operators and classical forecasts on weekly series per sku."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from stocktide.operators import forecast as fc
from stocktide.operators import series as se
from stocktide.operators import weekly as wk
from stocktide.plans import fixtures as fx
from stocktide.plans.oracle import BLOCKS
from stocktide.plans.registry import query
from stocktide.session import cut_lineage

CUT = dt.date(2001, 7, 23)
K = ["sku_id"]


def weekly(spark, d, cut=CUT):
    """Weekly units per sku up to the training cut-off."""
    t = fx.products(fx.txn(spark, d, stores=False)).where(F.col("week_start") <= F.lit(cut))
    return t.groupBy("sku_id", "week_start").agg(
        F.greatest(F.sum("net_units"), F.lit(0.0)).alias("units"), F.max("category_norm").alias("category"))


def folded(spark, d):
    return se.fold_series(weekly(spark, d), K)


def grid(spark, d):
    return se.dense_weekly_grid(weekly(spark, d), K)


BLOCKS["ser"] = f"SELECT sku_id, week_start, pos_units AS units, category_norm AS category FROM wpos WHERE week_start <= DATE '{CUT}'"
BLOCKS["ser_grid"] = """
SELECT g.sku_id, g.week_start, coalesce(units, 0) AS units FROM (SELECT sku_id, CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start
 FROM ser GROUP BY sku_id) g LEFT JOIN ser s ON s.sku_id = g.sku_id AND s.week_start = g.week_start"""
BLOCKS["ser_n"] = """
SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY week_start) AS rn, row_number() OVER (PARTITION BY sku_id ORDER BY week_start DESC) AS rd,
 count(*) OVER (PARTITION BY sku_id) AS n FROM ser_grid"""
BLOCKS["ser_k"] = "SELECT sku_id, count(*) AS n, avg(units) AS m, coalesce(stddev_samp(units), 0) AS sd, avg((units <= 0)::INT) AS zs, max(week_start) AS lastw FROM ser_grid GROUP BY sku_id"


@query("dense_weekly_grid", "SELECT * FROM ser_grid", "units")
def _(spark, d):
    return grid(spark, d)


@query("promo_spikes", """
SELECT *, (units > 2.5 * avg(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS 12 PRECEDING))::INT AS is_promotional_week FROM ser""", "units")
def _(spark, d):
    return se.promo_spikes(weekly(spark, d), K)


@query("stockout_runs", """
WITH z AS (SELECT *, units = 0 AS zr, rn - row_number() OVER (PARTITION BY sku_id, units = 0 ORDER BY week_start) AS run FROM ser_n)
SELECT sku_id, week_start, units, (zr AND count(*) OVER (PARTITION BY sku_id, zr, run) >= 2)::INT AS is_stockout_week FROM z""", "units")
def _(spark, d):
    return se.stockout_runs(grid(spark, d), K)


_LAGD = ("units sales_lag_1w sales_lag_2w sales_lag_4w sales_lag_13w sales_lag_26w sales_lag_52w rolling_avg_4w rolling_avg_13w yoy_growth_ratio trend_momentum "
         "historical_volatility")


@query("lag_features", """
WITH l AS (SELECT *, """ + ", ".join(f"lag(units, {k}) OVER w AS sales_lag_{k}w" for k in (1, 2, 4, 13, 26, 52)) + """,
 avg(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_avg_4w,
 avg(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS rolling_avg_13w,
 CASE WHEN rn >= 4 THEN stddev_samp(units) OVER w / nullif(avg(units) OVER w, 0) END AS historical_volatility FROM ser_n WINDOW w AS (PARTITION BY sku_id ORDER BY week_start))
SELECT * EXCLUDE (rn, rd, n), rolling_avg_4w / nullif(sales_lag_52w, 0) AS yoy_growth_ratio, (rolling_avg_4w - rolling_avg_13w) / nullif(rolling_avg_13w, 0) AS trend_momentum,
 rn - 1 AS product_age_weeks, (rn - 1 > 52)::INT AS is_mature, weekofyear(week_start) AS week_of_year, month(week_start) AS month FROM l""",
       _LAGD, "product_age_weeks is_mature week_of_year month")
def _(spark, d):
    return se.lag_features(grid(spark, d), K)


@query("weeks_since_promo", """
WITH p AS (SELECT sku_id, week_start, row_number() OVER w AS rn, units > 2.5 * avg(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS 12 PRECEDING) AS promo FROM ser
 WINDOW w AS (PARTITION BY sku_id ORDER BY week_start))
SELECT sku_id, week_start, promo::INT AS is_promotional_week, rn - max(CASE WHEN promo THEN rn END) OVER (PARTITION BY sku_id ORDER BY week_start) AS weeks_since_last_promo FROM p""",
       "", "is_promotional_week weeks_since_last_promo")
def _(spark, d):
    return se.weeks_since_promo(se.promo_spikes(weekly(spark, d), K), K).drop("units", "category")


@query("category_features", """
WITH c AS (SELECT category, week_start, sum(units) AS t FROM ser GROUP BY ALL),
 f AS (SELECT category, week_start, t, lag(t) OVER (PARTITION BY category ORDER BY week_start) AS category_sales_lag_1w,
  avg(t) OVER (PARTITION BY category ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) / nullif(CASE WHEN count(*) OVER (PARTITION BY category ORDER BY week_start
  ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) >= 4 THEN avg(t) OVER (PARTITION BY category ORDER BY week_start ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) END, 0) AS category_yoy_ratio FROM c)
SELECT s.*, category_sales_lag_1w, category_yoy_ratio, units / nullif(t, 0) AS sku_share_of_category_pct FROM ser s JOIN f USING (category, week_start)""",
       "units category_sales_lag_1w category_yoy_ratio sku_share_of_category_pct")
def _(spark, d):
    return se.category_features(weekly(spark, d))


_LAGS = ", ".join(f"CASE WHEN n >= {max(1, k // 2)} THEN sum(units) FILTER (rd <= {k}) / least(n, {k}) END AS lag_{k}w" for k in (1, 4, 13, 26, 52))
BLOCKS["ser_msl0"] = f"SELECT sku_id, n, {_LAGS} FROM ser_n GROUP BY sku_id, n"
BLOCKS["ser_msl1"] = """
SELECT *, CASE WHEN lag_1w IS NOT NULL AND lag_4w IS NOT NULL THEN CASE WHEN lag_4w > 0 THEN lag_1w / lag_4w ELSE 1 END END AS momentum_short,
 CASE WHEN lag_4w IS NOT NULL AND lag_13w IS NOT NULL THEN CASE WHEN lag_13w > 0 THEN lag_4w / lag_13w ELSE 1 END END AS momentum_medium,
 CASE WHEN lag_13w IS NOT NULL AND lag_26w IS NOT NULL THEN CASE WHEN lag_26w > 0 THEN lag_13w / lag_26w ELSE 1 END END AS momentum_long FROM ser_msl0"""
BLOCKS["ser_msl"] = """
SELECT *, CASE WHEN momentum_short IS NULL AND momentum_medium IS NULL AND momentum_long IS NULL THEN 'STABLE'
 WHEN least(momentum_short, momentum_medium, momentum_long) > 1.03 THEN 'STRONG_GROWTH' WHEN greatest(momentum_short, momentum_medium, momentum_long) < 0.97 THEN 'STRONG_DECLINE'
 WHEN least(momentum_short, momentum_medium, momentum_long) - 1 >= -0.03 AND greatest(momentum_short, momentum_medium, momentum_long) - 1 <= 0.03 THEN 'STABLE' ELSE 'UNSTABLE' END AS trend_consistency FROM ser_msl1"""


@query("multi_scale_lags", "SELECT * EXCLUDE (n), n AS weeks_of_history FROM ser_msl",
       "lag_1w lag_4w lag_13w lag_26w lag_52w momentum_short momentum_medium momentum_long", "weeks_of_history")
def _(spark, d):
    return se.multi_scale_lags(folded(spark, d)).drop("series", "first_week", "last_week")


BLOCKS["ser_med"] = """
SELECT *, CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(units, 0.5) OVER w ELSE quantile_cont(units, 0.5) OVER (PARTITION BY sku_id) END AS med FROM ser_n
WINDOW w AS (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"""
BLOCKS["ser_clean"] = "SELECT sku_id, week_start, units, rd, n, CASE WHEN n >= 4 AND units > 2.5 * med THEN med ELSE units END AS clean_units FROM ser_med"


@query("strip_promo_weeks", "SELECT sku_id, week_start, units, clean_units FROM ser_clean", "units clean_units")
def _(spark, d):
    return se.strip_promo_weeks(grid(spark, d), K)


@query("seasonal_index", """
WITH k AS (SELECT sku_id, count(*) AS n, avg(units) AS m FROM ser GROUP BY ALL), w AS (SELECT sku_id, weekofyear(week_start) AS wy, avg(units) AS a, count(*) AS c FROM ser GROUP BY ALL),
 g AS (SELECT *, unnest(range(1, 54)) AS wy FROM k)
SELECT g.sku_id, g.wy AS week_of_year, CASE WHEN n >= 26 AND m <> 0 AND a IS NOT NULL THEN a / m ELSE 1 END AS seasonal_index,
 CASE WHEN n >= 26 AND m <> 0 AND a IS NOT NULL THEN c ELSE 0 END AS sample_weeks, CASE WHEN n >= 26 AND m <> 0 AND a IS NOT NULL THEN a ELSE 0 END AS avg_weekly_sales
FROM g LEFT JOIN w ON w.sku_id = g.sku_id AND w.wy = g.wy""", "seasonal_index avg_weekly_sales", "week_of_year sample_weeks")
def _(spark, d):
    return se.seasonal_index(weekly(spark, d), K)


BLOCKS["ser_an0"] = """
SELECT *, CASE WHEN count(*) OVER w >= 4 THEN nullif(avg(units) OVER w, 0) END AS ma, CASE WHEN avg(units) OVER (PARTITION BY sku_id) < 3 THEN 3.5 ELSE 2.5 END AS thr FROM ser_n
WINDOW w AS (PARTITION BY sku_id ORDER BY week_start ROWS 12 PRECEDING)"""
BLOCKS["ser_an1"] = "SELECT *, coalesce(abs(units - ma) / ma > thr AND units > ma, false) AS pr FROM ser_an0"
BLOCKS["ser_an"] = "SELECT *, coalesce(abs(units - ma) / ma > 3, false) AND NOT pr AS ol FROM ser_an1"


@query("anomaly_flags", "SELECT sku_id, week_start, units, pr::INT AS is_promo, ol::INT AS is_outlier FROM ser_an", "units")
def _(spark, d):
    return se.anomaly_flags(grid(spark, d), K)


BLOCKS["ser_silent"] = "SELECT sku_id FROM ser GROUP BY sku_id HAVING coalesce(sum(units) FILTER (week_start > (SELECT max(week_start) FROM ser) - 70), 0) <= 0"


@query("recency_split", """
SELECT sku_id, 1 AS is_silent, 0 AS row_n FROM ser_silent UNION ALL SELECT sku_id, 0, count(*) FROM ser WHERE sku_id NOT IN (SELECT sku_id FROM ser_silent) GROUP BY sku_id""", "", "is_silent row_n")
def _(spark, d):
    active, silent = se.recency_split(weekly(spark, d), K)
    return silent.select("sku_id", F.lit(1).alias("is_silent"), F.lit(0).alias("row_n")).unionByName(
        active.groupBy("sku_id").agg(F.lit(0).alias("is_silent"), F.count(F.lit(1)).alias("row_n")))


# ---- forecasts ----------------------------------------------------------------
RES_D = "forecast_4w forecast_8w confidence_low_4w confidence_high_4w confidence_low_8w confidence_high_8w"
_SHORT = lambda need: f"CASE WHEN n < {need} THEN 'Insufficient history: ' || n || ' weeks (need {need})' END"


def res_sql(src, method, f4, f8, s4, s8, err, fb="0", extra=""):
    e = f"({err}) IS NOT NULL"
    z = fc.Z95
    c = lambda good, bad: f"round_even(round(CASE WHEN {e} THEN {bad} ELSE {good} END, 6), 1)"
    return f"""SELECT sku_id, '{method}' AS method, {c(f4, f'({fb}) * 4')} AS forecast_4w, {c(f8, f'({fb}) * 8')} AS forecast_8w,
 {c(f'greatest(0, {f4} - {z} * {s4})', '0')} AS confidence_low_4w, {c(f'{f4} + {z} * {s4}', f'({fb}) * 4 * 2')} AS confidence_high_4w,
 {c(f'greatest(0, {f8} - {z} * {s8})', '0')} AS confidence_low_8w, {c(f'{f8} + {z} * {s8}', f'({fb}) * 8 * 2')} AS confidence_high_8w,
 n AS weeks_of_history, {err} AS error{extra} FROM {src}"""


BLOCKS["fc_ns0"] = """
SELECT sku_id, n, avg(units) AS m, sum(units) FILTER (rd BETWEEN 49 AND 52) AS t4, sum(units) FILTER (rd BETWEEN 45 AND 52) AS t8,
 stddev_samp(units) FILTER (rd BETWEEN 49 AND 52) AS d4, stddev_samp(units) FILTER (rd BETWEEN 45 AND 52) AS d8 FROM ser_n GROUP BY sku_id, n"""
BLOCKS["fc_ns"] = res_sql("fc_ns0", "naive_seasonal", "t4", "t8", "d4 * sqrt(4)", "d8 * sqrt(8)", _SHORT(56), "m")
BLOCKS["fc_cr0"] = """
SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY week_start DESC) - 1 AS back, count(*) OVER (PARTITION BY sku_id) AS ev,
 rn - coalesce(lag(rn) OVER (PARTITION BY sku_id ORDER BY week_start), 0) AS gap FROM ser_n WHERE units > 0"""
BLOCKS["fc_cr1"] = """
SELECT sku_id, max(ev) AS ev, sum(units * power(0.85, back) * CASE WHEN back = ev - 1 THEN 1 ELSE 0.15 END) AS ds, sum(gap * power(0.85, back) * CASE WHEN back = ev - 1 THEN 1 ELSE 0.15 END) AS qs,
 coalesce(stddev_samp(units), 0) AS sd FROM fc_cr0 GROUP BY sku_id"""
BLOCKS["fc_cr2"] = "SELECT sku_id, n, coalesce(ev, 0) AS ev, ds / qs * 0.925 AS rate, qs, fc_cr1.sd AS sd FROM ser_k LEFT JOIN fc_cr1 USING (sku_id) WHERE zs > 0.8"
BLOCKS["fc_cr"] = res_sql("fc_cr2", "crostons", "rate * 4", "rate * 8", "sd * sqrt(greatest(4 / qs, 1))", "sd * sqrt(greatest(8 / qs, 1))",
                          f"coalesce({_SHORT(8)}, CASE WHEN ev < 3 THEN 'Too few demand events: ' || ev || ' (need 3)' END)")
BLOCKS["fc_aa0"] = """
SELECT sku_id, n, avg(units) AS m, count(*) FILTER (NOT pr AND NOT ol) AS nc, quantile_cont(units, 0.5) FILTER (NOT pr AND NOT ol) AS base,
 coalesce(stddev_samp(units) FILTER (NOT pr AND NOT ol), 0) AS sd, count(*) FILTER (NOT pr AND NOT ol AND rd <= 13) AS nr,
 quantile_cont(units, 0.5) FILTER (NOT pr AND NOT ol AND rd <= 13) AS rec, count(*) FILTER (pr) AS np, count(*) FILTER (ol) AS no_ FROM ser_an GROUP BY sku_id, n"""
BLOCKS["fc_aa1"] = """
SELECT a.*, base * CASE WHEN base > 0 THEN CASE WHEN nr >= 4 THEN rec ELSE base END / base ELSE 1 END AS f FROM fc_aa0 a JOIN ser_k k USING (sku_id) WHERE zs <= 0.8"""
BLOCKS["fc_aa"] = res_sql("fc_aa1", "anomaly_adjusted", "f * 4", "f * 8", "sd * sqrt(4)", "sd * sqrt(8)",
                          f"coalesce({_SHORT(13)}, CASE WHEN nc < 4 THEN 'Too many anomalies: only ' || nc || ' clean weeks remain' END)", "m",
                          ", np AS anomalies_detected, no_ AS outliers_detected")


def _w(k):
    w = fc.LAG_WEIGHTS[k]
    return f"(CASE WHEN trend_consistency IN ('STRONG_GROWTH', 'STRONG_DECLINE') THEN {w * (1.5 if k <= 4 else 0.5 if k >= 26 else 1.0)} WHEN trend_consistency = 'UNSTABLE' THEN {w * (0.6 if k <= 4 else 1.5)} ELSE {w} END)::DOUBLE"


_NUM = " + ".join(f"coalesce(lag_{k}w * {_w(k)}, 0)" for k in fc.LAG_WEIGHTS)
_DEN = " + ".join(f"CASE WHEN lag_{k}w IS NOT NULL THEN {_w(k)} ELSE 0 END" for k in fc.LAG_WEIGHTS)
BLOCKS["fc_ms0"] = f"SELECT l.sku_id, l.n, m, sd, trend_consistency, ({_NUM}) / ({_DEN}) AS f FROM ser_msl l JOIN ser_k USING (sku_id)"
BLOCKS["fc_ms"] = res_sql("fc_ms0", "multi_scale_lag", "f * 4", "f * 8", "sd * sqrt(4)", "sd * sqrt(8)", _SHORT(8), "m",
                          ", CASE WHEN n < 8 THEN 'STABLE' ELSE trend_consistency END AS trend_consistency")


@query("fc_naive_seasonal", "SELECT * FROM fc_ns", RES_D, "weeks_of_history")
def _(spark, d):
    return fc.fc_naive_seasonal(folded(spark, d), K)


@query("fc_croston_sba", "SELECT * FROM fc_cr", RES_D, "weeks_of_history")
def _(spark, d):
    return fc.fc_croston_sba(folded(spark, d), K)


@query("fc_anomaly_adjusted", "SELECT * FROM fc_aa", RES_D, "weeks_of_history anomalies_detected outliers_detected")
def _(spark, d):
    return fc.fc_anomaly_adjusted(folded(spark, d), K)


@query("fc_multi_scale_lag", "SELECT * FROM fc_ms", RES_D, "weeks_of_history")
def _(spark, d):
    return fc.fc_multi_scale_lag(folded(spark, d), K)


# calendar twin: holiday table of the years around the future weeks
BLOCKS["cal_y"] = "SELECT unnest(range(1970, 2030)) AS y"
BLOCKS["cal_e0"] = "SELECT y, (19 * (y % 19) + 15) % 30 AS dd, y % 4 AS ya, y % 7 AS yb FROM cal_y"
BLOCKS["cal_e"] = """
SELECT y, make_date(y, (dd + ee + 114) // 31, (dd + ee + 114) % 31 + 1) + 13 AS easter FROM (SELECT *, (2 * ya + 4 * yb - dd + 34) % 7 AS ee FROM cal_e0)"""
BLOCKS["cal_h"] = """
SELECT y, make_date(y, m, d) AS hd, nm, ev FROM cal_y, (VALUES ('New Year''s Day', 1, 1, 'new_year'), ('New Year (Day 2)', 1, 2, 'new_year'), ('Unification Day', 1, 24, ''), ('Women''s Day', 3, 8, 'womens_day'),
 ('Labour Day', 5, 1, 'labour_day'), ('Children''s Day', 6, 1, ''), ('Assumption of Mary', 8, 15, ''), ('St. Andrew''s Day', 11, 30, ''), ('National Day', 12, 1, 'national_day'),
 ('Christmas Day', 12, 25, 'christmas'), ('Christmas (Day 2)', 12, 26, 'christmas')) f(nm, m, d, ev)
UNION ALL SELECT y, easter + o, nm, ev FROM cal_e, (VALUES ('Good Friday', -2, 'orthodox_easter'), ('Orthodox Easter', 0, 'orthodox_easter'), ('Easter Monday', 1, 'easter_monday'),
 ('Rusalii (Pentecost Saturday)', 49, 'rusalii'), ('Rusalii (Pentecost Sunday)', 50, 'rusalii')) e(nm, o, ev)
UNION ALL SELECT y, make_date(y, 11, 30) - CAST((isodow(make_date(y, 11, 30)) + 2) % 7 AS INTEGER), 'Black Friday', 'black_friday' FROM cal_y"""
BLOCKS["cal_w"] = """
SELECT nm, hd, hd - b AS a, hd + e AS z, mult FROM cal_h JOIN (VALUES ('orthodox_easter', 1.40::DOUBLE, 7, 2), ('christmas', 1.60, 14, 7), ('black_friday', 1.35, 3, 3), ('womens_day', 1.25, 5, 1),
 ('national_day', 1.20, 3, 1), ('new_year', 1.15, 3, 2), ('labour_day', 1.05, 1, 1), ('easter_monday', 1.20, 0, 1), ('rusalii', 1.10, 1, 1)) v(ev, mult, b, e) USING (ev)"""
BLOCKS["cal_d0"] = "SELECT CAST(unnest(generate_series(DATE '1985-01-07', DATE '2015-01-04', INTERVAL 1 DAY)) AS DATE) AS date"
BLOCKS["cal_d"] = """
SELECT date, coalesce(max(mult), 1) AS event_multiplier, arg_min(nm, (-mult, hd, nm)) AS holiday_name,
 (CASE WHEN month(date) BETWEEN 4 AND 9 THEN 1.15 ELSE 1 END * CASE WHEN month(date) IN (7, 8) THEN 0.8 ELSE 1 END)::DOUBLE AS season_multiplier,
 (abs(day(date) - 10) <= 2 OR abs(day(date) - 25) <= 2)::INT AS is_pay_period, CASE WHEN abs(day(date) - 10) <= 2 OR abs(day(date) - 25) <= 2 THEN 1.1 ELSE 1 END::DOUBLE AS pay_multiplier
FROM cal_d0 LEFT JOIN cal_w ON date BETWEEN a AND z GROUP BY date"""
BLOCKS["cal_wk"] = """
SELECT *, round(event_multiplier * season_multiplier * pay_multiplier, 4) AS combined_multiplier FROM (
 SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, max(event_multiplier) AS event_multiplier, arg_min(holiday_name, (-event_multiplier, date)) AS holiday_name,
 max(season_multiplier) FILTER (isodow(date) = 4) AS season_multiplier, max(pay_multiplier) FILTER (isodow(date) = 4) AS pay_multiplier, max(is_pay_period) AS is_pay_period FROM cal_d GROUP BY CAST(date_trunc('week', date) AS DATE))"""
BLOCKS["fc_ce0"] = """
SELECT sku_id, n, max(week_start) AS lw, avg(units) AS m0, avg(clean_units) AS m, coalesce(stddev_samp(clean_units), 0) AS sd, quantile_cont(clean_units, 0.5) FILTER (rd <= 13) AS r13,
 quantile_cont(clean_units, 0.5) AS rall FROM ser_clean GROUP BY sku_id, n"""
BLOCKS["fc_ce1"] = "SELECT *, CASE WHEN r13 > 0 THEN r13 ELSE rall END AS base, unnest(range(1, 9)) AS step FROM fc_ce0"
BLOCKS["fc_ce2"] = """
SELECT c.*, base * CASE WHEN n >= 26 AND m <> 0 AND i.a IS NOT NULL THEN i.a / m ELSE 1 END * combined_multiplier AS v, event_multiplier, combined_multiplier, holiday_name
FROM fc_ce1 c JOIN cal_wk k ON k.week_start = lw + CAST(7 * step AS INTEGER)
LEFT JOIN (SELECT sku_id, weekofyear(week_start) AS wy, avg(clean_units) AS a FROM ser_clean GROUP BY ALL) i ON i.sku_id = c.sku_id AND i.wy = weekofyear(lw + CAST(7 * step AS INTEGER))"""
BLOCKS["fc_ce3"] = """
SELECT sku_id, n, m0, base, sd, sum(v) FILTER (step <= 4) AS f4, sum(v) AS f8,
 arg_max(holiday_name, (combined_multiplier, -step)) FILTER (event_multiplier > 1 AND combined_multiplier > 1) AS pk FROM fc_ce2 GROUP BY sku_id, n, m0, base, sd"""
_CEE = f"coalesce({_SHORT(8)}, CASE WHEN base <= 0 THEN 'Zero or negative base demand after cleaning' END)"
BLOCKS["fc_ce"] = res_sql("fc_ce3", "calendar_events", "f4", "f8", "sd * sqrt(4)", "sd * sqrt(8)", _CEE, "m0", f", CASE WHEN {_CEE} IS NULL THEN pk END AS peak_event")


@query("fc_calendar_events", "SELECT * FROM fc_ce", RES_D, "weeks_of_history")
def _(spark, d):
    return fc.fc_calendar_events(folded(spark, d), K)


BLOCKS["fc_cat0"] = "SELECT category, week_start, sum(units) AS t, row_number() OVER (PARTITION BY category ORDER BY week_start DESC) AS rd FROM ser GROUP BY category, week_start"
BLOCKS["fc_cat1"] = """
SELECT category, count(*) AS cw, avg(t) FILTER (rd <= 4) AS cr, CASE WHEN count(*) >= 56 THEN avg(t) FILTER (rd BETWEEN 53 AND 56) ELSE avg(t) FILTER (rd <= 52) END AS cy FROM fc_cat0 GROUP BY category"""
BLOCKS["fc_cat2"] = "SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY week_start DESC) AS rd FROM ser"
BLOCKS["fc_cat3"] = """
SELECT s.sku_id, count(*) AS n, coalesce(stddev_samp(s.units), 0) AS sd, sum(s.units) FILTER (s.rd <= 4) AS mine, sum(t) FILTER (s.rd <= 4) AS al, max(s.category) AS category, avg(s.units) FILTER (s.rd <= 4) AS own_recent,
 CASE WHEN count(*) >= 56 THEN avg(s.units) FILTER (s.rd BETWEEN 53 AND 56) ELSE avg(s.units) END AS own_year FROM fc_cat2 s JOIN fc_cat0 c ON c.category = s.category AND c.week_start = s.week_start GROUP BY s.sku_id"""
BLOCKS["fc_cat4"] = """
SELECT *, CASE WHEN cy > 0 THEN cr / cy ELSE 1 END AS ratio, cr * CASE WHEN cy > 0 THEN cr / cy ELSE 1 END * CASE WHEN al > 0 THEN mine / al ELSE 0 END AS f FROM fc_cat3 JOIN fc_cat1 USING (category)"""
_CTE = ("coalesce(CASE WHEN cw < 8 THEN 'Category: insufficient history (' || cw || ' weeks, need 8)' END, "
        "CASE WHEN n < 8 THEN 'Insufficient SKU history: ' || n || ' weeks (need 8)' END)")
_CT = {"category_forecast_4w": "cr * ratio * 4", "category_forecast_8w": "cr * ratio * 8", "sku_share_of_category": "CASE WHEN al > 0 THEN mine / al ELSE 0 END",
       "sku_performance_vs_category": "CASE WHEN own_year * ratio > 0 THEN own_recent / (own_year * ratio) ELSE 1 END", "category_yoy_ratio": "ratio"}
_CT_DIGITS = dict(zip(_CT, (1, 1, 4, 3, 3)))
BLOCKS["fc_ct"] = res_sql("fc_cat4", "category_relative", "f * 4", "f * 8", "sd * sqrt(4)", "sd * sqrt(8)", _CTE, "0",
                          f", CASE WHEN {_CTE} IS NOT NULL THEN 'STABLE' WHEN ratio > 1.03 THEN 'GROWING' WHEN ratio < 0.97 THEN 'DECLINING' ELSE 'STABLE' END AS category_trend"
                          + "".join(f", CASE WHEN {_CTE} IS NOT NULL THEN 0 ELSE round({x} + 1e-9, {_CT_DIGITS[n]}) END AS {n}" for n, x in _CT.items()))


@query("fc_category_relative", "SELECT * FROM fc_ct", RES_D, "weeks_of_history")
def _(spark, d):
    return fc.fc_category_relative(weekly(spark, d), K)


_HOLT = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a in fc.HOLT_GRID for b in fc.HOLT_GRID)
BLOCKS["fc_ht0"] = "SELECT sku_id, list(units::DOUBLE ORDER BY week_start) AS s, count(*) AS n, avg(units) AS m FROM ser_grid GROUP BY sku_id"
BLOCKS["fc_ht1"] = f"""
SELECT sku_id, n, m, a, b, list_reduce(list_transform(list_concat([NULL], s[2:]), lambda x: {{'l': coalesce(x, s[1]), 't': CASE WHEN n > 1 THEN s[2] - s[1] ELSE 0 END, 'e': 0::DOUBLE}}),
 lambda st, y: {{'l': a * y.l + (1 - a) * (st.l + st.t), 't': b * (a * y.l + (1 - a) * (st.l + st.t) - st.l) + (1 - b) * st.t,
  'e': st.e + (y.l - (st.l + st.t)) * (y.l - (st.l + st.t))}}) AS f FROM fc_ht0 CROSS JOIN (VALUES {_HOLT}) g(a, b)"""
BLOCKS["fc_ht2"] = """
SELECT *, sqrt(f.e / greatest(n - 1, 1)) AS sd, list_sum(list_transform(range(1, 5), lambda k: greatest(0, f.l + f.t * k))) AS a4, list_sum(list_transform(range(1, 9), lambda k: greatest(0, f.l + f.t * k))) AS a8
FROM fc_ht1 QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY f.e, a, b) = 1"""
BLOCKS["fc_ht"] = res_sql("fc_ht2", "holt_trend", "a4", "a8", "sd * sqrt(4)", "sd * sqrt(8)", _SHORT(52), "m",
                          ", CASE WHEN f.t > 0.5 THEN 'GROWING' WHEN f.t < -0.5 THEN 'DECLINING' ELSE 'STABLE' END AS trend")


@query("fc_holt_trend", "SELECT * FROM fc_ht", RES_D, "weeks_of_history")
def _(spark, d):
    return fc.fc_holt_trend(folded(spark, d), K)


_RC = "sku_id, method, " + ", ".join(RES_D.split()) + ", weeks_of_history, error"
BLOCKS["fc_all"] = " UNION ALL ".join(f"SELECT {_RC} FROM {b}" for b in ("fc_ns", "fc_cr", "fc_aa", "fc_ms", "fc_ce", "fc_ct"))


def methods(spark, d):
    w = fx.shared(spark, d, "series", lambda: weekly(spark, d))
    f = fx.shared(spark, d, "folded", lambda: se.fold_series(w, K))
    return w, fx.shared(spark, d, "methods", lambda: fc.all_methods(w, K, f))


BLOCKS["ens_l"] = """
SELECT sku_id, coalesce(min(confidence_low_4w) FILTER (error IS NULL), 0) AS confidence_low_4w, coalesce(max(confidence_high_4w) FILTER (error IS NULL), 0) AS confidence_high_4w,
 coalesce(min(confidence_low_8w) FILTER (error IS NULL), 0) AS confidence_low_8w, coalesce(max(confidence_high_8w) FILTER (error IS NULL), 0) AS confidence_high_8w,
 count(*) FILTER (error IS NULL) AS methods_succeeded, count(*) FILTER (error IS NOT NULL) AS methods_failed,
 stddev_samp(forecast_4w) FILTER (error IS NULL) AS sd4, stddev_samp(forecast_8w) FILTER (error IS NULL) AS sd8,
 list_sort(list(forecast_4w) FILTER (error IS NULL)) AS l4, list_sort(list(forecast_8w) FILTER (error IS NULL)) AS l8 FROM fc_all GROUP BY sku_id"""
BLOCKS["ens0"] = """
SELECT *, (l4[(methods_succeeded + 1) // 2] + l4[methods_succeeded // 2 + 1]) / 2 AS med4, (l8[(methods_succeeded + 1) // 2] + l8[methods_succeeded // 2 + 1]) / 2 AS med8,
 list_sum(l4) / nullif(methods_succeeded, 0) AS avg4, list_sum(l8) / nullif(methods_succeeded, 0) AS avg8 FROM ens_l"""
_DIS = lambda h: f"CASE WHEN methods_succeeded < 2 OR avg{h} = 0 THEN 'LOW' WHEN sd{h} / avg{h} < 0.15 THEN 'LOW' WHEN sd{h} / avg{h} < 0.3 THEN 'MEDIUM' ELSE 'HIGH' END"


def ens_sql(f4, f8, name, src="ens0"):
    return f"""SELECT sku_id, round_even(round(coalesce({f4}, 0), 6), 1) AS forecast_4w, round_even(round(coalesce({f8}, 0), 6), 1) AS forecast_8w, round_even(confidence_low_4w, 1) AS confidence_low_4w,
 round_even(confidence_high_4w, 1) AS confidence_high_4w, round_even(confidence_low_8w, 1) AS confidence_low_8w, round_even(confidence_high_8w, 1) AS confidence_high_8w,
 methods_succeeded, methods_failed, {_DIS(4)} AS method_disagreement_4w, {_DIS(8)} AS method_disagreement_8w, '{name}' AS aggregation_method FROM {src}"""


_TRIM = lambda h: f"CASE WHEN methods_succeeded < 3 THEN med{h} ELSE list_sum(list_slice(l{h}, 2, methods_succeeded - 1)) / (methods_succeeded - 2) END"
BLOCKS["ens_med"] = ens_sql("med4", "med8", "median")
ENS_N = "methods_succeeded methods_failed"


def _ensemble(spark, d, how):
    w, m = methods(spark, d)
    return fc.ensemble_combine(m, K, how)


@query("ensemble_combine", "SELECT * FROM ens_med", RES_D, ENS_N)
def _(spark, d):
    return _ensemble(spark, d, "median")


@query("ensemble_trimmed_mean", ens_sql(_TRIM(4), _TRIM(8), "trimmed_mean"), RES_D, ENS_N)
def _(spark, d):
    return _ensemble(spark, d, "trimmed_mean")


@query("ensemble_equal_weight", ens_sql("avg4", "avg8", "equal_weight"), RES_D, ENS_N)
def _(spark, d):
    return _ensemble(spark, d, "equal_weight")


BLOCKS["silent_fc"] = """SELECT sku_id, 0.0::DOUBLE AS forecast_4w, 0.0::DOUBLE AS forecast_8w, 0.0::DOUBLE AS confidence_low_4w, 0.0::DOUBLE AS confidence_high_4w,
 0.0::DOUBLE AS confidence_low_8w, 0.0::DOUBLE AS confidence_high_8w, 0 AS methods_succeeded, 0 AS methods_failed, 'LOW' AS method_disagreement_4w, 'LOW' AS method_disagreement_8w,
 'silent' AS aggregation_method FROM ser_silent"""


@query("silent_zero_forecasts", "SELECT * FROM silent_fc", RES_D, ENS_N)
def _(spark, d):
    return fc.silent_zero_forecasts(se.recency_split(weekly(spark, d), K)[1], K)


BLOCKS["prof0"] = "SELECT sku_id, month(week_start) AS m, sum(units) AS s FROM ser GROUP BY ALL"
BLOCKS["prof1"] = "SELECT sku_id, avg(s) AS av, count(*) AS mo FROM prof0 GROUP BY ALL"
BLOCKS["prof2"] = """
SELECT p.sku_id, g.m, CASE WHEN mo >= 6 AND av <> 0 THEN coalesce(least(3, greatest(0.2, s / av)), 1) ELSE 1 END::DOUBLE AS x FROM prof1 p, (SELECT unnest(range(1, 13)) AS m) g
LEFT JOIN prof0 q ON q.sku_id = p.sku_id AND q.m = g.m"""
BLOCKS["prof3"] = "SELECT sku_id, CASE WHEN mo >= 6 AND av <> 0 THEN cv ELSE 0 END AS cv, mo FROM (SELECT sku_id, stddev_samp(x) / avg(x) AS cv FROM prof2 GROUP BY ALL) JOIN prof1 USING (sku_id)"
BLOCKS["prof4"] = """
SELECT sku_id, avg(x) FILTER (k <= 4) AS x4, avg(x) AS x8 FROM (SELECT unnest(range(1, 9)) AS k) JOIN prof2 ON m = month((SELECT max(week_start) FROM ser) + CAST(7 * k AS INTEGER)) GROUP BY sku_id"""


def damp_sql(src):
    x = lambda c, k: f"CASE WHEN cv > 0.5 THEN round_even(round({c} * {k}, 6), 1) ELSE {c} END AS {c}"
    return f"""SELECT e.sku_id, {x('forecast_4w', 'x4')}, {x('forecast_8w', 'x8')}, {x('confidence_low_4w', 'x4')}, {x('confidence_high_4w', 'x4')}, {x('confidence_low_8w', 'x8')},
 {x('confidence_high_8w', 'x8')}, methods_succeeded, methods_failed, method_disagreement_4w, method_disagreement_8w, aggregation_method, (coalesce(cv, 0) > 0.5)::INT AS seasonal_dampening_applied,
 CASE WHEN cv > 0.5 THEN round(round(x4, 6), 3) END AS seasonal_multiplier_4w, CASE WHEN cv > 0.5 THEN round(round(x8, 6), 3) END AS seasonal_multiplier_8w
 FROM {src} e LEFT JOIN prof3 USING (sku_id) LEFT JOIN prof4 USING (sku_id)"""


DAMP_D = RES_D + " seasonal_multiplier_4w seasonal_multiplier_8w"


@query("monthly_profiles", "SELECT sku_id, cv AS seasonal_cv, mo AS months_observed, (cv > 0.5)::INT AS is_seasonal FROM prof3", "seasonal_cv", "months_observed is_seasonal")
def _(spark, d):
    return fc.monthly_profiles(weekly(spark, d), K).drop("multipliers")


@query("seasonal_dampen", damp_sql("ens_med"), DAMP_D, ENS_N + " seasonal_dampening_applied")
def _(spark, d):
    w, m = methods(spark, d)
    return fc.seasonal_dampen(fc.ensemble_combine(m, K), w, K)


_BIAS = {"naive_seasonal": 0.1, "crostons": -0.2, "anomaly_adjusted": -0.3, "multi_scale_lag": 0.05, "calendar_events": 0.3}


def bias_table(spark):
    return spark.createDataFrame(list(_BIAS.items()), "method string, bias_capped double")


def bias_sql(src):
    return f"""
SELECT sku_id, method, {', '.join(f'CASE WHEN error IS NULL AND b IS NOT NULL THEN greatest(0, {c} / (1 + b)) ELSE {c} END AS {c}' for c in RES_D.split())}, weeks_of_history, error
FROM {src} LEFT JOIN (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _BIAS.items())}) t(method, b) USING (method)"""


@query("bias_correct", bias_sql("fc_all"), RES_D, "weeks_of_history")
def _(spark, d):
    return fc.bias_correct(methods(spark, d)[1], bias_table(spark))


@query("category_method_routing", f"""
SELECT f.* FROM fc_all f JOIN (SELECT sku_id, max(category) AS category FROM ser GROUP BY ALL) c USING (sku_id)
WHERE NOT (category = 'ECONOMY' AND method = 'calendar_events') AND NOT (category = 'PROMO' AND method = 'category_relative')""", RES_D, "weeks_of_history")
def _(spark, d):
    w, m = methods(spark, d)
    rules = spark.createDataFrame([("ECONOMY", "calendar_events"), ("PROMO", "category_relative")], "category string, method string")
    return fc.category_method_routing(m, w.groupBy("sku_id").agg(F.max("category").alias("category")), rules)


BLOCKS["act_ser"] = "SELECT * FROM ser WHERE sku_id NOT IN (SELECT sku_id FROM ser_silent)"


def on_active(name, kept=("ser_silent",)):
    """Block ``name`` over the active series: every block on its way to ``ser`` once more, as act_<block>."""
    if name in kept or name not in BLOCKS:
        return name
    if f"act_{name}" in BLOCKS:
        return f"act_{name}"
    sql = re.sub(r"\w+", lambda w: on_active(w[0], kept + (name,)), BLOCKS[name])
    if sql == BLOCKS[name]:
        return name
    BLOCKS[f"act_{name}"] = sql
    return f"act_{name}"


BLOCKS["act_raw"] = f"SELECT * FROM {on_active('fc_all')}"
BLOCKS["act_bias"] = f"SELECT {_RC} FROM ({bias_sql('act_raw')})"
BLOCKS["act_ens_l"] = BLOCKS["ens_l"].replace("fc_all", "act_bias")
BLOCKS["act_ens0"] = BLOCKS["ens0"].replace("ens_l", "act_ens_l")
BLOCKS["act_ens_med"] = ens_sql("med4", "med8", "median", "act_ens0")
for _b in ("prof3", "prof4"):
    on_active(_b)
ENSEMBLE_SQL = f"""{damp_sql("act_ens_med").replace("prof3", "act_prof3").replace("prof4", "act_prof4")}
UNION ALL SELECT *, 0, NULL, NULL FROM silent_fc"""


def ensemble(spark, d):
    """Recency split, methods, ensemble, dampening, silent keys put back."""
    w = cut_lineage(weekly(spark, d))
    active, silent = se.recency_split(w, K)
    m = fc.all_methods(active, K, cut_lineage(se.fold_series(active, K)))
    e = fc.seasonal_dampen(fc.ensemble_combine(fc.bias_correct(m, bias_table(spark)), K), active, K)
    return e.unionByName(fc.silent_zero_forecasts(silent, K), allowMissingColumns=True).fillna(0, ["seasonal_dampening_applied"])


@query("ensemble_forecast", ENSEMBLE_SQL, DAMP_D, ENS_N + " seasonal_dampening_applied")
def _(spark, d):
    return ensemble(spark, d)


@query("forecast_by_sku", f"SELECT {_RC} FROM fc_all WHERE sku_id = (SELECT min(sku_id) FROM fc_all)", RES_D, "weeks_of_history")
def _(spark, d):
    m = methods(spark, d)[1]
    first = m.groupBy().agg(F.min("sku_id").alias("sku_id"))
    return m.join(first, "sku_id", "left_semi")


@query("forecast_by_category", """
SELECT e.sku_id, category, forecast_4w, forecast_8w, methods_succeeded FROM ens_med e JOIN (SELECT sku_id, max(category) AS category FROM ser GROUP BY ALL) USING (sku_id)""",
       "forecast_4w forecast_8w", "methods_succeeded")
def _(spark, d):
    w, m = methods(spark, d)
    cats = w.groupBy("sku_id").agg(F.max("category").alias("category"))
    out = fc.forecast_by_category(fc.ensemble_combine(m, K), cats, K)
    return out.select("sku_id", "category", "forecast_4w", "forecast_8w", "methods_succeeded").orderBy("category", F.desc("forecast_4w"), "sku_id")


@query("method_comparison", f"SELECT {_RC}, (error IS NOT NULL)::INT AS failed FROM fc_all WHERE method = 'calendar_events'", RES_D, "weeks_of_history failed")
def _(spark, d):
    return fc.method_comparison(methods(spark, d)[1], "calendar_events").orderBy("failed", F.desc("forecast_4w"), "sku_id")


@query("forecast_refresh_summary", """
SELECT count(*) AS keys_forecast, count(*) FILTER (methods_succeeded >= 1) AS keys_with_method, count(*) FILTER (methods_succeeded = 0) AS keys_without_method FROM ens_med""", "",
       "keys_forecast keys_with_method keys_without_method")
def _(spark, d):
    return fc.refresh_summary(fc.ensemble_combine(methods(spark, d)[1], K))


METHODS = ["anomaly_adjusted", "calendar_events", "category_relative", "crostons", "multi_scale_lag", "naive_seasonal"]
_ONE = ", ".join(f"max({c}) FILTER (method = '{m}') AS {m}_{c}" for m in METHODS for c in ("forecast_4w", "forecast_8w", "error"))


@query("export_predictions", f"SELECT * FROM ens_med JOIN (SELECT sku_id, {_ONE} FROM fc_all GROUP BY sku_id) USING (sku_id)",
       RES_D + " " + " ".join(f"{m}_{c}" for m in METHODS for c in ("forecast_4w", "forecast_8w")), ENS_N)
def _(spark, d):
    m = methods(spark, d)[1]
    return fc.export_wide(m, fc.ensemble_combine(m, K), K, METHODS)


# ---- calendar ----------------------------------------------------------------
@query("calendar_day_features", """
SELECT date, (event_multiplier > 1)::INT AS is_holiday, holiday_name, event_multiplier, (month(date) BETWEEN 4 AND 9)::INT AS is_building_season, (month(date) IN (7, 8))::INT AS is_summer_lull,
 is_pay_period, season_multiplier, pay_multiplier, round(event_multiplier * season_multiplier * pay_multiplier, 4) AS combined_multiplier
FROM cal_d WHERE date IN (SELECT sale_date FROM txn_sparse)""", "event_multiplier season_multiplier pay_multiplier combined_multiplier")
def _(spark, d):
    from stocktide.functions.calendar import calendar_days
    return calendar_days(fx.txn(spark, d, parts=False, stores=False), "sale_date")


@query("calendar_week_features", "SELECT * FROM cal_wk WHERE week_start IN (SELECT week_start FROM txn_sparse)", "event_multiplier season_multiplier pay_multiplier combined_multiplier")
def _(spark, d):
    from stocktide.functions.calendar import calendar_weeks
    return calendar_weeks(fx.txn(spark, d, parts=False, stores=False))


@query("holiday_dim", """
SELECT y AS year, hd AS holiday_date, nm AS holiday_name, ev AS event_key, coalesce(n, 0) AS line_count FROM cal_h LEFT JOIN (SELECT sale_date, count(*) AS n FROM txn_sparse GROUP BY ALL) ON sale_date = hd
WHERE y IN (SELECT year(sale_date) FROM txn_sparse)""", "", "year line_count")
def _(spark, d):
    from stocktide.functions.calendar import holiday_dim
    t = fx.txn(spark, d, parts=False, stores=False)
    lines = t.groupBy(F.col("sale_date").alias("holiday_date")).agg(F.count(F.lit(1)).alias("line_count"))
    return holiday_dim(t.select(F.year("sale_date").alias("year")).distinct()).join(lines, "holiday_date", "left").fillna(0, ["line_count"])


@query("orthodox_easter", """
SELECT easter, count(*) AS line_count, sum(sale_date - easter) AS days_sum FROM txn_sparse JOIN cal_e ON y = year(sale_date) GROUP BY easter""".replace("ON y =", "ON cal_e.y ="), "", "line_count days_sum")
def _(spark, d):
    from stocktide.functions.calendar import orthodox_easter
    t = fx.txn(spark, d, parts=False, stores=False).withColumn("easter", orthodox_easter(F.year("sale_date")))
    return t.groupBy("easter").agg(F.count(F.lit(1)).alias("line_count"), F.sum(F.datediff("sale_date", "easter")).alias("days_sum"))
