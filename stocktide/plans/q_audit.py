"""Blends, policies, candidate grids and audits over the routed feature matrix.

The operators take any prediction columns; here the naive forecasts stand in
for trained ones, so that every result can be compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktide.operators import audit as au
from stocktide.operators import blend as bl
from stocktide.operators import score as sc
from stocktide.plans import fixtures as fx
from stocktide.plans.fixtures import TARGETS
from stocktide.plans.oracle import BLOCKS
from stocktide.plans.q_core import METRICS_SQL, chain
from stocktide.plans.q_features import routed
from stocktide.plans.registry import query
from stocktide.session import staged

CARRY = ["primary_route", "calendar_route_context", "stock_position_confidence", "intermittency_bucket", "category_norm", "product_family_v2", "revenue_rank"]
CONTROL, TREES, SECOND = "median_naive", "roll8_mean", "seasonal52"
MD, MN = sc.METRIC_DOUBLES, sc.METRIC_LONGS


def models(spark, d):
    cols = {m: F.col(m) for m in ("last4", "roll8_mean", "roll13_mean", "seasonal52", "median_naive")} | {"post_bf_safe_naive": bl.post_bf_safe_naive()}
    return fx.shared(spark, d, "models", lambda: bl.candidate_rows(routed(spark, d), cols, CARRY), staged)


def per_model(spark, d, candidates):
    """Metrics per target and candidate."""
    return bl.model_table(bl.candidate_rows(routed(spark, d), candidates, []), ["target_start", "model_name"])


# ---- comparison SQL ------------------------------------------------------------
_STRESS = "(target_is_post_bf_4w = 1 AND bf_unit_share_4w > 0)"
_MED3 = lambda a, b, c: f"list_sort([{a}, {b}, {c}])[2]"
_GREG = "(primary_route IN ('available_regular', 'proxy_available_regular') AND calendar_route_context = 'normal_calendar')"
_CAMP = "primary_route = 'bf_campaign_sensitive'"
_CHIST = f"({_CAMP} OR coalesce(campaign_txn_13w, 0) > 0 OR coalesce(bf_txn_13w, 0) > 0)"
_BFCAL = "(calendar_route_context <> 'normal_calendar' OR coalesce(bf_txn_13w, 0) > 0)"
BLOCKS["pol"] = f"""
SELECT *, greatest(0, CASE WHEN {_STRESS} THEN {_MED3('non_bf_pos_units_4w_equiv', 'roll13_mean', 'seasonal52')} ELSE median_naive END) AS safe,
 median_naive AS control, roll8_mean AS trees FROM rtx"""


def cand_sql(cands: dict[str, str], carry="") -> str:
    names = ", ".join(f"'{n}'" for n in cands)
    vals = ", ".join(f"greatest(0, {e})" for e in cands.values())
    return f"""
SELECT *, CASE WHEN actual_units >= 4 THEN abs_error / actual_units END AS abs_pct_error, CASE WHEN actual_units >= 4 THEN CAST(abs_error / actual_units <= 0.2 AS DOUBLE) END AS hit20,
 CASE WHEN actual_units >= 4 THEN CAST(abs_error / actual_units <= 0.3 AS DOUBLE) END AS hit30, CASE WHEN actual_units >= 4 THEN CAST(pred_units < 0.8 * actual_units AS DOUBLE) END AS under20,
 CASE WHEN actual_units >= 4 THEN CAST(pred_units > 1.2 * actual_units AS DOUBLE) END AS over20, CASE WHEN actual_units >= 4 THEN 1 ELSE 0 END AS quantity_scored,
 CASE WHEN actual_units = 0 AND pred_units >= 1 THEN 1 ELSE 0 END AS phantom, CASE WHEN pred_units >= 1 THEN 1 ELSE 0 END AS pred_sale
FROM (SELECT *, abs(pred_units - actual_units) AS abs_error, pred_units - actual_units AS signed_error FROM (
 SELECT target_start, sku_id, actual_pos_units_4w AS actual_units, actual_net_revenue_4w AS actual_revenue, {carry} unnest([{names}]) AS model_name, unnest([{vals}]) AS pred_units FROM pol))"""


BLOCKS["mrows"] = cand_sql({m: m for m in ("last4", "roll8_mean", "roll13_mean", "seasonal52", "median_naive")} | {"post_bf_safe_naive": "safe"}, ", ".join(CARRY) + ",")
_PM = lambda c: f"SELECT target_start, model_name, {METRICS_SQL} FROM ({cand_sql(c)}) GROUP BY target_start, model_name"

# ---- empirical blend and tuning --------------------------------------------------
_GRID = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(bl.SIMPLEX))
BLOCKS["eb_eval"] = "SELECT target_start AS eval_start FROM (SELECT target_start, row_number() OVER (ORDER BY target_start) AS k FROM targets) WHERE k > 4"
BLOCKS["eb_train"] = "SELECT *, actual_pos_units_4w AS actual_units FROM fmx WHERE headline_eligible = 1"
BLOCKS["eb_g"] = f"SELECT * FROM (VALUES {_GRID}) g(i, w1, w2, w3)"
BLOCKS["eb_s"] = """
SELECT eval_start, i, w1, w2, w3, count(*) FILTER (abs(p - a) / a <= 0.2) / count(*) AS hit, sum(abs(p - a)) / sum(a) AS wm, abs(sum(p - a) / sum(a)) AS bi FROM (
 SELECT eval_start, i, w1, w2, w3, actual_units AS a, last4 * w1 + roll13_mean * w2 + seasonal52 * w3 AS p FROM eb_train, eb_g, eb_eval WHERE target_start < eval_start AND actual_units >= 4) GROUP BY ALL"""
BLOCKS["eb_w"] = "SELECT * FROM eb_s QUALIFY row_number() OVER (PARTITION BY eval_start ORDER BY round(hit, 9) DESC, round(wm, 9), round(bi, 9), i) = 1"
BLOCKS["eb_b"] = """
SELECT eval_start, sku_id, product_family_v2, category_norm, actual_units AS a, last4 * w1 + roll13_mean * w2 + seasonal52 * w3 AS b FROM eb_train JOIN eb_w ON target_start < eval_start
WHERE actual_units >= 4 AND last4 * w1 + roll13_mean * w2 + seasonal52 * w3 > 0"""
BLOCKS["eb_gl"] = "SELECT eval_start, least(2.5, greatest(0.35, sum(a) / sum(b))) AS g FROM eb_b GROUP BY ALL"


def _fac(key, prior, least):
    return f"""SELECT eval_start, {key}, least(2.5, greatest(0.35, (sum(a) + {prior} * max(g)) / (sum(b) + {prior}))) AS f FROM eb_b JOIN eb_gl USING (eval_start)
 GROUP BY eval_start, {key} HAVING count(*) >= {least}"""


BLOCKS["eb_p"] = f"""
SELECT l.target_start, l.sku_id, l.last4 * w1 + l.roll13_mean * w2 + l.seasonal52 * w3 AS base, coalesce(g, 1) AS g, s.f AS sf, m.f AS ff, c.f AS cf
FROM fmx l JOIN eb_w w ON w.eval_start = l.target_start LEFT JOIN eb_gl q ON q.eval_start = l.target_start
LEFT JOIN ({_fac('sku_id', 8, 2)}) s ON s.eval_start = l.target_start AND s.sku_id = l.sku_id
LEFT JOIN ({_fac('product_family_v2', 25, 8)}) m ON m.eval_start = l.target_start AND m.product_family_v2 = l.product_family_v2
LEFT JOIN ({_fac('category_norm', 60, 20)}) c ON c.eval_start = l.target_start AND c.category_norm = l.category_norm"""
BLOCKS["eb_f"] = """
SELECT *, least(3, greatest(0.2, CASE WHEN sf IS NOT NULL THEN 0.55 * sf + 0.25 * coalesce(ff, g) + 0.15 * coalesce(cf, g) + 0.05 * g
 WHEN ff IS NOT NULL THEN 0.65 * ff + 0.25 * coalesce(cf, g) + 0.10 * g WHEN cf IS NOT NULL THEN 0.65 * cf + 0.35 * g ELSE g END)) AS factor FROM eb_p"""


@query("fc_empirical_blend", "SELECT target_start, sku_id, 'direct_empirical_v1' AS model_name, factor, greatest(0, base * factor) AS pred_units_4w FROM eb_f", "factor pred_units_4w")
def _(spark, d):
    m = routed(spark, d).select(*sc.KEY, "headline_eligible", "product_family_v2", "category_norm", "last4", "roll13_mean", "seasonal52",
                                F.col("actual_pos_units_4w").alias("actual_units"))
    return bl.empirical_blend(m.drop("actual_units", "headline_eligible"), m.where("headline_eligible = 1"), TARGETS)


@query("blend_weights", "SELECT eval_start, w1 AS w_last4, w2 AS w_roll13, w3 AS w_seasonal, hit AS train_hit20, wm AS train_wmape FROM eb_w",
       "w_last4 w_roll13 w_seasonal train_hit20 train_wmape")
def _(spark, d):
    m = routed(spark, d).where("headline_eligible = 1").withColumn("actual_units", F.col("actual_pos_units_4w"))
    return bl.choose_weights(m, TARGETS)


_PG = ", ".join(f"({k}, {f}::DOUBLE, {z}::DOUBLE)" for k, (f, z) in enumerate((f, z) for f in bl.FACTORS for z in bl.FLOORS))
BLOCKS["pp_g"] = f"SELECT * FROM (VALUES {_PG}) g(i, factor, zero_floor)"
BLOCKS["pp_w"] = """
SELECT target_start, i, factor, zero_floor, count(*) FILTER (a >= 4) AS n, count(*) FILTER (a >= 4 AND abs(p - a) / a <= 0.2) AS h, sum(abs(p - a)) FILTER (a >= 4) AS e, sum(a) FILTER (a >= 4) AS aa,
 count(*) FILTER (a = 0) AS z, count(*) FILTER (a = 0 AND p >= 1) AS ph FROM (SELECT target_start, i, factor, zero_floor, actual_pos_units_4w AS a,
  CASE WHEN median_naive * factor < zero_floor THEN 0 ELSE median_naive * factor END AS p FROM fmx, pp_g) GROUP BY ALL"""
BLOCKS["pp_s"] = """
SELECT eval_start, i, factor, zero_floor, sum(h) / sum(n) AS hit, sum(e) / sum(aa) AS wm, sum(ph) / nullif(sum(z), 0) AS phr FROM pp_w JOIN eb_eval ON target_start < eval_start GROUP BY ALL"""
BLOCKS["pp_b"] = """SELECT * FROM pp_s QUALIFY row_number() OVER (PARTITION BY eval_start ORDER BY round(hit, 9) DESC, round(coalesce(phr, 1e9), 9), round(wm, 9), round(abs(1 - factor), 9), i) = 1"""


@query("postprocess_tune", "SELECT eval_start AS target_start, factor, zero_floor, hit AS train_hit20, wm AS train_wmape, phr AS train_phantom_rate FROM pp_b",
       "factor zero_floor train_hit20 train_wmape train_phantom_rate")
def _(spark, d):
    return bl.postprocess_tune(routed(spark, d).withColumn("actual_units", F.col("actual_pos_units_4w")), TARGETS, "median_naive")


@query("postprocess_apply", """
SELECT target_start, sku_id, CASE WHEN median_naive * coalesce(factor, 1) < coalesce(zero_floor, 0) THEN 0 ELSE median_naive * coalesce(factor, 1) END AS tuned_pred
FROM fmx LEFT JOIN pp_b ON eval_start = target_start""", "tuned_pred")
def _(spark, d):
    m = routed(spark, d)
    tuned = bl.postprocess_tune(m.withColumn("actual_units", F.col("actual_pos_units_4w")), TARGETS, "median_naive")
    return bl.postprocess(m, tuned, "median_naive").select(*sc.KEY, "tuned_pred")


# ---- policies ---------------------------------------------------------------------
@query("post_bf_safe_naive", "SELECT target_start, sku_id, safe AS pred_units FROM pol", "pred_units")
def _(spark, d):
    return routed(spark, d).select(*sc.KEY, bl.post_bf_safe_naive().alias("pred_units"))


@query("post_bf_cap", f"""
SELECT target_start, sku_id, CASE WHEN {_STRESS} AND last4_to_roll13 > 1.25 THEN least(last4, greatest(greatest(safe, roll13_mean, seasonal52) * 1.2, 1)) ELSE last4 END AS pred_units FROM pol""", "pred_units")
def _(spark, d):
    return routed(spark, d).select(*sc.KEY, bl.post_bf_cap(F.col("last4")).alias("pred_units"))


@query("prediction_blend", """
SELECT target_start, sku_id, list_sort([last4, roll8_mean, seasonal52])[2] AS blend_median, (list_sort([CASE WHEN last4 > 0 THEN last4 END, safe])[1] + coalesce(list_sort([CASE WHEN last4 > 0 THEN last4 END, safe], 'ASC', 'NULLS LAST')[2], safe)) / 2 AS blend_safe
FROM pol""".replace("list_sort([CASE WHEN last4 > 0 THEN last4 END, safe])[1]", "coalesce(CASE WHEN last4 > 0 THEN least(last4, safe) END, safe)").replace(
    "coalesce(list_sort([CASE WHEN last4 > 0 THEN last4 END, safe], 'ASC', 'NULLS LAST')[2], safe)", "coalesce(CASE WHEN last4 > 0 THEN greatest(last4, safe) END, safe)"), "blend_median blend_safe")
def _(spark, d):
    some = F.when(F.col("last4") > 0, F.col("last4"))
    return routed(spark, d).select(*sc.KEY, bl.prediction_blend(F.col("last4"), F.col("roll8_mean"), F.col("seasonal52")).alias("blend_median"),
                                   bl.prediction_blend(some, bl.post_bf_safe_naive()).alias("blend_safe"))


_CHAMP = f"greatest(0, CASE WHEN {_STRESS} THEN safe WHEN {_GREG} THEN trees ELSE control END)"
_BFC = lambda ctx, x, p: f"CASE WHEN {_CAMP} AND {ctx} AND {p} >= 3 THEN {p} * {x} ELSE {p} END"


def champion():
    return bl.policy_champion(F.col(CONTROL), F.col(TREES))


@query("policy_champion", f"SELECT target_start, sku_id, {_CHAMP} AS pred_units FROM pol", "pred_units")
def _(spark, d):
    return routed(spark, d).select(*sc.KEY, champion().alias("pred_units"))


@query("policy_lifts", f"""
SELECT target_start, sku_id, {_BFC("calendar_route_context <> 'post_bf_window'", 1.5, 'ch')} AS lift_non_post, {_BFC("calendar_route_context = 'pre_bf_window'", 1.8, 'ch')} AS lift_pre
FROM (SELECT *, {_CHAMP} AS ch FROM pol WHERE revenue_rank BETWEEN 1 AND 1000)""", "lift_non_post lift_pre")
def _(spark, d):
    top = routed(spark, d).where(F.col("revenue_rank").between(1, 1000)).withColumn("_ch", champion())
    return top.select(*sc.KEY, bl.policy_lift(F.col("_ch"), "non_post", 1000).alias("lift_non_post"), bl.policy_lift(F.col("_ch"), "pre", 1000).alias("lift_pre"))


_CC = {"campaign_safe_naive": f"CASE WHEN {_CHIST} THEN safe ELSE control END", "bf_calendar_safe_naive": f"CASE WHEN {_BFCAL} THEN safe ELSE control END",
       "campaign_conservative_pool": f"CASE WHEN {_CHIST} THEN {_MED3('safe', 'median_naive', 'control')} ELSE control END", "post_bf_hard_safe": f"CASE WHEN {_STRESS} THEN safe ELSE control END"}


@query("campaign_candidates", _PM(_CC), MD, MN)
def _(spark, d):
    return per_model(spark, d, bl.campaign_candidates(F.col(CONTROL)))


_RG = f"CASE WHEN {_GREG} THEN trees ELSE control END"
_CB = {"combined_regular_post_bf": f"CASE WHEN {_STRESS} THEN safe ELSE {_RG} END", "combined_bf_calendar": f"CASE WHEN {_BFCAL} THEN safe ELSE {_RG} END",
       "combined_guarded": f"CASE WHEN {_STRESS} THEN safe WHEN {_GREG} AND NOT {_CHIST} THEN trees ELSE control END"}


@query("combined_candidates", _PM(_CB), MD, MN)
def _(spark, d):
    return per_model(spark, d, bl.combined_candidates(F.col(CONTROL), F.col(TREES)))


_DEM = "active_weeks_52 >= 24 AND avg_units_per_4w_52 >= 2 AND calendar_route_context = 'normal_calendar'"
_SE = {"without_stock_gate": f"CASE WHEN {_STRESS} THEN safe ELSE control END", "demand_regular": f"CASE WHEN {_STRESS} THEN safe WHEN {_DEM} THEN trees ELSE control END",
       "demand_regular_no_campaign": f"CASE WHEN {_STRESS} THEN safe WHEN {_DEM} AND campaign_txn_13w <= 0 AND bf_txn_13w <= 0 THEN trees ELSE control END",
       "constrained_as_regular": f"CASE WHEN {_STRESS} THEN safe WHEN primary_route = 'stock_constrained' AND {_DEM} THEN trees ELSE {_CHAMP} END"}


@query("semantic_candidates", _PM(_SE), MD, MN)
def _(spark, d):
    return per_model(spark, d, bl.semantic_candidates(F.col(CONTROL), F.col(TREES), champion()))


_LIFT = lambda cond, fl, x: f"CASE WHEN {_CAMP} AND {cond} AND {_CHAMP} >= {fl} THEN {_CHAMP} * {x} ELSE {_CHAMP} END"
_CG = {f"regular_blend_{int(w * 100)}": f"CASE WHEN {_GREG} THEN {_CHAMP} * {1.0 - w}::DOUBLE + control * {w}::DOUBLE ELSE {_CHAMP} END" for w in (0.10, 0.25, 0.40)}
_CG |= {f"lift_{x}_non_post": _LIFT("calendar_route_context <> 'post_bf_window'", 3, x / 100) for x in (110, 120, 130, 140, 150)}
_CG |= {f"lift_{x}_pre_floor_{f}": _LIFT("calendar_route_context = 'pre_bf_window'", f, x / 100) for x, f in bl.PRE_WINDOW_LIFTS}
_CG |= {f"lift_{x}_non_post_no_dec_jan": _LIFT("calendar_route_context <> 'post_bf_window' AND target_month NOT IN (12, 1)", 3, x / 100) for x in bl.WINTER_FREE_LIFTS}


@query("calibration_grid", f"SELECT model_name, {METRICS_SQL} FROM ({cand_sql(_CG)}) GROUP BY model_name", MD, MN)
def _(spark, d):
    m = routed(spark, d).withColumn("_ch", champion())
    return bl.model_table(bl.candidate_rows(m, bl.calibration_candidates(F.col("_ch"), F.col(CONTROL)), []))


_PRIOR = """
SELECT eval_start, primary_route, model_name, sum(h) / sum(n) AS hit, sum(e) / sum(a) AS wm, sum(ph) / nullif(sum(z), 0) AS phr, sum(n) AS n FROM (
 SELECT target_start, primary_route, model_name, count(*) FILTER (quantity_scored = 1) AS n, count(*) FILTER (hit20 = 1) AS h, coalesce(sum(abs_error) FILTER (quantity_scored = 1), 0) AS e,
 coalesce(sum(actual_units) FILTER (quantity_scored = 1), 0) AS a, count(*) FILTER (actual_units = 0) AS z, sum(phantom) AS ph FROM mrows GROUP BY ALL)
JOIN (SELECT target_start AS eval_start FROM targets) ON target_start < eval_start GROUP BY ALL HAVING sum(n) >= 60"""
BLOCKS["rp_best"] = f"""SELECT eval_start AS target_start, primary_route, model_name AS best_model FROM ({_PRIOR})
 QUALIFY row_number() OVER (PARTITION BY eval_start, primary_route ORDER BY round(hit, 9) DESC, round(wm, 9), round(coalesce(phr, 1e9), 9), model_name DESC) = 1"""


@query("route_prior_best", """
SELECT target_start, sku_id, primary_route, 'route_prior_best' AS model_name, m.model_name AS used_model, pred_units FROM mrows m LEFT JOIN rp_best USING (target_start, primary_route)
WHERE m.model_name = coalesce(best_model, 'median_naive')""", "pred_units")
def _(spark, d):
    rows = models(spark, d)
    return bl.apply_route_best(rows, bl.route_prior_best(rows, TARGETS), CONTROL)


@query("route_prior_bias", """
SELECT eval_start AS target_start, primary_route, least(1.3, greatest(0.7, sum(actual_units) / sum(pred_units))) AS bias_factor
FROM mrows JOIN (SELECT target_start AS eval_start FROM targets) ON target_start < eval_start WHERE model_name = 'median_naive' AND quantity_scored = 1
GROUP BY eval_start, primary_route HAVING count(*) >= 60 AND sum(pred_units) > 0 AND sum(actual_units) > 0""", "bias_factor")
def _(spark, d):
    return bl.route_prior_bias(models(spark, d), TARGETS, CONTROL)


# ---- audits -------------------------------------------------------------------------
BLOCKS["scopes"] = "SELECT * FROM (VALUES ('top_100', 100), ('top_250', 250), ('top_500', 500), ('top_750', 750), ('top_1000', 1000), ('top_5000', 5000), ('all', NULL)) s(scope, lim)"
BLOCKS["scoped"] = "SELECT m.*, scope FROM mrows m JOIN scopes ON lim IS NULL OR (revenue_rank >= 1 AND revenue_rank <= lim)"


@query("revenue_scope_metrics", f"SELECT scope, model_name, {METRICS_SQL}, sum(actual_revenue) AS revenue FROM scoped GROUP BY scope, model_name", MD + " revenue", MN)
def _(spark, d):
    return au.revenue_scope_metrics(models(spark, d))


_GM = lambda g: f"""SELECT *, revenue / nullif(greatest(sum(revenue) OVER (PARTITION BY model_name), 0), 0) AS revenue_share FROM (
 SELECT model_name, {g} AS group_value, {METRICS_SQL}, sum(actual_revenue) AS revenue FROM mrows GROUP BY ALL)"""
BLOCKS["gm_all"] = " UNION ALL ".join(f"SELECT '{g}' AS group_name, * FROM ({_GM(g)})" for g in ("primary_route", "stock_position_confidence", "intermittency_bucket", "category_norm"))


@query("group_metrics", "SELECT * FROM gm_all WHERE n_quantity_scored >= 1", MD + " revenue revenue_share", MN)
def _(spark, d):
    rows = models(spark, d)
    out = None
    for g in ("primary_route", "stock_position_confidence", "intermittency_bucket", "category_norm"):
        part = sc.group_metrics(rows, g, 1).select(F.lit(g).alias("group_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("clean_regular_metrics", f"""
WITH m AS (SELECT scope, model_name, {METRICS_SQL} FROM scoped WHERE {_GREG} GROUP BY scope, model_name)
SELECT scope, model_name, hit20, wmape, n_quantity_scored FROM m WHERE n_quantity_scored > 0
QUALIFY row_number() OVER (PARTITION BY scope ORDER BY round(hit20, 9) DESC, round(coalesce(wmape, 999), 9), model_name DESC) = 1""", "hit20 wmape", "n_quantity_scored")
def _(spark, d):
    return au.best_by_scope(au.revenue_scope_metrics(au.clean_regular(models(spark, d))))


_F5 = ("hit20", "hit30", "wmape", "bias_pct", "phantom_rate")


def cmp_sql(cand, base, slices):
    u = " UNION ALL ".join(f"SELECT *, '{n}' AS slice FROM mrows WHERE {w}" for n, w in slices.items())
    at = lambda m, f: f"max({f}) FILTER (model_name = '{m}')"
    return f"""WITH m AS (SELECT slice, model_name, {METRICS_SQL} FROM ({u}) WHERE model_name IN ('{cand}', '{base}') GROUP BY slice, model_name)
SELECT slice, {at(cand, 'n_quantity_scored')} AS n_scored, {', '.join(f'{at(cand, f)} AS {f}_candidate, {at(base, f)} AS {f}_baseline, {at(cand, f)} - {at(base, f)} AS {f}_delta' for f in _F5)} FROM m GROUP BY slice"""


CMP_D = " ".join(f"{f}_{k}" for f in _F5 for k in ("candidate", "baseline", "delta"))
_SL = {"all": "true", "top_100": "revenue_rank BETWEEN 1 AND 100", "top_500": "revenue_rank BETWEEN 1 AND 500", "regular": _GREG, "stress": f"target_start = DATE '{TARGETS[5]}'"}


def slices():
    s = lambda n, c: F.when(c, F.lit(n))
    return F.array_compact(F.array(
        F.lit("all"), s("top_100", F.col("revenue_rank").between(1, 100)), s("top_500", F.col("revenue_rank").between(1, 500)),
        s("regular", F.col("primary_route").isin("available_regular", "proxy_available_regular") & (F.col("calendar_route_context") == "normal_calendar")), s("stress", F.col("target_start") == F.lit(TARGETS[5]))))


def comparison(spark, d):
    return au.compare_models(models(spark, d), "roll13_mean", CONTROL, slices())


BLOCKS["cmp0"] = cmp_sql("roll13_mean", CONTROL, _SL)
BLOCKS["cmp1"] = cmp_sql("roll13_mean", SECOND, {"all": "true"})
BLOCKS["worst0"] = f"""
WITH m AS (SELECT target_start, model_name, {METRICS_SQL} FROM mrows WHERE target_start <> DATE '{TARGETS[5]}' GROUP BY target_start, model_name)
SELECT target_start, max(wmape) FILTER (model_name = 'roll13_mean') - max(wmape) FILTER (model_name = 'median_naive') AS wmape_delta FROM m GROUP BY target_start
ORDER BY round(wmape_delta, 9) DESC, target_start LIMIT 1"""


@query("model_comparison", "SELECT * FROM cmp0", CMP_D, "n_scored")
def _(spark, d):
    return comparison(spark, d)


_RULES = [("hit20 on all", "all", "hit20", "min", 0.010), ("WMAPE on all", "all", "wmape", "max", 0.0), ("bias on all", "all", "bias_pct", "min_strict", 0.0),
          ("phantom on all", "all", "phantom_rate", "max", 0.0), ("hit20 on top 500", "top_500", "hit20", "min", 0.0), ("hit20 on top 100", "top_100", "hit20", "min", 0.0),
          ("WMAPE in the stress window", "stress", "wmape", "max", 0.0), ("largest WMAPE regression outside the stress window", "worst_window", "wmape", "max", 0.020),
          ("hit20 on all against the control", "control", "hit20", "min", 0.015), ("WMAPE on all against the control", "control", "wmape", "max", 0.005)]
BLOCKS["gate0"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{m}', {t}::DOUBLE)" for a, b, c, m, t in _RULES) + ") r(gate, slice, metric, mode, threshold)"
BLOCKS["gate1"] = """
SELECT gate, slice, metric, mode, threshold, CASE metric WHEN 'hit20' THEN hit20_delta WHEN 'wmape' THEN wmape_delta WHEN 'bias_pct' THEN bias_pct_delta ELSE phantom_rate_delta END AS observed
FROM gate0 LEFT JOIN (
 SELECT slice, hit20_delta, wmape_delta, bias_pct_delta, phantom_rate_delta FROM cmp0 UNION ALL
 SELECT 'control', hit20_delta, wmape_delta, bias_pct_delta, phantom_rate_delta FROM cmp1 WHERE slice = 'all' UNION ALL
 SELECT 'worst_window', NULL, wmape_delta, NULL, NULL FROM worst0) USING (slice)"""
BLOCKS["gate2"] = """
SELECT *, CASE WHEN coalesce(CASE mode WHEN 'min' THEN observed >= threshold WHEN 'min_strict' THEN observed > threshold ELSE observed <= threshold END, false) THEN 'PASS' ELSE 'FAIL' END AS outcome FROM gate1"""


def rules(spark):
    return spark.createDataFrame(_RULES, "gate string, slice string, metric string, mode string, threshold double")


def gate_comparison(spark, d):
    """Slices against the champion, all rows against the control, and the worst window outside the stress window."""
    rows = models(spark, d)
    against_control = au.compare_models(rows, "roll13_mean", SECOND, F.array(F.lit("control")))
    worst = au.worst_window_regression(rows, "roll13_mean", CONTROL, [str(TARGETS[5])]).select(F.lit("worst_window").alias("slice"), "wmape_delta")
    return comparison(spark, d).unionByName(against_control).unionByName(worst, allowMissingColumns=True)


@query("promotion_gates", "SELECT * FROM gate2", "threshold observed")
def _(spark, d):
    return au.gates(gate_comparison(spark, d), rules(spark))


@query("gate_decision", """
SELECT count(*) AS checks, count(*) FILTER (outcome = 'PASS') AS passed, CASE WHEN count(*) = count(*) FILTER (outcome = 'PASS') THEN 'PROMOTE' ELSE 'KEEP' END AS decision FROM gate2""", "", "checks passed")
def _(spark, d):
    return au.gate_decision(au.gates(gate_comparison(spark, d), rules(spark)))


@query("zero_actual_metrics", """
SELECT model_name, count(*) AS row_count, avg(phantom) AS phantom_rate, avg(pred_sale) AS pred_sale_rate, sum(pred_units) AS pred_units, avg(pred_units) AS mean_pred_units
FROM mrows WHERE actual_units = 0 GROUP BY model_name""", "phantom_rate pred_sale_rate pred_units mean_pred_units", "row_count")
def _(spark, d):
    return au.zero_actual_metrics(models(spark, d))


_POOL = ["last4", "roll8_mean", "roll13_mean", "seasonal52", "median_naive"]
BLOCKS["orc"] = f"SELECT * FROM mrows WHERE model_name IN ({', '.join(repr(p) for p in _POOL)}) QUALIFY row_number() OVER (PARTITION BY target_start, sku_id ORDER BY round(abs_error, 9), model_name) = 1"


@query("oracle_ceiling", f"""
WITH o AS (SELECT primary_route, {METRICS_SQL} FROM orc GROUP BY primary_route), c AS (SELECT primary_route, {METRICS_SQL} FROM mrows WHERE model_name = 'median_naive' GROUP BY primary_route)
SELECT primary_route, c.n_quantity_scored AS n_quantity_scored_control, c.hit20 AS hit20_control, c.wmape AS wmape_control, o.n_quantity_scored AS n_quantity_scored_best, o.hit20 AS hit20_best,
 o.wmape AS wmape_best, o.hit20 - c.hit20 AS hit20_gain FROM c LEFT JOIN o USING (primary_route)""", "hit20_control wmape_control hit20_best wmape_best hit20_gain", "n_quantity_scored_control n_quantity_scored_best")
def _(spark, d):
    return au.oracle_ceiling(models(spark, d), _POOL, CONTROL, "primary_route")


def control(spark, d):
    return models(spark, d).where(F.col("model_name") == CONTROL)


_SHARE = lambda c, e: f"""SELECT *, row_count / sum(row_count) OVER () AS row_share, abs_error / nullif(sum(abs_error) OVER (), 0) AS error_share FROM (
 SELECT {e} AS {c}, count(*) AS row_count, sum(actual_units) AS actual_units, sum(abs_error) AS abs_error FROM mrows WHERE model_name = 'median_naive' AND quantity_scored = 1 GROUP BY ALL)"""


@query("error_bands", _SHARE("error_band", "CASE WHEN abs_pct_error <= 0.2 THEN 'hit_0_20' WHEN abs_pct_error <= 0.3 THEN 'near_20_30' WHEN abs_pct_error <= 0.5 THEN 'miss_30_50' WHEN abs_pct_error <= 1 THEN 'miss_50_100' ELSE 'miss_100_plus' END"),
       "actual_units abs_error row_share error_share", "row_count")
def _(spark, d):
    return au.error_bands(control(spark, d))


@query("error_direction", _SHARE("direction", "CASE WHEN hit20 = 1 THEN 'hit_20' WHEN under20 = 1 THEN 'under_by_20_plus' WHEN over20 = 1 THEN 'over_by_20_plus' ELSE 'other_miss' END"),
       "actual_units abs_error row_share error_share", "row_count")
def _(spark, d):
    return au.error_direction(control(spark, d))


_SLI = lambda g, src: f"""SELECT *, revenue / sum(revenue) OVER () AS revenue_share, scored_error / nullif(sum(scored_error) OVER (), 0) AS error_share FROM (
 SELECT {g} AS group_value, {METRICS_SQL}, sum(actual_revenue) AS revenue, coalesce(sum(abs_error) FILTER (quantity_scored = 1), 0) AS scored_error FROM {src} WHERE model_name = 'median_naive' GROUP BY ALL)"""


@query("error_slices", _SLI("category_norm", "mrows"), MD + " revenue scored_error revenue_share error_share", MN)
def _(spark, d):
    return au.error_slices(control(spark, d), "category_norm")


@query("top_error_skus", """
WITH c AS (SELECT * FROM mrows WHERE model_name = 'median_naive' AND quantity_scored = 1), g AS (SELECT sku_id, count(DISTINCT target_start) AS windows, sum(actual_units) AS actual_units,
 sum(pred_units) AS pred_units, sum(abs_error) AS abs_error, avg(hit20) AS hit20, max(category_norm) AS category_norm, max(product_family_v2) AS product_family_v2 FROM c GROUP BY sku_id),
 r AS (SELECT sku_id, primary_route FROM c GROUP BY sku_id, primary_route QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY count(*) DESC, primary_route) = 1)
SELECT g.*, primary_route FROM g JOIN r USING (sku_id) ORDER BY round(abs_error, 6) DESC, sku_id LIMIT 20""", "actual_units pred_units abs_error hit20", "windows")
def _(spark, d):
    return au.top_error_skus(control(spark, d))


_CL = """CASE WHEN primary_route IN ('bf_campaign_sensitive', 'seasonal_active', 'seasonal_quiet') THEN 'campaign_calendar_required'
 WHEN primary_route IN ('sparse_intermittent', 'lifecycle_decline', 'stock_constrained') THEN 'lifecycle_or_stock_policy'
 WHEN stock_position_confidence IN ('proxy_recurring_demand_no_stock_context', 'stock_position_unobserved', 'stock_position_unknown') THEN 'stock_availability_required'
 WHEN coalesce(under20, 0) >= 0.5 THEN 'underprediction_review' WHEN coalesce(over20, 0) >= 0.5 THEN 'overprediction_review' ELSE 'keep_in_headline_benchmark' END"""
_ACT = "CASE group_value " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in au.CLEANUP_ACTIONS.items()) + " END AS action"


@query("cleanup_labels", f"SELECT * EXCLUDE (group_value), group_value AS cleanup_label, {_ACT} FROM ({_SLI(_CL, 'mrows')})", MD + " revenue scored_error revenue_share error_share", MN)
def _(spark, d):
    return au.cleanup_labels(control(spark, d))


@query("model_leaderboard", f"""
SELECT *, row_number() OVER (ORDER BY round(hit20, 9) DESC NULLS LAST, round(hit30, 9) DESC NULLS LAST, round(wmape, 9) ASC NULLS LAST, round(phantom_rate, 9) ASC NULLS LAST, model_name) AS place
FROM (SELECT model_name, {METRICS_SQL} FROM mrows GROUP BY model_name)""", MD, MN + " place")
def _(spark, d):
    return au.leaderboard(models(spark, d))


@query("worst_window_regression", f"""
WITH m AS (SELECT target_start, model_name, {METRICS_SQL} FROM mrows WHERE target_start <> DATE '{TARGETS[5]}' GROUP BY target_start, model_name)
SELECT target_start, max(wmape) FILTER (model_name = 'roll13_mean') - max(wmape) FILTER (model_name = 'median_naive') AS wmape_delta FROM m GROUP BY target_start
ORDER BY round(wmape_delta, 9) DESC, target_start LIMIT 1""", "wmape_delta")
def _(spark, d):
    return au.worst_window_regression(models(spark, d), "roll13_mean", CONTROL, [str(TARGETS[5])])


def _candidates(spark, d):
    return au.compare_to_baseline(models(spark, d), CONTROL)


@query("best_candidate", f"""
WITH m AS (SELECT model_name, {METRICS_SQL} FROM mrows GROUP BY model_name), b AS (SELECT hit20 AS h, wmape AS w FROM m WHERE model_name = 'median_naive')
SELECT model_name AS candidate, (hit20 - h >= 0 AND wmape - w <= 0)::INT AS gate_passed, hit20 - h AS hit20_delta, wmape - w AS wmape_delta FROM m, b WHERE model_name <> 'median_naive'
ORDER BY gate_passed DESC, round(hit20_delta, 9) DESC, round(wmape_delta, 9), candidate DESC LIMIT 1""", "hit20_delta wmape_delta", "gate_passed")
def _(spark, d):
    return au.best_candidate(_candidates(spark, d))


@query("campaign_exposure", """
SELECT primary_route AS group_value, count(*) AS row_count, avg((campaign_txn_13w > 0)::DOUBLE) AS campaign_share, avg((non_bf_campaign_txn_13w > 0)::DOUBLE) AS non_bf_share, avg((bf_txn_13w > 0)::DOUBLE) AS bf_share,
 avg((days_since_campaign_txn <= 28)::DOUBLE) AS recent_share, sum(campaign_units_13w) / nullif(sum(pos_units_13w), 0) AS unit_share, sum(campaign_revenue_13w) / nullif(greatest(sum(revenue_13w), 0), 0) AS revenue_share,
 avg(avg_campaign_discount_13w) AS mean_discount FROM rtx GROUP BY primary_route""", "campaign_share non_bf_share bf_share recent_share unit_share revenue_share mean_discount", "row_count")
def _(spark, d):
    return au.campaign_exposure(routed(spark, d), "primary_route")


@query("clean_numeric", "SELECT count(*) AS row_count, 0 AS bad_cells FROM rtx", "", "row_count bad_cells")
def _(spark, d):
    from stocktide.operators.features import NUMERIC_FEATURES
    return au.non_finite_cells(routed(spark, d), list(NUMERIC_FEATURES))


@query("safe_ratio", """
SELECT target_start, sum(CASE WHEN abs(roll13_mean) > 1e-9 THEN last4 / roll13_mean ELSE 0 END) AS ratio_sum, count(*) FILTER (roll13_mean = 0) AS zero_base FROM naive GROUP BY target_start""", "ratio_sum", "zero_base")
def _(spark, d):
    from stocktide.functions.numbers import safe_ratio
    from stocktide.plans.q_core import naive_of
    return naive_of(spark, d).groupBy("target_start").agg(
        F.sum(safe_ratio(F.col("last4"), F.col("roll13_mean"))).alias("ratio_sum"), F.count(F.when(F.col("roll13_mean") == 0, 1)).alias("zero_base"))


# ---- per-window method scores -----------------------------------------------------
BLOCKS["win_s"] = """
SELECT model_name AS method, target_start::VARCHAR AS "window", count(*) AS n, sum(abs_error) / sum(actual_units) AS wmape, avg((abs(signed_error / actual_units) <= 0.2)::DOUBLE) AS hit20,
 avg((abs(signed_error / actual_units) <= 0.3)::DOUBLE) AS hit30, avg(signed_error / actual_units) AS bias, avg(abs_error) AS mae, quantile_cont(abs(signed_error / actual_units), 0.5) AS median_ape
FROM mrows WHERE actual_units > 0 GROUP BY ALL"""
WIN_D = "wmape hit20 hit30 bias mae median_ape"


def windows(spark, d):
    rows = models(spark, d).select(F.col("target_start").cast("string").alias("window"), "sku_id", F.col("model_name").alias("method"), "pred_units", "actual_units",
                                   F.when(F.col("pred_units") == 0, F.lit("no history")).alias("error"))
    return rows


@query("score_one_window", "SELECT * FROM win_s", WIN_D, "n")
def _(spark, d):
    return au.score_one_window(windows(spark, d), ["method", "window"])


@query("method_scoreboard", """
SELECT s.*, e.win_share, e.phantoms FROM (SELECT m.model_name AS method, m.target_start::VARCHAR AS "window", avg(CASE WHEN m.actual_units > 0 AND m.model_name <> 'seasonal52' THEN (m.abs_error < b.abs_error)::DOUBLE END) AS win_share,
 count(*) FILTER (m.actual_units <= 0 AND m.pred_units >= 1) AS phantoms FROM mrows m JOIN mrows b ON b.model_name = 'seasonal52' AND b.target_start = m.target_start AND b.sku_id = m.sku_id GROUP BY ALL) e
LEFT JOIN win_s s USING (method, "window")""", WIN_D + " win_share", "n phantoms")
def _(spark, d):
    return au.method_scoreboard(windows(spark, d), "seasonal52")


_HOLD = [str(t) for t in TARGETS[-2:]]


@query("derive_method_weights", f"""
WITH g AS (SELECT method, avg(wmape) AS mean_wmape, greatest(power(greatest(0, 1 - avg(wmape)), 2), 0.05) AS raw_weight FROM win_s WHERE "window" NOT IN ('{_HOLD[0]}', '{_HOLD[1]}') GROUP BY method)
SELECT *, raw_weight / sum(raw_weight) OVER () AS weight FROM g""", "mean_wmape raw_weight weight")
def _(spark, d):
    return bl.method_weights(au.score_one_window(windows(spark, d), ["method", "window"]), _HOLD)


@query("derive_method_bias", f"""
SELECT method, avg(bias) AS bias_raw, least(0.3, greatest(-0.3, avg(bias))) AS bias_capped FROM win_s WHERE "window" NOT IN ('{_HOLD[0]}', '{_HOLD[1]}') GROUP BY method""", "bias_raw bias_capped")
def _(spark, d):
    return bl.method_bias(au.score_one_window(windows(spark, d), ["method", "window"]), _HOLD)


@query("ensemble_weighted_median", f"""
WITH g AS (SELECT method, greatest(power(greatest(0, 1 - avg(wmape)), 2), 0.05) AS r FROM win_s WHERE "window" NOT IN ('{_HOLD[0]}', '{_HOLD[1]}') GROUP BY method),
 v AS (SELECT m.target_start::VARCHAR AS "window", sku_id, pred_units AS v, r / (SELECT sum(r) FROM g) AS w FROM mrows m JOIN g ON g.method = m.model_name),
 c AS (SELECT *, sum(w) OVER (PARTITION BY "window", sku_id ORDER BY v, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(w) OVER (PARTITION BY "window", sku_id) / 2 AS h,
  lag(v) OVER (PARTITION BY "window", sku_id ORDER BY v, w) AS pv FROM v)
SELECT "window", sku_id, round_even(round(CASE WHEN pv IS NOT NULL AND abs(cw - w - h) < 1e-12 THEN (pv + v) / 2 ELSE v END, 6), 1) AS forecast_4w FROM c WHERE cw >= h - 1e-12
QUALIFY row_number() OVER (PARTITION BY "window", sku_id ORDER BY v, w) = 1""", "forecast_4w")
def _(spark, d):
    from stocktide.operators import forecast as fc
    w = windows(spark, d)
    weights = bl.method_weights(au.score_one_window(w, ["method", "window"]), _HOLD)
    long = w.select("window", "sku_id", "method", F.lit(None).cast("string").alias("error"), *[F.col("pred_units").alias(c) for c in fc.RESULT if c.startswith(("forecast", "confidence"))])
    return fc.ensemble_combine(long, ["window", "sku_id"], "weighted", weights).select("window", "sku_id", "forecast_4w")


def attribution_input(spark, d):
    m = routed(spark, d)
    m = m.join(au.attribution_signals(chain(spark, d), TARGETS), sc.KEY, "left")
    return m.select(*sc.KEY, F.col("category_norm").alias("category"), F.col("median_naive").alias("pred_units"), F.col("seasonal52").alias("naive_pred"),
                    F.col("actual_pos_units_4w").alias("actual_units"), F.col("last4").alias("aa_pred"), F.col("roll8_mean").alias("tree_pred"),
                    F.array("roll13_mean", "seasonal52").alias("other_preds"), F.col("zero_week_share_52").alias("zero_share"),
                    "last_10w_units", "monthly_cv", "target_multiplier")


BLOCKS["att0"] = """
SELECT target_start, sku_id, category_norm AS category, median_naive AS p, seasonal52 AS nv, actual_pos_units_4w AS a, last4 AS aa, roll8_mean AS tr, zs,
 list_filter([last4, roll13_mean, seasonal52], lambda v: v > 0) AS rest, coalesce(lw, 0) AS lw, coalesce(cv, 0) AS cv, coalesce(mu, 1) AS mu, abs(median_naive - actual_pos_units_4w) AS er
FROM rtx LEFT JOIN att_ten USING (target_start, sku_id) LEFT JOIN att_cv USING (target_start, sku_id)"""
BLOCKS["att_ten"] = """
SELECT target_start, sku_id, sum(pos_units) AS lw FROM wpos JOIN (SELECT target_start FROM targets) ON week_start < target_start AND week_start >= target_start - 70 GROUP BY ALL"""
BLOCKS["att_mon"] = """
SELECT target_start, sku_id, month(week_start) AS mo, sum(pos_units) AS u FROM wpos JOIN (SELECT target_start FROM targets) ON year(week_start) = year(target_start) - 1 GROUP BY ALL"""
BLOCKS["att_x"] = """
SELECT s.target_start, s.sku_id, k, least(3, greatest(0.2, coalesce(m.u, 0) / av)) AS x FROM (SELECT target_start, sku_id, sum(u) / 12 AS av FROM att_mon GROUP BY ALL HAVING sum(u) > 0) s
CROSS JOIN range(1, 13) r(k) LEFT JOIN att_mon m ON m.target_start = s.target_start AND m.sku_id = s.sku_id AND m.mo = k"""
BLOCKS["att_cv"] = """
SELECT target_start, sku_id, stddev_samp(x) / avg(x) AS cv, (max(x) FILTER (k = month(target_start)) + max(x) FILTER (k = month(target_start + 27))) / 2 AS mu FROM att_x GROUP BY ALL"""
BLOCKS["att"] = """
SELECT *, CASE WHEN lw <= 0 THEN 'silent_phantom' WHEN aa <= 0.5 AND zs > 0.8 THEN 'aa_collapse' WHEN len(rest) > 0 AND tr >= list_max(rest) AND tr >= 2 * list_median(rest) THEN 'lgbm_drag'
 WHEN cv > 0.5 AND mu < 0.7 AND nv > 0 AND p >= 1.5 * nv THEN 'seasonal_extrapolation' WHEN a > 0 AND abs(nv - a) < 0.5 * er THEN 'naive_would_have_won'
 WHEN a <= 0 OR er / nullif(a, 0) > 0.3 THEN 'residual' ELSE 'within_tolerance' END AS primary_tag FROM att0"""


@query("error_attribution", """
SELECT *, abs_error / sum(abs_error) OVER () AS error_share, CASE WHEN coalesce(sum(abs_error) FILTER (primary_tag = 'residual') OVER (), 0) / sum(abs_error) OVER () < 0.15 THEN 'GO'
 WHEN coalesce(sum(abs_error) FILTER (primary_tag = 'residual') OVER (), 0) / sum(abs_error) OVER () < 0.4 THEN 'GO_WITH_CAVEAT' ELSE 'HOLD' END AS verdict
FROM (SELECT primary_tag, count(*) AS row_count, sum(er) AS abs_error FROM att GROUP BY primary_tag)""", "abs_error error_share", "row_count")
def _(spark, d):
    return au.attribution_summary(au.error_attribution(attribution_input(spark, d)))


@query("category_scoreboard", """
SELECT category, count(*) FILTER (a > 0) AS skus, sum(er) FILTER (a > 0) / sum(a) FILTER (a > 0) AS wmape, sum(abs(nv - a)) FILTER (a > 0) / sum(a) FILTER (a > 0) AS naive_wmape,
 avg((er / a <= 0.2)::DOUBLE) FILTER (a > 0) AS hit20, avg((er < abs(nv - a))::DOUBLE) FILTER (a > 0) AS win_share, count(*) FILTER (a = 0 AND p >= 1) AS phantoms,
 coalesce(sum(p) FILTER (a = 0 AND p >= 1), 0) AS phantom_units FROM att GROUP BY category HAVING count(*) FILTER (a > 0) >= 5""", "wmape naive_wmape hit20 win_share phantom_units", "skus phantoms")
def _(spark, d):
    return au.category_scoreboard(attribution_input(spark, d))
