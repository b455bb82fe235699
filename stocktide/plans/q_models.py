"""Trained models (rows-only checks, as a trainer has no SQL twin) and nearest-neighbour analogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktide.operators import analogs as an
from stocktide.operators import blend as bl
from stocktide.operators import models as mo
from stocktide.operators import score as sc
from stocktide.operators.routes import route_masks
from stocktide.plans import fixtures as fx
from stocktide.plans.fixtures import TARGETS
from stocktide.plans.oracle import BLOCKS
from stocktide.plans.q_features import routed
from stocktide.plans.q_series import K, folded
from stocktide.plans.registry import query

BLEND_PARTS = ("boost_poisson", "extra_trees")


def fitted(spark, d):
    """All three trees on every target that has enough earlier ones."""
    return fx.shared(spark, d, "trees_fitted", lambda: mo.fit_walk_forward(routed(spark, d), TARGETS))


def tree_rows(spark, d):
    return fx.shared(spark, d, "trees", lambda: mo.walk_forward_trees(routed(spark, d), TARGETS, fitted=fitted(spark, d)))


def blend_rows(spark, d):
    """What the safe blend is made of, without the model it leaves out."""
    return fx.shared(spark, d, "blend_trees", lambda: mo.walk_forward_trees(routed(spark, d), TARGETS, names=BLEND_PARTS))


@query("fc_direct_trees", None, "pred_units_4w")
def _(spark, d):
    return sc.to_long(tree_rows(spark, d), [*mo.MODELS, "safe_blend"])


@query("boosting_rounds", None, "first_error best_error", "rounds_grown rounds_kept")
def _(spark, d):
    """Rounds that boosting grew and kept for each target, by the error of held rows."""
    return mo.rounds_kept(fitted(spark, d)).withColumnRenamed("t", "target_start")


@query("walk_forward", None, sc.METRIC_DOUBLES, sc.METRIC_LONGS)
def _(spark, d):
    """Score of every model on each target, trained on the targets before it."""
    cols = {m: F.col(m) for m in (*mo.MODELS, "safe_blend", "post_bf_safe_naive", "median_naive")}
    return bl.model_table(bl.candidate_rows(tree_rows(spark, d), cols, []), ["target_start", "model_name"])


@query("route_specialists", None, "pred_units_4w")
def _(spark, d):
    rows = mo.walk_forward_trees(routed(spark, d), TARGETS, names=BLEND_PARTS, specialists=True)
    return sc.to_long(rows, list(mo.VARIANTS))


@query("trained_candidates", None, sc.METRIC_DOUBLES, sc.METRIC_LONGS)
def _(spark, d):
    """Policies, route candidates and calibration points on the trained predictions: safe blend as control, forest as trees."""
    control, trees = F.col("safe_blend"), F.col("extra_trees")
    rows, champion = blend_rows(spark, d).withColumn("_ch", bl.policy_champion(control, trees)), F.col("_ch")
    cols = {"champion": champion, "control": control} | bl.campaign_candidates(control) | bl.combined_candidates(control, trees)
    cols |= bl.semantic_candidates(control, trees, champion) | bl.calibration_candidates(champion, control)
    return bl.model_table(bl.candidate_rows(rows, cols, []), ["target_start", "model_name"])


@query("feature_profiles", None, "pred_units_4w")
def _(spark, d):
    return mo.feature_profiles(blend_rows(spark, d), routed(spark, d), TARGETS)


@query("fc_gbt_global", None, "forecast_4w forecast_8w residual_std", "weeks_of_history rounds_grown rounds_kept")
def _(spark, d):
    return mo.gbt_global(folded(spark, d), K).drop("importance")


_ALL = ", ".join(f"DATE '{t}'" for t in TARGETS[4:])
_IN = {f: f"ln(1 + greatest({f}, 0))" if f in an.LOG_FEATURES else f"CAST({f} AS DOUBLE)" for f in an.FEATURES}
_STATS = ", ".join(f"avg(v_{f}) AS m_{f}, CASE WHEN coalesce(stddev_samp(v_{f}), 0) < 1e-9 THEN 1 ELSE stddev_samp(v_{f}) END AS s_{f}" for f in an.FEATURES)
def _analog_blocks(p: str, regular: str) -> str:
    BLOCKS[f"{p}_rows"] = f"""
SELECT u.t, target_start, sku_id, product_family_v2 AS fam, category_norm AS cat, {regular} AS reg,
 target_start < u.t AS trains, CAST(actual_pos_units_4w AS DOUBLE) AS actual, greatest(median_naive, 0) AS naive, safe AS control, {', '.join(f'{s} AS v_{f}' for f, s in _IN.items())}
FROM pol JOIN (SELECT unnest([{_ALL}]) AS t) u ON target_start <= u.t"""
    BLOCKS[f"{p}_x"] = f"""
SELECT r.t, target_start, sku_id, fam, cat, reg, trains, actual, naive, control, [{', '.join(f'(v_{f} - m_{f}) / s_{f}' for f in an.FEATURES)}] AS x
FROM {p}_rows r JOIN (SELECT t, {_STATS} FROM {p}_rows WHERE trains GROUP BY t) st ON r.t = st.t"""
    BLOCKS[f"{p}_q"] = f"""
SELECT q.t, sku_id, x, CASE WHEN nf >= 25 THEN 'product_family' WHEN nc >= 50 THEN 'category' WHEN nr >= 100 THEN 'regular_global' ELSE 'all_train_fallback' END AS source,
 CASE WHEN nf >= 25 THEN q.fam WHEN nc >= 50 THEN q.cat ELSE '' END AS val
FROM {p}_x q LEFT JOIN (SELECT t, fam, count(*) AS nf FROM {p}_x WHERE trains AND reg GROUP BY ALL) f ON f.t = q.t AND f.fam = q.fam
 LEFT JOIN (SELECT t, cat, count(*) AS nc FROM {p}_x WHERE trains AND reg GROUP BY ALL) c ON c.t = q.t AND c.cat = q.cat
 LEFT JOIN (SELECT t, count(*) AS nr FROM {p}_x WHERE trains AND reg GROUP BY ALL) g ON g.t = q.t WHERE NOT trains AND reg"""
    BLOCKS[f"{p}_m"] = f"""
SELECT 'product_family' AS source, fam AS val, * FROM {p}_x WHERE trains AND reg UNION ALL SELECT 'category', cat, * FROM {p}_x WHERE trains AND reg
UNION ALL SELECT 'regular_global', '', * FROM {p}_x WHERE trains AND reg UNION ALL SELECT 'all_train_fallback', '', * FROM {p}_x WHERE trains"""
    BLOCKS[f"{p}_near"] = f"""
SELECT q.t, q.sku_id, q.source, m.actual, m.naive, row_number() OVER (PARTITION BY q.t, q.sku_id ORDER BY round(list_distance(q.x, m.x), 6), m.target_start, m.sku_id) AS place
FROM {p}_q q JOIN {p}_m m ON m.t = q.t AND m.source = q.source AND m.val = q.val"""
    BLOCKS[f"{p}_med"] = f"""
SELECT t, sku_id, source, median(actual) AS units, median(least(greatest(actual / greatest(naive, 1), 0), 3)) AS ratio, median(actual - naive) AS residual
FROM {p}_near WHERE place <= 35 GROUP BY ALL"""
    BLOCKS[f"{p}_val"] = f"""
SELECT r.t AS target_start, r.sku_id, source, control, units, CASE WHEN naive < 1 THEN greatest(naive * ratio, units * 0.5) ELSE naive * ratio END AS by_ratio,
 CASE WHEN units IS NOT NULL THEN greatest(naive + residual, 0) END AS by_residual FROM {p}_x r LEFT JOIN {p}_med m ON m.t = r.t AND m.sku_id = r.sku_id WHERE NOT trains"""
    return f"""
SELECT target_start, sku_id, source, coalesce(units, control) AS analog_units, coalesce(by_ratio, control) AS analog_ratio, coalesce(by_residual, control) AS analog_residual,
 CASE WHEN units IS NULL THEN control ELSE list_median([units, by_ratio, by_residual, control]) END AS analog_blend FROM {p}_val"""


_ANALOGS = "analog_units analog_ratio analog_residual analog_blend"


@query("fc_analog_knn", _analog_blocks("an", "primary_route IN ('available_regular', 'proxy_available_regular')"), _ANALOGS)
def _(spark, d):
    """Analogs with the safe naive forecast as control."""
    return an.analog_candidates(routed(spark, d), TARGETS, bl.post_bf_safe_naive())


_DEMAND = "coalesce(active_weeks_52 >= 24 AND avg_units_per_4w_52 >= 2 AND calendar_route_context = 'normal_calendar', false)"


@query("analog_demand_regular", _analog_blocks("ad", _DEMAND), _ANALOGS)
def _(spark, d):
    """The same search for rows of regular demand, whatever their stock says."""
    return an.analog_candidates(routed(spark, d), TARGETS, bl.post_bf_safe_naive(), regular=route_masks()["demand_regular"])


@query("analog_trained", None, sc.METRIC_DOUBLES, sc.METRIC_LONGS)
def _(spark, d):
    """Scores of the analogs with the trained safe blend as control."""
    rows = blend_rows(spark, d)
    found = an.analog_candidates(routed(spark, d).join(rows.select(*sc.KEY, "safe_blend"), sc.KEY, "left"), TARGETS, F.col("safe_blend")).drop("source")
    names = ("analog_units", "analog_ratio", "analog_residual", "analog_blend", "safe_blend")
    return bl.model_table(bl.candidate_rows(rows.join(found, sc.KEY), {n: F.col(n) for n in names}, []), ["target_start", "model_name"])
