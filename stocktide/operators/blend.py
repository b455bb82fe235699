"""Walk-forward blends, tuning, policies and candidate grids over the routed feature matrix."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.numbers import div, median3, positive, row_median
from stocktide.operators.labels import date_array
from stocktide.operators.routes import route_masks
from stocktide.operators.score import KEY, error_columns, metric_aggregates

# Blend weights on a 0.1 simplex (last4, roll13, seasonal52) and the tuning grid.
SIMPLEX = [(i / 10, j / 10, (10 - i - j) / 10) for i in range(11) for j in range(11 - i)]
FACTORS = [round(0.5 + 0.05 * i, 2) for i in range(21)]
FLOORS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
# Calibration points, percent (and fewest units).
PRE_WINDOW_LIFTS = ((130, 3), (140, 3), (150, 3), (160, 3), (180, 3), (200, 3), (150, 5), (180, 5))
WINTER_FREE_LIFTS = (150, 180)
GROUP_RULES = (("sku", "sku_id", 8.0, 2), ("family", "product_family_v2", 25.0, 8), ("category", "category_norm", 60.0, 20))


def later_targets(targets: list[dt.date], min_train: int) -> Column:
    """Targets after the row's own one that have at least ``min_train`` earlier targets."""
    return F.filter(date_array(targets[min_train:]), lambda t: t > F.col("target_start"))


def scored_sums(pred: Column, actual: Column) -> list[Column]:
    """Additive parts of hit rate, weighted error, bias and phantom rate."""
    s, e = actual >= 4.0, pred - actual
    return [
        F.count(F.when(s, 1)).alias("n"), F.count(F.when(s & (F.abs(e) / actual <= 0.20), 1)).alias("hits"),
        F.sum(F.when(s, F.abs(e)).otherwise(0.0)).alias("abs_err"), F.sum(F.when(s, e).otherwise(0.0)).alias("err"),
        F.sum(F.when(s, actual).otherwise(0.0)).alias("act"), F.count(F.when(actual == 0, 1)).alias("zeros"),
        F.count(F.when((actual == 0) & (pred >= 1.0), 1)).alias("phantoms")]


def add_up(per_window: DataFrame, keys: list[str], targets: list[dt.date], min_train: int) -> DataFrame:
    """Window sums of every grid point -> sums over all windows before each later target."""
    parts = ("n", "hits", "abs_err", "err", "act", "zeros", "phantoms")
    return per_window.withColumn("eval_start", F.explode(later_targets(targets, min_train))).groupBy("eval_start", *keys).agg(
        *[F.sum(p).alias(p) for p in parts])


def choose_weights(train: DataFrame, targets: list[dt.date], min_train: int = 4) -> DataFrame:
    """Best of 66 blends per target by (hit20, -WMAPE, -|bias|) over the earlier windows.

    Grid points are scored window by window; those sums are few rows and add
    up, so the rows themselves are gone through once, not once per target.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("w_last4"), F.lit(b).alias("w_roll13"), F.lit(c).alias("w_seasonal"))
                     for i, (a, b, c) in enumerate(SIMPLEX)])
    scored = train.where("actual_units >= 4.0")  # no other row counts
    rows = scored.select("target_start", "actual_units", "last4", "roll13_mean", "seasonal52", F.inline(grid))
    pred = positive(weighted_base())
    sums = rows.groupBy("target_start", "i", "w_last4", "w_roll13", "w_seasonal").agg(*scored_sums(pred, F.col("actual_units")))
    sums = add_up(sums, ["i", "w_last4", "w_roll13", "w_seasonal"], targets, min_train).where(F.col("n") > 0)
    rank = F.struct(F.round(F.col("hits") / F.col("n"), 9), F.round(-F.col("abs_err") / F.col("act"), 9),
                    F.round(-F.abs(F.col("err") / F.col("act")), 9), -F.col("i"))
    best = sums.groupBy("eval_start").agg(F.max_by(F.struct(
        "w_last4", "w_roll13", "w_seasonal", (F.col("hits") / F.col("n")).alias("train_hit20"),
        (F.col("abs_err") / F.col("act")).alias("train_wmape")), rank).alias("b"))
    return best.select("eval_start", "b.*")


def weights_or_default(train: DataFrame, chosen: DataFrame, targets: list[dt.date], min_train: int) -> DataFrame:
    """One row for every target that can be evaluated.

    Without a scored earlier row the first grid point is taken, without any
    earlier row a third each, so no target loses its predictions.
    """
    spark = train.sparkSession
    every = spark.createDataFrame([(t,) for t in targets[min_train:]], "eval_start date")
    seen = train.select("target_start").distinct().withColumn("eval_start", F.explode(later_targets(targets, min_train))).select("eval_start").distinct()
    seen = seen.withColumn("seen", F.lit(True))
    names = ("w_last4", "w_roll13", "w_seasonal")
    out = every.join(seen, "eval_start", "left").join(chosen, "eval_start", "left")
    default = [F.when(F.col("seen"), F.lit(w)).otherwise(F.lit(1 / 3)) for w in SIMPLEX[0]]
    return out.select("eval_start", *[F.coalesce(n, d).alias(n) for n, d in zip(names, default)], "train_hit20", "train_wmape")


def weighted_base() -> Column:
    return (positive(F.col("last4")) * F.col("w_last4") + positive(F.col("roll13_mean")) * F.col("w_roll13")
            + positive(F.col("seasonal52")) * F.col("w_seasonal"))


def empirical_blend(labels: DataFrame, train: DataFrame, targets: list[dt.date], min_train: int = 4) -> DataFrame:
    """Walk-forward blend with shrunken sku, family and category factors; one prediction per (target, sku).

    ``train``: headline rows (target_start, sku_id, product_family_v2,
    category_norm, actual_units, last4, roll13_mean, seasonal52); ``labels``:
    the rows to predict with the same columns but actual_units.
    """
    weights = weights_or_default(train, choose_weights(train, targets, min_train), targets, min_train)
    # one row per target start
    past = train.withColumn("eval_start", F.explode(later_targets(targets, min_train))).join(F.broadcast(weights), "eval_start")
    past = past.withColumn("base", positive(weighted_base())).where((F.col("base") > 0) & (F.col("actual_units") >= 4.0))
    clip = lambda c: F.least(F.lit(2.5), F.greatest(F.lit(0.35), c))
    # sku-level sums first: the wider groups add up from them, so no family or category is shuffled whole
    sku = past.groupBy("eval_start", "sku_id", "product_family_v2", "category_norm").agg(
        F.sum("actual_units").alias("a"), F.sum("base").alias("b"), F.count(F.lit(1)).alias("n"))
    whole = sku.groupBy("eval_start").agg(clip(F.sum("a") / F.sum("b")).alias("g"))
    out = labels.withColumnRenamed("target_start", "eval_start").join(F.broadcast(weights), "eval_start")
    out = out.join(F.broadcast(whole), "eval_start", "left").withColumn("g", F.coalesce("g", F.lit(1.0)))
    for name, key, prior, least in GROUP_RULES:
        f = sku.groupBy("eval_start", key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
        f = f.where(F.col("n") >= least).join(F.broadcast(whole), "eval_start").select(
            "eval_start", key, clip((F.col("a") + prior * F.col("g")) / (F.col("b") + prior)).alias(f"{name}_factor"))
        out = out.join(f, ["eval_start", key], "left")
    g, s, fam, cat = F.col("g"), F.col("sku_factor"), F.col("family_factor"), F.col("category_factor")
    or_g = lambda c: F.coalesce(c, g)
    factor = (F.when(s.isNotNull(), 0.55 * s + 0.25 * or_g(fam) + 0.15 * or_g(cat) + 0.05 * g)
              .when(fam.isNotNull(), 0.65 * fam + 0.25 * or_g(cat) + 0.10 * g)
              .when(cat.isNotNull(), 0.65 * cat + 0.35 * g).otherwise(g))
    out = out.withColumn("factor", F.least(F.lit(3.0), F.greatest(F.lit(0.2), factor)))
    return out.select(F.col("eval_start").alias("target_start"), "sku_id", F.lit("direct_empirical_v1").alias("model_name"), "factor",
                      positive(weighted_base() * F.col("factor")).alias("pred_units_4w"))


def postprocess_tune(rows: DataFrame, targets: list[dt.date], pred: str, min_train: int = 4) -> DataFrame:
    """Best (factor, zero floor) of 126 per target over the earlier windows by (hit20, -phantom, -WMAPE, -|1-f|)."""
    grid = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(f).alias("factor"), F.lit(z).alias("zero_floor"))
                     for k, (f, z) in enumerate((f, z) for f in FACTORS for z in FLOORS)])
    counted = rows.where("actual_units >= 4.0 or actual_units = 0")  # scored and phantom rows
    r = counted.select("target_start", "actual_units", positive(F.col(pred)).alias("p"), F.inline(grid))
    sums = r.groupBy("target_start", "i", "factor", "zero_floor").agg(*scored_sums(apply_post(F.col("p")), F.col("actual_units")))
    sums = add_up(sums, ["i", "factor", "zero_floor"], targets, min_train).where(F.col("n") > 0)
    phantom = F.coalesce(div(F.col("phantoms"), F.col("zeros")), F.lit(1e9))
    rank = F.struct(F.round(F.col("hits") / F.col("n"), 9), F.round(-phantom, 9), F.round(-F.col("abs_err") / F.col("act"), 9),
                    F.round(-F.abs(1 - F.col("factor")), 9), -F.col("i"))
    best = sums.groupBy("eval_start").agg(F.max_by(F.struct(
        "factor", "zero_floor", (F.col("hits") / F.col("n")).alias("train_hit20"), (F.col("abs_err") / F.col("act")).alias("train_wmape"),
        div(F.col("phantoms"), F.col("zeros")).alias("train_phantom_rate")), rank).alias("b"))
    return best.select(F.col("eval_start").alias("target_start"), "b.*")


def apply_post(p: Column) -> Column:
    scaled = positive(p) * F.col("factor")
    return F.when(scaled < F.col("zero_floor"), 0.0).otherwise(scaled)


def postprocess(rows: DataFrame, tuned: DataFrame, pred: str) -> DataFrame:
    """Apply each target's tuned factor and floor (one row per target start); factor 1 and no floor where nothing was tuned."""
    found = rows.join(F.broadcast(tuned.select("target_start", "factor", "zero_floor")), "target_start", "left")
    found = found.withColumns({"factor": F.coalesce("factor", F.lit(1.0)), "zero_floor": F.coalesce("zero_floor", F.lit(0.0))})
    return found.withColumn("tuned_pred", apply_post(F.col(pred))).drop("factor", "zero_floor")


# ---- policies: row expressions over the routed matrix -----------------------
def stress() -> Column:
    """After the campaign window with campaign units in the last four weeks."""
    return (F.col("target_is_post_bf_4w") == 1) & (F.col("bf_unit_share_4w") > 0)


def post_bf_safe_naive() -> Column:
    safe = median3(F.col("non_bf_pos_units_4w_equiv"), F.col("roll13_mean"), F.col("seasonal52"))
    return positive(F.when(stress(), safe).otherwise(F.col("median_naive")))


def post_bf_cap(pred: Column) -> Column:
    cap = F.greatest(F.greatest(post_bf_safe_naive(), F.col("roll13_mean"), F.col("seasonal52")) * 1.20, F.lit(1.0))
    return F.when(stress() & (F.col("last4_to_roll13") > 1.25), F.least(positive(pred), cap)).otherwise(positive(pred))


def prediction_blend(*preds: Column) -> Column:
    """Row median of the predictions that exist."""
    return row_median(*preds)


def policy_champion(safe_blend: Column, trees: Column) -> Column:
    return positive(F.when(stress(), post_bf_safe_naive()).when(route_masks()["regular"], trees).otherwise(safe_blend))


def policy_lift(pred: Column, kind: str, rank_limit: int | None) -> Column:
    """x1.50 outside the post window or x1.80 in the pre window on campaign routes with at least 3 units.

    Only meant for the top of the range, so a rank limit of at most 1000 is required.
    """
    if rank_limit is None or rank_limit > 1000:
        raise ValueError("lifts need a revenue rank limit of at most 1000")
    context = F.col("calendar_route_context")
    when, lift = {"non_post": (context != "post_bf_window", 1.50), "pre": (context == "pre_bf_window", 1.80)}[kind]
    return F.when((F.col("primary_route") == "bf_campaign_sensitive") & when & (pred >= 3.0), pred * lift).otherwise(pred)


def campaign_candidates(control: Column) -> dict[str, Column]:
    m, safe = route_masks(), post_bf_safe_naive()
    pool = median3(safe, F.col("median_naive"), control)
    return {
        "campaign_safe_naive": F.when(m["campaign"], safe).otherwise(control),
        "bf_calendar_safe_naive": F.when(m["bf_calendar"], safe).otherwise(control),
        "campaign_conservative_pool": F.when(m["campaign"], pool).otherwise(control),
        "post_bf_hard_safe": F.when(stress(), safe).otherwise(control),
    }


def combined_candidates(control: Column, trees: Column) -> dict[str, Column]:
    m, safe = route_masks(), post_bf_safe_naive()
    regular = F.when(m["regular"], trees).otherwise(control)
    return {
        "combined_regular_post_bf": F.when(stress(), safe).otherwise(regular),
        "combined_bf_calendar": F.when(m["bf_calendar"], safe).otherwise(regular),
        "combined_guarded": F.when(stress(), safe).when(m["guarded_regular"], trees).otherwise(control),
    }


def semantic_candidates(control: Column, trees: Column, champion: Column) -> dict[str, Column]:
    """Compositions that do not let stock decide what counts as regular."""
    safe = post_bf_safe_naive()
    demand = (F.col("active_weeks_52") >= 24) & (F.col("avg_units_per_4w_52") >= 2.0) & (F.col("calendar_route_context") == "normal_calendar")
    quiet = (F.col("campaign_txn_13w") <= 0) & (F.col("bf_txn_13w") <= 0)
    constrained = F.col("primary_route") == "stock_constrained"
    return {
        "without_stock_gate": F.when(stress(), safe).otherwise(control),
        "demand_regular": F.when(stress(), safe).when(demand, trees).otherwise(control),
        "demand_regular_no_campaign": F.when(stress(), safe).when(demand & quiet, trees).otherwise(control),
        "constrained_as_regular": F.when(stress(), safe).when(constrained & demand, trees).otherwise(champion),
    }


def calibration_candidates(champion: Column, control: Column) -> dict[str, Column]:
    """Control blends on regular rows and lifts on campaign rows."""
    m, context = route_masks(), F.col("calendar_route_context")
    campaign, month = F.col("primary_route") == "bf_campaign_sensitive", F.col("target_month")
    lift = lambda cond, floor, x: F.when(campaign & cond & (champion >= floor), champion * x).otherwise(champion)
    out = {f"regular_blend_{int(w * 100)}": F.when(m["regular"], champion * (1.0 - w) + control * w).otherwise(champion)
           for w in (0.10, 0.25, 0.40)}
    out |= {f"lift_{x}_non_post": lift(context != "post_bf_window", 3.0, x / 100) for x in (110, 120, 130, 140, 150)}
    out |= {f"lift_{x}_pre_floor_{f}": lift(context == "pre_bf_window", float(f), x / 100) for x, f in PRE_WINDOW_LIFTS}
    out |= {f"lift_{x}_non_post_no_dec_jan": lift((context != "post_bf_window") & ~month.isin(12, 1), 3.0, x / 100) for x in WINTER_FREE_LIFTS}
    return out


def candidate_rows(matrix: DataFrame, candidates: dict[str, Column], carry: list[str]) -> DataFrame:
    """One score row per (matrix row, candidate)."""
    rows = matrix.withColumn("actual_units", F.col("actual_pos_units_4w")).withColumn("actual_revenue", F.col("actual_net_revenue_4w"))
    rows = rows.select(*KEY, "actual_units", "actual_revenue", *carry, F.inline(F.array(*[
        F.struct(F.lit(n).alias("model_name"), positive(c).alias("pred_units")) for n, c in candidates.items()])))
    return error_columns(rows)


def model_table(rows: DataFrame, keys: list[str] = ("model_name",)) -> DataFrame:
    return rows.groupBy(*keys).agg(*metric_aggregates())


def route_prior_best(rows: DataFrame, targets: list[dt.date], min_scored: int = 60, min_train: int = 1) -> DataFrame:
    """Per target and route the model with the best earlier (hit20, -WMAPE, -phantom)."""
    per = rows.groupBy("target_start", "primary_route", "model_name").agg(*scored_sums(F.col("pred_units"), F.col("actual_units")))
    s = add_up(per, ["primary_route", "model_name"], targets, min_train).where(F.col("n") >= min_scored)
    phantom = F.coalesce(div(F.col("phantoms"), F.col("zeros")), F.lit(1e9))
    rank = F.struct(F.round(F.col("hits") / F.col("n"), 9), F.round(-F.col("abs_err") / F.col("act"), 9), F.round(-phantom, 9), F.col("model_name"))
    return s.groupBy(F.col("eval_start").alias("target_start"), "primary_route").agg(F.max_by("model_name", rank).alias("best_model"))


def apply_route_best(rows: DataFrame, best: DataFrame, control: str) -> DataFrame:
    """Prediction of the chosen model per route, the control model elsewhere."""
    r = rows.join(best, ["target_start", "primary_route"], "left").where(F.col("model_name") == F.coalesce("best_model", F.lit(control)))
    return r.select(*KEY, "primary_route", F.lit("route_prior_best").alias("model_name"), F.col("model_name").alias("used_model"), "pred_units")


def route_prior_bias(rows: DataFrame, targets: list[dt.date], model: str, min_scored: int = 60, min_train: int = 1) -> DataFrame:
    """actual / predicted of a model per route over the earlier windows, clip 0.70-1.30."""
    m = rows.where((F.col("model_name") == model) & (F.col("quantity_scored") == 1))
    per = m.groupBy("target_start", "primary_route").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred_units").alias("p"), F.sum("actual_units").alias("a"))
    s = per.withColumn("eval_start", F.explode(later_targets(targets, min_train))).groupBy("eval_start", "primary_route").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("a").alias("a"))
    s = s.where((F.col("n") >= min_scored) & (F.col("p") > 0) & (F.col("a") > 0))
    return s.select(F.col("eval_start").alias("target_start"), "primary_route",
                    F.least(F.lit(1.3), F.greatest(F.lit(0.7), F.col("a") / F.col("p"))).alias("bias_factor"))


def method_weights(scores: DataFrame, holdout: list[str], floor: float = 0.05) -> DataFrame:
    """Mean window WMAPE per method -> max(0, 1-w)^2, at least the floor, normalised; hold-out windows left out."""
    g = scores.where(~F.col("window").isin(*holdout)).groupBy("method").agg(F.avg("wmape").alias("mean_wmape"))
    g = g.where(F.col("mean_wmape").isNotNull())
    raw = F.greatest(F.pow(positive(1.0 - F.col("mean_wmape")), F.lit(2)), F.lit(floor))
    total = g.select(raw.alias("_r")).agg(F.sum("_r")).scalar()
    return g.withColumn("raw_weight", raw).select("method", "mean_wmape", "raw_weight", (F.col("raw_weight") / total).alias("weight"))


def method_bias(scores: DataFrame, holdout: list[str], cap: float = 0.30) -> DataFrame:
    """Mean relative bias per method over the training windows and its capped value."""
    g = scores.where(~F.col("window").isin(*holdout)).groupBy("method").agg(F.avg("bias").alias("bias_raw"))
    return g.where(F.col("bias_raw").isNotNull()).withColumn(
        "bias_capped", F.least(F.lit(cap), F.greatest(F.lit(-cap), F.col("bias_raw"))))
