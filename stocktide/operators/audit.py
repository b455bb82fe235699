"""Audits of score rows: scopes, error decomposition, comparisons, gates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions.numbers import div
from stocktide.operators.labels import date_array, lookup
from stocktide.operators.routes import REGULAR_ROUTES
from stocktide.operators.score import KEY, metric_aggregates

SCOPES = (("top_100", 100), ("top_250", 250), ("top_500", 500), ("top_750", 750), ("top_1000", 1000), ("top_5000", 5000), ("all", None))
# Name parts of goods that are no retail product.
ARTIFACT_WORDS = ("PALET", "TRANSPORT", "LIVRARE", "MONTAJ", "AMBAL", "SERVICI", "TAXA", "GARANTIE", "AVANS")
CAMPAIGN_ROUTES = ("bf_campaign_sensitive", "seasonal_active", "seasonal_quiet")
LIFECYCLE_ROUTES = ("sparse_intermittent", "lifecycle_decline", "stock_constrained")
# old and present names of rows without a stock position
GAP_VALUES = ("proxy_available", "stock_unobserved", "availability_unknown",
              "proxy_recurring_demand_no_stock_context", "stock_position_unobserved", "stock_position_unknown")
CLEANUP_ACTIONS = {
    "artifact_or_non_retail_review": "check whether this is a sellable product",
    "campaign_calendar_required": "get campaign membership and windows",
    "lifecycle_or_stock_policy": "separate lifecycle and stock-bound demand",
    "stock_availability_required": "get monthly store and supplier stock",
    "underprediction_review": "look for a missing demand signal",
    "overprediction_review": "look for an end of demand",
    "keep_in_headline_benchmark": "keep",
}


def scored(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("quantity_scored") == 1)


def revenue_scope_metrics(rows: DataFrame) -> DataFrame:
    """Metrics per model for the top 100 ... 5000 by revenue rank and for all."""
    scope = F.array_compact(F.array(*[
        F.lit(n) if k is None else F.when(F.col("revenue_rank").between(1, k), F.lit(n)) for n, k in SCOPES]))
    return rows.withColumn("scope", F.explode(scope)).groupBy("scope", "model_name").agg(*metric_aggregates(), F.sum("actual_revenue").alias("revenue"))


def clean_regular(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("primary_route").isin(*REGULAR_ROUTES) & (F.col("calendar_route_context") == "normal_calendar"))


def best_by_scope(metrics: DataFrame) -> DataFrame:
    """Best model per scope by (hit20, -WMAPE, name)."""
    rank = F.struct(F.round("hit20", 9), F.round(-F.coalesce("wmape", F.lit(999.0)), 9), "model_name")
    return metrics.where((F.col("n_quantity_scored") > 0) & F.col("hit20").isNotNull()).groupBy("scope").agg(
        F.max_by(F.struct("model_name", "hit20", "wmape", "n_quantity_scored"), rank).alias("b")).select("scope", "b.*")


def compare_models(rows: DataFrame, candidate: str, baseline: str, slices: Column) -> DataFrame:
    """Candidate minus baseline for every slice; ``slices`` is an array column of slice names per row."""
    part = rows.where(F.col("model_name").isin(candidate, baseline)).withColumn("slice", F.explode(slices))
    m = part.groupBy("slice", "model_name").agg(*metric_aggregates())
    fields = ("hit20", "hit30", "wmape", "bias_pct", "phantom_rate")
    at = lambda name, f: F.max(F.when(F.col("model_name") == name, F.col(f)))
    return m.groupBy("slice").agg(
        at(candidate, "n_quantity_scored").alias("n_scored"),
        *[at(candidate, f).alias(f"{f}_candidate") for f in fields], *[at(baseline, f).alias(f"{f}_baseline") for f in fields],
        *[(at(candidate, f) - at(baseline, f)).alias(f"{f}_delta") for f in fields])


def compare_to_baseline(rows: DataFrame, baseline: str) -> DataFrame:
    """Hit and WMAPE deltas of every other model against one, from one grouped pass over the rows."""
    m = rows.groupBy("model_name").agg(*metric_aggregates())
    base = m.where(F.col("model_name") == baseline).select(F.col("hit20").alias("_h"), F.col("wmape").alias("_w"))
    others = m.where(F.col("model_name") != baseline).crossJoin(F.broadcast(base))  # one row
    return others.select(F.col("model_name").alias("candidate"), (F.col("hit20") - F.col("_h")).alias("hit20_delta"), (F.col("wmape") - F.col("_w")).alias("wmape_delta"))


def zero_actual_metrics(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("actual_units") == 0).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("phantom").alias("phantom_rate"), F.avg("pred_sale").alias("pred_sale_rate"),
        F.sum("pred_units").alias("pred_units"), F.avg("pred_units").alias("mean_pred_units"))


def oracle_rows(rows: DataFrame, models: list[str]) -> DataFrame:
    """Per (target, sku) the tested model with the smallest error."""
    pool = rows.where(F.col("model_name").isin(*models))
    carry = [c for c in pool.columns if c not in KEY]
    best = F.min_by(F.struct(*carry), F.struct(F.round("abs_error", 9), "model_name"))
    return pool.groupBy(*KEY).agg(best.alias("b")).select(*KEY, "b.*")


def oracle_ceiling(rows: DataFrame, models: list[str], control: str, group: str) -> DataFrame:
    """Best reachable hit rate and error per group beside the control model's."""
    top = oracle_rows(rows, models).groupBy(group).agg(*metric_aggregates())
    own = rows.where(F.col("model_name") == control).groupBy(group).agg(*metric_aggregates())
    pick = lambda df, p: df.select(group, *[F.col(c).alias(f"{c}_{p}") for c in ("n_quantity_scored", "hit20", "wmape")])
    return pick(own, "control").join(pick(top, "best"), group, "left").withColumn("hit20_gain", F.col("hit20_best") - F.col("hit20_control"))


def _share(rows: DataFrame, column: str) -> DataFrame:
    g = rows.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"), F.sum("actual_units").alias("actual_units"), F.sum("abs_error").alias("abs_error"))
    all_rows, all_error = (g.select(c).agg(F.sum(c)).scalar() for c in ("row_count", "abs_error"))
    return g.withColumns({"row_share": F.col("row_count") / all_rows, "error_share": div(F.col("abs_error"), all_error)})


def error_bands(rows: DataFrame) -> DataFrame:
    e = F.col("abs_pct_error")
    band = (F.when(e <= 0.20, "hit_0_20").when(e <= 0.30, "near_20_30").when(e <= 0.50, "miss_30_50").when(e <= 1.00, "miss_50_100")
            .otherwise("miss_100_plus"))
    return _share(scored(rows).withColumn("error_band", band), "error_band")


def error_direction(rows: DataFrame) -> DataFrame:
    d = (F.when(F.col("hit20") == 1, "hit_20").when(F.col("under20") == 1, "under_by_20_plus").when(F.col("over20") == 1, "over_by_20_plus")
         .otherwise("other_miss"))
    return _share(scored(rows).withColumn("direction", d), "direction")


def error_slices(rows: DataFrame, group: str) -> DataFrame:
    """Metrics of any column with its share of revenue and of the scored error."""
    err = F.sum(F.when(F.col("quantity_scored") == 1, F.col("abs_error")).otherwise(0.0))
    g = rows.groupBy(F.col(group).alias("group_value")).agg(*metric_aggregates(), F.sum("actual_revenue").alias("revenue"), err.alias("scored_error"))
    revenue, error = (g.select(c).agg(F.sum(c)).scalar() for c in ("revenue", "scored_error"))  # any number of classes, no single task
    return g.withColumns({"revenue_share": F.col("revenue") / revenue, "error_share": div(F.col("scored_error"), error)})


def top_error_skus(rows: DataFrame, k: int = 20) -> DataFrame:
    """The 20 skus with the largest summed error, with their most common route, category and family."""
    modal = lambda c: F.mode(c, deterministic=True).alias(c)
    g = scored(rows).groupBy("sku_id").agg(
        F.countDistinct("target_start").alias("windows"), F.sum("actual_units").alias("actual_units"), F.sum("pred_units").alias("pred_units"),
        F.sum("abs_error").alias("abs_error"), F.avg("hit20").alias("hit20"), modal("primary_route"), modal("category_norm"), modal("product_family_v2"))
    return g.orderBy(F.desc(F.round("abs_error", 6)), "sku_id").limit(k)


def cleanup_label(under: Column, over: Column) -> Column:
    text = F.upper(F.concat_ws(" ", "sku_id", "category_norm", "product_family_v2"))
    return (
        F.when(text.rlike("|".join(ARTIFACT_WORDS)), "artifact_or_non_retail_review")
        .when(F.col("primary_route").isin(*CAMPAIGN_ROUTES), "campaign_calendar_required")
        .when(F.col("primary_route").isin(*LIFECYCLE_ROUTES), "lifecycle_or_stock_policy")
        .when(F.col("stock_position_confidence").isin(*GAP_VALUES), "stock_availability_required")
        .when(F.coalesce(under, F.lit(0.0)) >= 0.50, "underprediction_review")
        .when(F.coalesce(over, F.lit(0.0)) >= 0.50, "overprediction_review").otherwise("keep_in_headline_benchmark"))


def cleanup_labels(rows: DataFrame) -> DataFrame:
    """Rows, error and action per cleanup label."""
    r = rows.withColumn("cleanup_label", cleanup_label(F.col("under20"), F.col("over20")))
    g = error_slices(r, "cleanup_label").withColumnRenamed("group_value", "cleanup_label")
    return g.withColumn("action", lookup(CLEANUP_ACTIONS, F.col("cleanup_label")))


def leaderboard(rows: DataFrame) -> DataFrame:
    """Models by hit20, hit30, -WMAPE, -phantom with missing values last."""
    m = rows.groupBy("model_name").agg(*metric_aggregates())
    w = Window.orderBy(F.desc_nulls_last(F.round("hit20", 9)), F.desc_nulls_last(F.round("hit30", 9)), F.asc_nulls_last(F.round("wmape", 9)),
                       F.asc_nulls_last(F.round("phantom_rate", 9)), "model_name")
    return m.withColumn("place", F.row_number().over(w))  # one row per model


def worst_window_regression(rows: DataFrame, candidate: str, baseline: str, stress: list[str]) -> DataFrame:
    """Window with the largest WMAPE deterioration, stress windows left out."""
    m = rows.where(~F.col("target_start").cast("string").isin(*stress) & F.col("model_name").isin(candidate, baseline))
    m = m.groupBy("target_start", "model_name").agg(*metric_aggregates())
    at = lambda n: F.max(F.when(F.col("model_name") == n, F.col("wmape")))
    d = m.groupBy("target_start").agg((at(candidate) - at(baseline)).alias("wmape_delta")).where(F.col("wmape_delta").isNotNull())
    return d.agg(F.max_by(F.struct("target_start", "wmape_delta"), F.struct(F.round("wmape_delta", 9), -F.unix_date("target_start"))).alias("b")).select("b.*")


def gates(comparison: DataFrame, rules: DataFrame) -> DataFrame:
    """Named threshold checks against the comparison table with PASS or FAIL.

    ``rules`` (gate, slice, metric, mode, threshold) is a short hand-kept list;
    mode is min, min_strict or max, and metric names a ``*_delta`` column.
    """
    metrics = [c[:-6] for c in comparison.columns if c.endswith("_delta")]
    long = comparison.select("slice", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_delta").alias("observed")) for m in metrics])))
    r = rules.join(long, ["slice", "metric"], "left")
    o, t = F.col("observed"), F.col("threshold")
    ok = F.when(F.col("mode") == "min", o >= t).when(F.col("mode") == "min_strict", o > t).otherwise(o <= t)
    return r.select("gate", "slice", "metric", "mode", "threshold", "observed", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("outcome"))


def gate_decision(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("checks"), F.count(F.when(F.col("outcome") == "PASS", 1)).alias("passed")).withColumn(
        "decision", F.when(F.col("checks") == F.col("passed"), "PROMOTE").otherwise("KEEP"))


def best_candidate(comparison: DataFrame) -> DataFrame:
    """Candidate with the best (gate passed, hit gain, WMAPE gain) over all rows."""
    ok = ((F.col("hit20_delta") >= 0.0) & (F.col("wmape_delta") <= 0.0)).cast("int")
    rank = F.struct(ok, F.round("hit20_delta", 9), F.round(-F.col("wmape_delta"), 9), "candidate")
    return comparison.agg(F.max_by(F.struct("candidate", ok.alias("gate_passed"), "hit20_delta", "wmape_delta"), rank).alias("b")).select("b.*")


# ---- per-window method scores ---------------------------------------------------
def score_one_window(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, WMAPE, hit20, hit30, mean relative bias, MAE and median error share on rows with a positive actual."""
    a, p = F.col("actual_units"), F.col("pred_units")
    r = rows.where(a > 0).withColumns({"_e": F.abs(p - a), "_r": (p - a) / a})
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("_e") / F.sum("actual_units")).alias("wmape"),
        F.avg((F.abs(F.col("_r")) <= 0.20).cast("double")).alias("hit20"), F.avg((F.abs(F.col("_r")) <= 0.30).cast("double")).alias("hit30"),
        F.avg("_r").alias("bias"), F.avg("_e").alias("mae"), F.percentile(F.abs(F.col("_r")), F.lit(0.5)).alias("median_ape"))


def method_scoreboard(rows: DataFrame, baseline: str, include_fallback: bool = True) -> DataFrame:
    """Per window and method on rows with a value: metrics, share of wins against the baseline and phantoms.

    rows: window, sku_id, method, pred_units, error, actual_units.
    """
    r = rows.where(F.col("pred_units").isNotNull())
    if not include_fallback:
        r = r.where(F.col("error").isNull())
    key = Window.partitionBy("window", "sku_id")
    r = r.withColumn("_b", F.max(F.when(F.col("method") == baseline, F.abs(F.col("pred_units") - F.col("actual_units")))).over(key))
    win = F.when((F.col("actual_units") > 0) & (F.col("method") != baseline) & F.col("_b").isNotNull(),
                 (F.abs(F.col("pred_units") - F.col("actual_units")) < F.col("_b")).cast("double"))
    extra = r.groupBy("window", "method").agg(
        F.avg(win).alias("win_share"), F.count(F.when((F.col("actual_units") <= 0) & (F.col("pred_units") >= 1), 1)).alias("phantoms"))
    return extra.join(score_one_window(r, ["window", "method"]), ["window", "method"], "left")


def actuals_first_rows(weekly: DataFrame, keys: list[str], value: str, first: int) -> DataFrame:
    """Sum of the first ``first`` observed rows of a key (not calendar weeks)."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("week_start"))
    return weekly.withColumn("_r", r).where(F.col("_r") <= first).groupBy(*keys).agg(F.sum(value).alias(f"actual_first_{first}"))


def attribution_signals(weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Per (target, sku): units of the last ten weeks, and spread and target multiplier of last year's month profile.

    A month's multiplier is its units over the mean month, between 0.2 and 3;
    the spread is their deviation over their mean; the target's multiplier is
    the mean over the months that its four weeks touch. A target date is
    repeated over at most two years of weekly rows.
    """
    day, unit = F.col("week_start"), F.col("pos_units")
    near = F.filter(date_array(targets), lambda t: (day < t) & (F.year(day) >= F.year(t) - 1))
    w = weekly.withColumn("target_start", F.explode(near))
    last_year = F.year(day) == F.year("target_start") - 1
    months = [F.coalesce(F.sum(F.when(last_year & (F.month(day) == k), unit)), F.lit(0.0)) for k in range(1, 13)]
    g = w.groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(day >= F.date_sub("target_start", 70), unit)), F.lit(0.0)).alias("last_10w_units"), F.array(*months).alias("_m"))
    total = F.aggregate("_m", F.lit(0.0), lambda x, y: x + y)
    g = g.withColumn("_avg", total / 12)
    g = g.withColumn("_x", F.transform("_m", lambda v: F.least(F.lit(3.0), F.greatest(F.lit(0.2), v / F.nullif(F.col("_avg"), F.lit(0.0))))))
    mean = F.aggregate("_x", F.lit(0.0), lambda x, y: x + y) / 12
    g = g.withColumn("_mean", mean)
    spread = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda x, y: x + (y - F.col("_mean")) * (y - F.col("_mean"))) / 11)
    first, last = F.col("_x")[F.month("target_start") - 1], F.col("_x")[F.month(F.date_add("target_start", 27)) - 1]
    sold = F.col("_avg") > 0
    return g.select(*KEY, "last_10w_units", F.when(sold, spread / F.col("_mean")).otherwise(0.0).alias("monthly_cv"),
                    F.when(sold, (first + last) / 2).otherwise(1.0).alias("target_multiplier"))


def error_attribution(rows: DataFrame) -> DataFrame:
    """Tag every row with what explains its miss; the first tag is primary, all are kept.

    Needs ensemble (pred_units), naive_pred and actual_units, the method values
    aa_pred, tree_pred and other_preds (array of the rest; each may be NULL),
    zero_share, last_10w_units, monthly_cv and target_multiplier.
    """
    c = F.col
    err = F.abs(c("pred_units") - c("actual_units"))
    others = F.array_sort(F.filter(F.concat(F.array("aa_pred"), "other_preds"), lambda v: v.isNotNull() & (v > 0)))
    n = F.size(others)
    middle = (others[F.floor((n - 1) / 2).cast("int")] + others[F.floor(n / 2).cast("int")]) / 2
    tags = F.array_compact(F.array(
        F.when(F.coalesce("last_10w_units", F.lit(0.0)) <= 0, "silent_phantom"),
        F.when((c("aa_pred") <= 0.5) & (c("zero_share") > 0.80), "aa_collapse"),
        F.when((n > 0) & (c("tree_pred") >= F.array_max(others)) & (c("tree_pred") >= 2.0 * middle), "lgbm_drag"),
        F.when((F.coalesce("monthly_cv", F.lit(0.0)) > 0.5) & (F.coalesce("target_multiplier", F.lit(1.0)) < 0.7)
               & (c("naive_pred") > 0) & (c("pred_units") >= 1.5 * c("naive_pred")), "seasonal_extrapolation"),
        F.when((c("actual_units") > 0) & (F.abs(c("naive_pred") - c("actual_units")) < 0.5 * err), "naive_would_have_won")))
    out = rows.withColumns({"abs_error": err, "tags": tags})
    large = (c("actual_units") <= 0) | (err / F.nullif(c("actual_units"), F.lit(0.0)) > 0.30)
    rest = F.when(large, "residual").otherwise("within_tolerance")
    return out.withColumn("primary_tag", F.when(F.size("tags") > 0, c("tags")[0]).otherwise(rest))


def attribution_summary(tagged: DataFrame) -> DataFrame:
    """Rows and error share per primary tag and the verdict by the residual share."""
    g = tagged.groupBy("primary_tag").agg(F.count(F.lit(1)).alias("row_count"), F.sum("abs_error").alias("abs_error"))
    w = Window.partitionBy(F.lit(1))  # seven tags
    res = F.coalesce(F.sum(F.when(F.col("primary_tag") == "residual", F.col("abs_error"))).over(w), F.lit(0.0)) / F.sum("abs_error").over(w)
    return g.withColumns({
        "error_share": F.col("abs_error") / F.sum("abs_error").over(w),
        "verdict": F.when(res < 0.15, "GO").when(res < 0.40, "GO_WITH_CAVEAT").otherwise("HOLD")})


def category_scoreboard(rows: DataFrame, min_skus: int = 5) -> DataFrame:
    """Per category the forecast against the naive: error, hits and share of wins."""
    c = F.col
    e, n, a = F.abs(c("pred_units") - c("actual_units")), F.abs(c("naive_pred") - c("actual_units")), c("actual_units")
    g = rows.groupBy("category").agg(
        F.count(F.when(a > 0, 1)).alias("skus"), div(F.sum(F.when(a > 0, e)), F.sum(F.when(a > 0, a))).alias("wmape"),
        div(F.sum(F.when(a > 0, n)), F.sum(F.when(a > 0, a))).alias("naive_wmape"),
        F.avg(F.when(a > 0, (e / a <= 0.20).cast("double"))).alias("hit20"), F.avg(F.when(a > 0, (e < n).cast("double"))).alias("win_share"),
        F.count(F.when((a == 0) & (c("pred_units") >= 1), 1)).alias("phantoms"),
        F.coalesce(F.sum(F.when((a == 0) & (c("pred_units") >= 1), c("pred_units"))), F.lit(0.0)).alias("phantom_units"))
    return g.where(F.col("skus") >= min_skus)


def campaign_exposure(matrix: DataFrame, group: str) -> DataFrame:
    """Share of rows with campaign, non-window and window history, recency, unit and revenue shares by any column."""
    c = F.col
    share = lambda cond: F.avg(cond.cast("double"))
    return matrix.groupBy(F.col(group).alias("group_value")).agg(
        F.count(F.lit(1)).alias("row_count"), share(c("campaign_txn_13w") > 0).alias("campaign_share"),
        share(c("non_bf_campaign_txn_13w") > 0).alias("non_bf_share"), share(c("bf_txn_13w") > 0).alias("bf_share"),
        share(c("days_since_campaign_txn") <= 28).alias("recent_share"),
        div(F.sum("campaign_units_13w"), F.sum("pos_units_13w")).alias("unit_share"),
        div(F.sum("campaign_revenue_13w"), F.sum("revenue_13w")).alias("revenue_share"),
        F.avg("avg_campaign_discount_13w").alias("mean_discount"))


def non_finite_cells(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with any non-finite numeric cell."""
    bad = [(F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf"))).cast("int") for c in columns]
    return matrix.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.aggregate(F.array(*bad), F.lit(0), lambda a, x: a + x)).alias("bad_cells"))


