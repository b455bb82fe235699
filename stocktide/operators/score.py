"""Naive forecasts, actuals and scoring of four-week predictions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions.numbers import div, median3
from stocktide.operators.labels import date_array

NAIVE_MODELS = ("zero", "last4", "roll8_mean", "roll13_mean", "seasonal52", "median_naive")
MATERIAL_UNITS, PHANTOM_UNITS = 4.0, 1.0
KEY = ["target_start", "sku_id"]


def around_targets(weekly: DataFrame, targets: list[dt.date], back: int, ahead: int = 0) -> DataFrame:
    """One row per (weekly row, target) with the row's age in weeks; age >= 1 lies before the target."""
    near = F.filter(
        date_array(targets),
        lambda t: (F.col("week_start") >= F.date_sub(t, 7 * back)) & (F.col("week_start") < F.date_add(t, 7 * ahead)))
    out = weekly.withColumn("target_start", F.explode(near))
    return out.withColumn("age", (F.datediff("target_start", "week_start") / 7).cast("int"))


def naive_wide(weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Six naive forecasts per (target, sku) that has history in the look-back."""
    w = around_targets(weekly, targets, 52)
    within = lambda lo, hi: F.coalesce(F.sum(F.when(F.col("age").between(lo, hi), F.col("pos_units"))), F.lit(0.0))
    g = w.groupBy(*KEY).agg(
        F.lit(0.0).alias("zero"), within(1, 4).alias("last4"), (within(1, 8) / 8 * 4).alias("roll8_mean"),
        (within(1, 13) / 13 * 4).alias("roll13_mean"), within(49, 52).alias("seasonal52"))
    return g.withColumn("median_naive", median3(F.col("last4"), F.col("roll13_mean"), F.col("seasonal52")))


def with_naive(labels: DataFrame, naive: DataFrame) -> DataFrame:
    return labels.join(naive, KEY, "left").fillna(0.0, list(NAIVE_MODELS))


def to_long(wide: DataFrame, models: list[str] | tuple[str, ...], keys: list[str] = KEY) -> DataFrame:
    """Model columns -> (model_name, pred_units_4w) rows, floored at 0."""
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model_name"), F.greatest(F.col(m), F.lit(0.0)).alias("pred_units_4w")) for m in models])))


def actuals_4w(labels: DataFrame, weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Units, revenue and campaign lines of the four target weeks; skus without sales get 0."""
    w = around_targets(weekly, targets, 0, 4)
    g = w.groupBy(*KEY).agg(
        F.sum("pos_units").alias("actual_pos_units_4w"), F.sum("net_units").alias("actual_net_units_4w"),
        F.sum("net_revenue").alias("actual_net_revenue_4w"), F.count(F.when(F.col("net_units") < 0, 1)).alias("negative_unit_weeks"),
        F.sum("bf_transaction_count").alias("bf_txn_count"), F.sum("bf_observed_transaction_count").alias("bf_observed_txn_count"),
        F.sum("bf_inferred_transaction_count").alias("bf_inferred_txn_count"),
        F.sum("campaign_lines").alias("campaign_observed_txn_count"),
        F.sum("unknown_label_lines").alias("unknown_campaign_label_txn_count"))
    out = labels.select(*KEY).join(g, KEY, "left")
    return out.fillna(0, [c for c in g.columns if c not in KEY])


def campaign_bucket() -> Column:
    return (
        F.when(F.col("bf_observed_txn_count") > 0, "bf_observed").when(F.col("bf_inferred_txn_count") > 0, "bf_inferred")
        .when(F.col("unknown_campaign_label_txn_count") > 0, "unknown_campaign_label")
        .when(F.col("campaign_observed_txn_count") > 0, "campaign_observed_non_bf").otherwise("non_campaign"))


def error_columns(df: DataFrame, material: float = MATERIAL_UNITS) -> DataFrame:
    """Score columns from actual_units and pred_units."""
    a, p = F.col("actual_units"), F.col("pred_units")
    scored = a >= material
    num = lambda c: F.when(scored, c.cast("double"))
    return df.withColumns({
        "abs_error": F.abs(p - a), "signed_error": p - a, "quantity_scored": scored.cast("int"),
        "abs_pct_error": F.when(scored, F.abs(p - a) / a),
        "hit20": num(F.abs(p - a) / a <= 0.20), "hit30": num(F.abs(p - a) / a <= 0.30),
        "under20": num(p < 0.80 * a), "over20": num(p > 1.20 * a),
        "phantom": ((a == 0) & (p >= PHANTOM_UNITS)).cast("int"),
        "pred_sale": (p >= PHANTOM_UNITS).cast("int"), "actual_sale": (a > 0).cast("int"),
    })


LABEL_COLUMNS = ("regime", "headline_eligible", "business_target_eligible", "scoring_policy", "revenue_bucket",
                 "volume_bucket", "category_norm", "product_family_v2", "category_signal_status")


def score_rows(labels: DataFrame, predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """One row per (target, model, sku); a sku without prediction is kept and marked."""
    base = labels.join(actuals, KEY, "left").withColumn("campaign_bucket", campaign_bucket())
    rows = base.join(predictions, KEY, "left")
    rows = rows.withColumns({
        "missing_prediction": F.col("model_name").isNull().cast("int"),
        "model_name": F.coalesce("model_name", F.lit("missing_prediction")),
        "actual_units": F.coalesce("actual_pos_units_4w", F.lit(0.0)),
        "actual_net_units": F.coalesce("actual_net_units_4w", F.lit(0.0)),
        "actual_revenue": F.coalesce("actual_net_revenue_4w", F.lit(0.0)),
        "pred_units": F.greatest(F.coalesce("pred_units_4w", F.lit(0.0)), F.lit(0.0)),
    })
    carry = [c for c in (*LABEL_COLUMNS, "primary_route", "calendar_route_context", "revenue_rank") if c in rows.columns]
    rows = error_columns(rows)
    return rows.select(
        *KEY, "model_name", *carry, "campaign_bucket", "actual_units", "actual_net_units", "actual_revenue", "pred_units",
        "abs_error", "signed_error", "abs_pct_error", "hit20", "hit30", "under20", "over20", "quantity_scored", "phantom",
        "pred_sale", "actual_sale", "missing_prediction")


def metric_aggregates() -> list[Column]:
    """The metrics of any group of score rows."""
    s = F.col("quantity_scored") == 1
    on = lambda c: F.coalesce(F.sum(F.when(s, F.col(c))), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("n_population"), F.count(F.when(s, 1)).alias("n_quantity_scored"),
        F.count(F.when(F.col("actual_units") == 0, 1)).alias("n_zero_actual"), F.sum("phantom").alias("n_phantom"),
        on("actual_units").alias("actual_units"), on("pred_units").alias("pred_units"),
        div(on("abs_error"), on("actual_units")).alias("wmape"),
        F.avg("hit20").alias("hit20"), F.avg("hit30").alias("hit30"),
        div(on("signed_error"), on("actual_units")).alias("bias_pct"),
        F.avg(F.when(F.col("actual_units") == 0, F.col("phantom"))).alias("phantom_rate"),
        F.avg("under20").alias("under20_rate"), F.avg("over20").alias("over20_rate"),
    ]


METRIC_DOUBLES = "actual_units pred_units wmape hit20 hit30 bias_pct phantom_rate under20_rate over20_rate"
METRIC_LONGS = "n_population n_quantity_scored n_zero_actual n_phantom"


def win_flags(rows: DataFrame, baseline: str = "median_naive") -> DataFrame:
    """``win`` = 1.0 when the error is smaller than the baseline's on the same sku; NULL for the baseline itself."""
    over = Window.partitionBy(*KEY)
    base = F.max(F.when(F.col("model_name") == baseline, F.col("abs_error"))).over(over)
    scored = (F.col("quantity_scored") == 1) & (F.col("model_name") != baseline)
    return rows.withColumn("_base", base).withColumn(
        "win", F.when(scored & F.col("_base").isNotNull(), (F.col("abs_error") < F.col("_base")).cast("double"))).drop("_base")


def winrate_vs_baseline(rows: DataFrame, baseline: str = "median_naive") -> DataFrame:
    return win_flags(rows, baseline).where(F.col("model_name") != baseline).groupBy("target_start", "model_name").agg(
        F.count("win").alias("n_compared"), F.avg("win").alias("winrate_vs_median_naive"))


def slices_of(rows: DataFrame) -> DataFrame:
    """Repeat each row once per slice it belongs to (at most seven)."""
    s = lambda t, v: F.struct(F.lit(t).alias("slice_type"), v.alias("slice_value"))
    return rows.withColumn("_s", F.explode(F.array_compact(F.array(
        s("all", F.lit("all")),
        F.when(F.col("headline_eligible") == 1, s("headline", F.lit("forecastable_revenue_movers"))),
        F.when(F.col("business_target_eligible") == 1, s("business_target", F.lit("forecastable_plus_seasonal"))),
        s("regime", F.col("regime")), s("revenue_bucket", F.col("revenue_bucket")),
        s("category_norm", F.col("category_norm")), s("campaign_bucket", F.col("campaign_bucket")),
    )))).select("*", "_s.*").drop("_s")


def score_slices(rows: DataFrame, by_run: bool = True) -> DataFrame:
    """Metrics per model and slice, for each target or (``by_run`` False) pooled over all."""
    keys = (["target_start"] if by_run else []) + ["model_name", "slice_type", "slice_value"]
    return slices_of(win_flags(rows)).groupBy(*keys).agg(*metric_aggregates(), F.avg("win").alias("winrate_vs_median_naive"))


def group_metrics(rows: DataFrame, group: str, min_scored: int = 0) -> DataFrame:
    """Metrics by any column with the group's share of each model's revenue."""
    g = rows.groupBy("model_name", F.col(group).alias("group_value")).agg(
        *metric_aggregates(), F.sum("actual_revenue").alias("revenue"))
    total = F.sum("revenue").over(Window.partitionBy("model_name"))
    return g.withColumn("revenue_share", div(F.col("revenue"), total)).where(F.col("n_quantity_scored") >= min_scored)
