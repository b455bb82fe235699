"""Regime labels of every sku as of any number of cut-off weeks, in one pass."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.numbers import revenue_bucket, volume_bucket
from stocktide.operators.ordering import global_running

# Rule thresholds.
REVENUE_COVERAGE = 0.80
MIN_ACTIVE_WEEKS, MIN_ACTIVE_WINDOWS, MIN_UNITS_PER_4W = 12, 26, 2.0
SEASONAL_MIN_UNITS, SEASONAL_MONTHS = 4.0, (2, 7)
SEASONAL_TOP3, SEASONAL_CV, SEASONAL_YEARS, SEASONAL_RECURRING = 0.60, 0.90, 2, 1
SCORING_POLICY = {
    "forecastable_revenue_movers": "quantity_4w_material",
    "seasonal_revenue_movers": "seasonal_active_or_zero",
    "active_movers": "quantity_secondary",
    "sparse_revenue_items": "track_sparse_revenue",
    "long_tail_active": "sale_probability",
    "dormant": "zero_or_reactivation",
}


def date_array(dates: list[dt.date]) -> Column:
    return F.array(*[F.lit(d) for d in dates])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def history_metrics(weekly: DataFrame, cutoffs: list[dt.date]) -> DataFrame:
    """Activity, revenue and seasonality of every sku per cut-off.

    Needs (sku_id, week_start, net_revenue, pos_units). Active weeks, 4-week
    windows, months and years are bit masks folded with ``bit_or``, so one
    grouped aggregate with partial combining does all of it: no dense grid, no
    list per sku. Weeks older than 104 weeks only matter for first and last
    sight, and are folded to one row per gap between cut-offs beforehand.
    """
    last = max(cutoffs)
    old = F.col("week_start") < F.date_sub(F.lit(min(cutoffs)), 103 * 7)
    folded = (
        weekly.where(F.col("week_start") <= F.lit(last))
        .withColumn("_w", F.when(old, F.lit(dt.date(1900, 1, 1))).otherwise(F.col("week_start")))
        .groupBy("sku_id", "_w").agg(
            F.min("week_start").alias("w0"), F.max("week_start").alias("w1"),
            F.sum("net_revenue").alias("revenue"), F.sum("pos_units").alias("units")))
    wide = folded.withColumn("as_of_week", F.explode(F.filter(date_array(cutoffs), lambda c: F.col("w1") <= c)))
    age = (F.datediff("as_of_week", "w1") / 7).cast("int")
    new = F.col("_w") > F.lit(dt.date(1900, 1, 1))
    in52, in104 = new & (age < 52), new & (age < 104)
    sells = F.col("units") > 0
    first104 = F.date_sub(F.col("as_of_week"), 103 * 7)
    month_no = (F.year("w1") - F.year(first104)) * 12 + F.month("w1") - F.month(first104)
    bit = lambda c, n: F.coalesce(F.bit_or(F.when(c & sells, F.expr("1L") * F.pow(F.lit(2), n).cast("long"))), F.lit(0))
    g = wide.groupBy("as_of_week", "sku_id").agg(
        F.min("w0").alias("first_seen_week"), F.max("w1").alias("last_seen_week"),
        F.coalesce(F.sum(F.when(in52, F.col("revenue"))), F.lit(0.0)).alias("trailing_52w_revenue"),
        F.coalesce(F.sum(F.when(in52, F.col("units"))), F.lit(0.0)).alias("trailing_52w_pos_units"),
        bit(in52, 51 - age).alias("_weeks"), bit(in104, month_no).alias("_months"),
        bit(in104, F.year("w1") - F.year(first104)).alias("_years"),
        *[F.coalesce(F.sum(F.when(in104 & (F.month("w1") == m), F.col("units"))), F.lit(0.0)).alias(f"_m{m}")
          for m in range(1, 13)],
    )
    by_month = F.array(*[F.col(f"_m{m}") for m in range(1, 13)])
    g = g.withColumns({
        "_all": F.aggregate(by_month, F.lit(0.0), lambda a, x: a + x),
        "_top3": F.aggregate(F.slice(F.sort_array(by_month, False), 1, 3), F.lit(0.0), lambda a, x: a + x),
    })
    mean = F.col("_all") / 12
    spread = F.sqrt(F.aggregate(by_month, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 12)
    windows = F.expr("(_weeks | shiftright(_weeks, 1) | shiftright(_weeks, 2) | shiftright(_weeks, 3)) & 562949953421311L")
    # a month counts as recurring when two of its years (12 or 24 months apart) are active
    again = "(_months & shiftright(_months, 12)) | (_months & shiftright(_months, 24))"
    recurring = F.expr(f"bit_count((({again}) | shiftright({again}, 12)) & 4095L)")
    return g.select(
        "as_of_week", "sku_id", "first_seen_week", "last_seen_week", "trailing_52w_revenue", "trailing_52w_pos_units",
        F.bit_count("_weeks").alias("active_weeks_52"), F.bit_count(windows).alias("active_4w_windows_52"),
        (F.col("trailing_52w_pos_units") / 13).alias("avg_units_per_4w_52"),
        F.size(F.filter(by_month, lambda x: x > 0)).alias("active_months_104"),
        F.when(F.col("_all") > 0, F.col("_top3") / F.col("_all")).otherwise(0.0).alias("top3_month_unit_share_104"),
        F.when(mean > 0, spread / mean).otherwise(0.0).alias("monthly_cv_104"),
        F.bit_count("_years").alias("active_years_104"), recurring.alias("recurring_active_months_104"))


def category_attribution(cells: DataFrame, cutoffs: list[dt.date]) -> DataFrame:
    """Per sku and cut-off the hierarchy with the largest |revenue|, recent year first."""
    keys = ("sku_id", "category_norm", "product_family_v2", "category_signal_status")
    old = F.col("week_start") < F.date_sub(F.lit(min(cutoffs)), 51 * 7)
    folded = (
        cells.where(F.col("week_start") <= F.lit(max(cutoffs)))
        .withColumn("_w", F.when(old, F.lit(dt.date(1900, 1, 1))).otherwise(F.col("week_start")))
        .groupBy(*keys, "_w").agg(F.max("week_start").alias("w1"), F.sum("net_revenue").alias("revenue")))
    wide = folded.withColumn("as_of_week", F.explode(F.filter(date_array(cutoffs), lambda c: F.col("w1") <= c)))
    recent = (F.col("_w") > F.lit(dt.date(1900, 1, 1))) & (F.col("w1") >= F.date_sub(F.col("as_of_week"), 51 * 7))
    g = wide.groupBy("as_of_week", *keys).agg(
        F.sum("revenue").alias("full"), F.sum(F.when(recent, F.col("revenue"))).alias("recent"))
    cat = F.coalesce("category_norm", F.lit("NECUNOSCUT"))
    value = F.struct(
        cat.alias("category_norm"), F.coalesce("product_family_v2", cat).alias("product_family_v2"),
        F.coalesce("category_signal_status", F.lit("unknown")).alias("category_signal_status"))
    order = F.struct(
        F.when(F.col("recent").isNotNull(), 0).otherwise(1).alias("p"),
        (-F.abs(F.coalesce("recent", "full"))).alias("r"), value.alias("v"))
    return g.groupBy("as_of_week", "sku_id").agg(F.min(order).alias("o")).select("as_of_week", "sku_id", "o.v.*")


def revenue_rank(metrics: DataFrame) -> DataFrame:
    """Rank, running share and top-80 flag among skus with positive revenue."""
    pos = metrics.where(F.col("trailing_52w_revenue") > 0).select("as_of_week", "sku_id", "trailing_52w_revenue")
    run = global_running(pos, [F.col("trailing_52w_revenue").desc(), F.col("sku_id")], "trailing_52w_revenue", ["as_of_week"])
    before = (F.col("running_total") - F.col("trailing_52w_revenue")) / F.col("grand_total")
    return run.select(
        "as_of_week", "sku_id", "trailing_52w_revenue", F.col("row_rank").alias("revenue_rank"),
        (F.col("running_total") / F.col("grand_total")).alias("cumulative_revenue_share"),
        (before < REVENUE_COVERAGE).cast("int").alias("is_top_80_revenue"))


def assign_regime(df: DataFrame) -> DataFrame:
    """Regime, eligibility, policy and buckets from the joined metrics."""
    top = F.col("is_top_80_revenue") == 1
    steady = (
        (F.col("active_weeks_52") >= MIN_ACTIVE_WEEKS) & (F.col("active_4w_windows_52") >= MIN_ACTIVE_WINDOWS)
        & (F.col("avg_units_per_4w_52") >= MIN_UNITS_PER_4W))
    seasonal = (
        top & (F.col("trailing_52w_pos_units") >= SEASONAL_MIN_UNITS)
        & F.col("active_months_104").between(*SEASONAL_MONTHS)
        & (F.col("top3_month_unit_share_104") >= SEASONAL_TOP3) & (F.col("monthly_cv_104") >= SEASONAL_CV)
        & (F.col("active_years_104") >= SEASONAL_YEARS) & (F.col("recurring_active_months_104") >= SEASONAL_RECURRING))
    regime = (
        F.when(top & steady, "forecastable_revenue_movers").when(seasonal, "seasonal_revenue_movers")
        .when(steady, "active_movers").when(top, "sparse_revenue_items")
        .when(F.col("trailing_52w_pos_units") > 0, "long_tail_active").otherwise("dormant"))
    out = df.withColumn("regime", regime)
    r = F.col("regime")
    return out.withColumns({
        "headline_eligible": (r == "forecastable_revenue_movers").cast("int"),
        "business_target_eligible": r.isin("forecastable_revenue_movers", "seasonal_revenue_movers").cast("int"),
        "scoring_policy": lookup(SCORING_POLICY, r),
        "revenue_bucket": revenue_bucket(F.col("revenue_rank"), F.col("is_top_80_revenue")),
        "volume_bucket": volume_bucket(F.col("trailing_52w_pos_units")),
        "horizon_start": F.date_add("as_of_week", 7),
        "horizon_end": F.date_add("as_of_week", 34),
    })


def regime_labels(cells: DataFrame, weekly: DataFrame, cutoffs: list[dt.date]) -> DataFrame:
    """Labels of every (cut-off, sku) that has been seen by then."""
    if any(c.weekday() != 0 for c in cutoffs):
        raise ValueError("cut-off weeks must be Mondays")
    metrics = history_metrics(weekly, cutoffs)
    rank = revenue_rank(metrics)
    edge = rank.where("is_top_80_revenue = 1").groupBy("as_of_week").agg(
        F.min("trailing_52w_revenue").alias("top80_cutoff_revenue"))
    key = ["as_of_week", "sku_id"]
    df = (
        metrics.join(rank.drop("trailing_52w_revenue"), key, "left")
        .join(category_attribution(cells, cutoffs), key, "left")
        # one row per cut-off week asked for
        .join(F.broadcast(edge), "as_of_week", "left"))
    df = df.withColumns({
        "is_top_80_revenue": F.coalesce("is_top_80_revenue", F.lit(0)),
        "top80_cutoff_revenue": F.coalesce("top80_cutoff_revenue", F.lit(0.0)),
        "category_norm": F.coalesce("category_norm", F.lit("NECUNOSCUT")),
        "category_signal_status": F.coalesce("category_signal_status", F.lit("unknown")),
    }).withColumn("product_family_v2", F.coalesce("product_family_v2", "category_norm"))
    return assign_regime(df)


def regime_summary(labels: DataFrame) -> DataFrame:
    """Skus, revenue, units and revenue share per regime and per bucket."""
    total = labels.groupBy("as_of_week").agg(F.sum("trailing_52w_revenue").alias("all_revenue"))
    by = labels.select("as_of_week", "trailing_52w_revenue", "trailing_52w_pos_units", F.inline(F.array(*[
        F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in ("regime", "revenue_bucket", "volume_bucket")])))
    g = by.groupBy("as_of_week", "grouping", "value").agg(
        F.count(F.lit(1)).alias("skus"), F.sum("trailing_52w_revenue").alias("revenue"),
        F.sum("trailing_52w_pos_units").alias("units"))
    return g.join(total, "as_of_week").select(
        *g.columns, F.when(F.col("all_revenue") > 0, F.col("revenue") / F.col("all_revenue")).otherwise(0.0).alias("revenue_share"))


def abc_tiers(revenue: DataFrame, weeks: DataFrame, lumpy_share: float = 0.80) -> DataFrame:
    """A while the running revenue share is <= 0.80, B <= 0.95, else C; LUMPY by weeks without a row.

    ``revenue`` (sku_id, category, revenue), ``weeks`` (sku_id, weeks_with_rows, weeks_in_data).
    """
    run = global_running(revenue, [F.col("revenue").desc(), F.col("sku_id")], "revenue")
    share = F.col("running_total") / F.col("grand_total")
    gap = 1 - F.col("weeks_with_rows") / F.col("weeks_in_data")
    return run.join(weeks, "sku_id", "left").select(
        "sku_id", "category", "revenue", (F.col("revenue") / F.col("grand_total")).alias("revenue_share"),
        share.alias("cumulative_share"), F.when(share <= 0.80, "A").when(share <= 0.95, "B").otherwise("C").alias("tier"),
        gap.alias("zero_week_share"), F.when(gap > lumpy_share, "LUMPY").otherwise("SMOOTH").alias("demand_pattern"))


def abc_summary(tiers: DataFrame) -> DataFrame:
    """Per tier and, for the A tier, per category."""
    by = tiers.select("*", F.explode(F.when(F.col("tier") == "A", F.array(F.lit("ALL"), F.col("category")))
                                     .otherwise(F.array(F.lit("ALL")))).alias("scope"))
    return by.groupBy("tier", "scope").agg(
        F.count(F.lit(1)).alias("skus"), F.sum("revenue").alias("total_revenue"),
        F.count(F.when(F.col("demand_pattern") == "SMOOTH", 1)).alias("smooth_skus"),
        F.count(F.when(F.col("demand_pattern") == "LUMPY", 1)).alias("lumpy_skus"))
