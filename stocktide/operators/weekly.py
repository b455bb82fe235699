"""Weekly demand tables, coverage and conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.calendar import week_start, week_start_shifted
from stocktide.functions.numbers import positive

MEASURES = ("gross_units", "returned_units", "net_units", "gross_revenue", "returned_revenue", "net_revenue")
LABELS = ("category_norm", "category_source", "category_signal_status",
          "product_family_v2", "product_family_source", "product_family_signal_status")
COUNTS = ("num_transactions", "num_return_lines", "bf_transaction_count", "bf_observed_transaction_count",
          "bf_inferred_transaction_count", "online_transaction_count", "outlet_transaction_count")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def line_aggregates() -> list[Column]:
    """The measures of a group of product lines."""
    return [
        *[F.sum(m).alias(m) for m in MEASURES],
        F.count(F.lit(1)).alias("num_transactions"),
        F.sum("is_return").alias("num_return_lines"),
        count_if(F.col("is_bf_timing") == 1).alias("bf_transaction_count"),
        count_if(F.col("is_bf_observed") == 1).alias("bf_observed_transaction_count"),
        count_if(F.col("is_bf_inferred") == 1).alias("bf_inferred_transaction_count"),
        count_if(F.upper("raion_raw") == "ONLINE").alias("online_transaction_count"),
        count_if(F.upper("raion_raw") == "OUTLET").alias("outlet_transaction_count"),
    ]


def weekly_store_demand(lines: DataFrame) -> DataFrame:
    """Product lines -> one row per (sku, store, type, Monday)."""
    return lines.where(F.col("is_non_product") == 0).groupBy("sku_id", "store_id", "store_type", "week_start").agg(
        *[F.max(c).alias(c) for c in LABELS], *line_aggregates(),
        F.avg("discount_pct").alias("avg_discount_pct"), F.max("discount_pct").alias("max_discount_pct"))


def weekly_chain_demand(store_week: DataFrame) -> DataFrame:
    """Store weeks -> one row per (sku, Monday).

    Each store has one row per sku and week, so the selling stores are counted
    with plain conditional counts. The discount is the mean of store means.
    """
    sells = F.col("net_units") > 0
    return store_week.groupBy("sku_id", "week_start").agg(
        *[F.max(c).alias(c) for c in LABELS if c in store_week.columns],
        *[F.sum(m).alias(m) for m in MEASURES], *[F.sum(c).alias(c) for c in COUNTS],
        count_if(sells).alias("num_stores_selling"),
        count_if(sells & (F.col("store_type") == "hyperstore")).alias("num_hyperstores_selling"),
        count_if(sells & (F.col("store_type") == "smaller_store")).alias("num_smaller_stores_selling"),
        F.avg("avg_discount_pct").alias("avg_discount_pct"), F.max("max_discount_pct").alias("max_discount_pct"))


def store_week_coverage(lines: DataFrame) -> DataFrame:
    """Every Monday between a store's first and last week with its line count."""
    counts = lines.groupBy("store_id", "store_type", "week_start").agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy("store_id", "store_type").agg(F.min("week_start").alias("a"), F.max("week_start").alias("b"))
    grid = span.select("store_id", "store_type", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_start"))
    per_week = counts.groupBy("store_id", "week_start").agg(F.sum("n").alias("n"))
    return grid.join(per_week, ["store_id", "week_start"], "left").select(
        "store_id", "store_type", "week_start", F.lit(1).cast("long").alias("has_source_coverage"),
        F.coalesce("n", F.lit(0)).alias("transaction_count"))


def weekly_demand_legacy(lines: DataFrame, shifted: bool = True) -> DataFrame:
    """Daily lines -> weekly per (sku, store, category); the older rule moves a Monday back."""
    rule = week_start_shifted if shifted else week_start
    return lines.groupBy("sku_id", "store_id", "category_norm", rule(F.col("sale_date")).alias("week_start")).agg(
        F.sum("gross_units").alias("units_sold"), F.sum("returned_units").alias("units_returned"),
        F.sum("net_units").alias("net_units"), F.sum("net_revenue").alias("net_revenue"))


def weekly_net_demand(lines: DataFrame) -> DataFrame:
    """Weekly net units per (sku, store), clipped at 0 line by line."""
    return lines.groupBy("sku_id", "store_id", week_start(F.col("sale_date")).alias("week_start")).agg(
        F.sum(positive(F.col("gross_units") - F.col("returned_units"))).alias("net_units"))


def weekly_daily_stats(lines: DataFrame) -> DataFrame:
    """Weekly units, returns, selling days, any campaign, any zero day and mean per selling day."""
    day = lines.groupBy("sku_id", "store_id", "week_start", "sale_date").agg(
        F.sum(positive(F.col("net_units"))).alias("u"), F.sum("returned_units").alias("r"),
        F.max((F.col("campaign_signal_status") == "observed").cast("int")).alias("p"))
    g = day.groupBy("sku_id", "store_id", "week_start").agg(
        F.sum("u").alias("net_units"), F.sum("r").alias("returned_units"), count_if(F.col("u") > 0).alias("selling_days"),
        F.max("p").alias("any_promo"), F.max((F.col("u") == 0).cast("int")).alias("any_zero_day"))
    return g.withColumn("avg_per_selling_day", F.when(F.col("selling_days") > 0, F.col("net_units") / F.col("selling_days")).otherwise(0.0))


def import_totals(lines: DataFrame) -> DataFrame:
    """Store x year coverage with date source split and non-product count."""
    return lines.groupBy("store_id", F.year("sale_date").alias("sale_year")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("used_invoice_date_fallback").alias("fallback_lines"),
        F.sum("is_non_product").alias("non_product_lines"), F.countDistinct("sku_id").alias("skus"),
        F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"))


def conservation(*levels: tuple[str, DataFrame]) -> DataFrame:
    """Totals of the six measures at each named level."""
    out = None
    for name, df in levels:
        part = df.agg(*[F.round(F.sum(m), 2).alias(m) for m in MEASURES]).select(F.lit(name).alias("level"), *MEASURES)
        out = part if out is None else out.unionByName(part)
    return out


def integrity_checks(source: DataFrame, target: DataFrame, tiers: DataFrame) -> DataFrame:
    """Lines and skus on both sides, phantom, lost and untiered skus."""
    s = source.groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("in_source"))
    t = target.groupBy("sku_id").agg(F.sum("num_transactions").alias("m"), F.lit(1).alias("in_target"))
    k = tiers.select("sku_id", F.lit(1).alias("in_tiers"))
    return s.join(t, "sku_id", "full").join(k, "sku_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("source_lines"), F.coalesce(F.sum("m"), F.lit(0)).alias("target_lines"),
        F.count("in_source").alias("source_skus"), F.count("in_target").alias("target_skus"),
        count_if(F.col("in_source").isNull()).alias("phantom_skus"), count_if(F.col("in_target").isNull()).alias("lost_skus"),
        count_if(F.col("in_target").isNotNull() & F.col("in_tiers").isNull()).alias("untiered_skus"))


def store_year_profile(lines: DataFrame) -> DataFrame:
    return lines.groupBy("store_id", F.year("sale_date").alias("sale_year")).agg(
        F.count(F.lit(1)).alias("line_count"), F.countDistinct("sku_id").alias("skus"), F.sum("net_units").alias("net_units"),
        F.sum("net_revenue").alias("net_revenue"), F.avg("used_invoice_date_fallback").alias("fallback_share"),
        F.sum("is_return").alias("return_lines"))


def data_hygiene(lines: DataFrame) -> DataFrame:
    """Sign matrix of returns, validity of discounts and campaign counts in one pass."""
    q, v, d = F.col("quantity"), F.col("line_value"), F.col("discount_raw")
    return lines.agg(
        F.count(F.lit(1)).alias("line_count"),
        count_if((q < 0) & (v < 0)).alias("neg_qty_neg_value"), count_if((q < 0) & (v >= 0)).alias("neg_qty_pos_value"),
        count_if((q >= 0) & (v < 0)).alias("pos_qty_neg_value"), count_if((q >= 0) & (v >= 0)).alias("pos_qty_pos_value"),
        count_if(d.isNull()).alias("discount_missing"), count_if(d < 0).alias("discount_negative"),
        count_if(d.between(0, 1)).alias("discount_fraction"), count_if(F.abs(d) > 1).alias("discount_over_one"),
        count_if(F.col("campaign_signal_status") == "observed").alias("campaign_lines"),
        count_if(F.col("is_bf_timing") == 1).alias("bf_timing_lines"), F.sum("is_product_program").alias("program_lines"))


def demand_cells(lines: DataFrame) -> DataFrame:
    """Finest weekly table that labels, features and actuals are built from.

    One shuffle of the product lines; every window of the later blocks starts
    on a Monday, so weekly cells lose nothing against the lines.
    """
    promo = (F.col("campaign_signal_status") == "observed") & (F.col("is_product_program") == 0)
    fresh = promo & (F.col("is_bf_campaign") == 0)
    pos = positive(F.col("net_units"))
    ok = promo & F.col("discount_pct").between(0, 1)
    return lines.where(F.col("is_non_product") == 0).groupBy(
        "sku_id", "store_id", "store_type", "week_start", "category_norm", "product_family_v2", "category_signal_status",
    ).agg(
        *line_aggregates(),
        F.sum("discount_pct").alias("discount_sum"), F.count("discount_pct").alias("discount_n"),
        F.max("discount_pct").alias("discount_max"),
        count_if(F.col("campaign_signal_status") == "observed").alias("campaign_lines"),
        count_if(F.col("bf_signal_source").isin(
            "campaign_label_without_timing_evidence", "campaign_bf_outside_timing_window",
            "campaign_bf_without_timing_evidence")).alias("unknown_label_lines"),
        count_if(promo).alias("promo_txn"), F.sum(F.when(promo, pos)).alias("promo_units"),
        F.sum(F.when(promo, F.col("net_revenue"))).alias("promo_revenue"),
        count_if(fresh).alias("fresh_txn"), F.sum(F.when(fresh, pos)).alias("fresh_units"),
        F.sum("is_product_program").alias("program_txn"),
        F.sum(F.when(ok, F.col("discount_pct"))).alias("promo_discount_sum"),
        F.count(F.when(ok, F.col("discount_pct"))).alias("promo_discount_n"),
        F.max(F.when(ok, F.col("discount_pct"))).alias("promo_discount_max"),
        F.max(F.when(promo, F.col("sale_date"))).alias("last_promo_date"),
        F.max(F.when(F.col("is_bf_timing") == 1, F.col("sale_date"))).alias("last_bf_date"))


CELL_SUMS = (*MEASURES, *COUNTS, "campaign_lines", "unknown_label_lines", "promo_txn", "promo_units", "promo_revenue",
             "fresh_txn", "fresh_units", "program_txn", "promo_discount_sum", "promo_discount_n")


def chain_weeks(cells: DataFrame) -> DataFrame:
    """Cells -> one row per (sku, Monday) with all measures the later blocks need."""
    store = cells.groupBy("sku_id", "store_id", "store_type", "week_start").agg(
        *[F.sum(c).alias(c) for c in CELL_SUMS],
        (F.sum("discount_sum") / F.sum(F.when(F.col("discount_n") > 0, F.col("discount_n")))).alias("avg_discount_pct"),
        F.max("discount_max").alias("max_discount_pct"), F.max("promo_discount_max").alias("promo_discount_max"),
        F.max("last_promo_date").alias("last_promo_date"), F.max("last_bf_date").alias("last_bf_date"))
    sells = F.col("net_units") > 0
    return store.groupBy("sku_id", "week_start").agg(
        *[F.sum(c).alias(c) for c in CELL_SUMS],
        count_if(sells).alias("num_stores_selling"),
        count_if(sells & (F.col("store_type") == "hyperstore")).alias("num_hyperstores_selling"),
        count_if(sells & (F.col("store_type") == "smaller_store")).alias("num_smaller_stores_selling"),
        F.avg("avg_discount_pct").alias("avg_discount_pct"), F.max("max_discount_pct").alias("max_discount_pct"),
        F.max("promo_discount_max").alias("promo_discount_max"), F.max("last_promo_date").alias("last_promo_date"),
        F.max("last_bf_date").alias("last_bf_date")).withColumn("pos_units", positive(F.col("net_units")))
