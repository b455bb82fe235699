"""Monthly stock tables, name mapping and stock coverage."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.text import MONTH_NAMES, month_label_to_date, null_if_empty, parse_decimal_comma, strip_accents
from stocktide.operators.labels import date_array


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def header_month(header: str) -> dt.date | None:
    """First day of the month a column header such as '<MONTH> <YEAR>/...' names."""
    m = re.match(r"\s*([A-Z]+)\s+(20\d{2})/", header.upper())
    return dt.date(int(m[2]), MONTH_NAMES.index(m[1]) + 1, 1) if m and m[1] in MONTH_NAMES else None


def monthly_store_stock(wide: DataFrame, ids: list[str], sales_stores: DataFrame | None = None) -> DataFrame:
    """Wide '<MONTH> <YEAR>/...' columns -> one summed row per (ids, month); blanks are skipped.

    The month columns are found in the header, so other columns are never read.
    """
    months = [(c, header_month(c)) for c in wide.columns if c not in ids]
    cells = [F.struct(F.lit(m).alias("stock_month"), F.col(f"`{c}`").alias("cell")) for c, m in months if m]
    long = wide.select(*ids, F.inline(F.array(*cells))).select(
        *ids, "stock_month", parse_decimal_comma(F.col("cell")).alias("qty")).where(F.col("qty").isNotNull())
    if sales_stores is not None:
        long = allowed_stores(long, sales_stores)
    return long.groupBy(*ids, "stock_month").agg(F.sum("qty").alias("stock_qty"), F.count(F.lit(1)).alias("source_row_count"))


def allowed_stores(stock: DataFrame, sales: DataFrame) -> DataFrame:
    """Keep stock of stores that also sell."""
    return stock.join(sales.select("store_id").distinct(), "store_id", "left_semi")


def supplier_stock(raw: DataFrame) -> DataFrame:
    """Long supplier rows (period, supplier, product, qty, value as text) summed per month, supplier and product."""
    t = raw.select(
        month_label_to_date(F.col("period")).alias("stock_month"), strip_accents(null_if_empty(F.col("supplier"))).alias("supplier_key"),
        strip_accents(null_if_empty(F.col("product"))).alias("product_name_key"),
        parse_decimal_comma(F.col("qty")).alias("q"), parse_decimal_comma(F.col("value")).alias("v"))
    t = t.where("stock_month IS NOT NULL AND supplier_key IS NOT NULL AND product_name_key IS NOT NULL AND q IS NOT NULL")
    return t.groupBy("stock_month", "supplier_key", "product_name_key").agg(
        F.sum("q").alias("supplier_stock_qty"), F.sum("v").alias("supplier_stock_value"), F.count(F.lit(1)).alias("source_row_count"))


def name_map(sales_names: DataFrame) -> DataFrame:
    """Name key -> the one sku it stands for, or how many it could be.

    ``min``/``max`` tell one sku from many without keeping a set per name.
    """
    pairs = sales_names.select("product_name_key", "sku_id").distinct()
    g = pairs.groupBy("product_name_key").agg(F.count(F.lit(1)).alias("candidate_skus"), F.min("sku_id").alias("one"))
    return g.select(
        "product_name_key", "candidate_skus", F.when(F.col("candidate_skus") == 1, F.col("one")).alias("sku_id"),
        F.when(F.col("candidate_skus") == 1, "exact_unique").otherwise("ambiguous").alias("mapping_confidence"))


def join_name_mapping(stock: DataFrame, sales_names: DataFrame) -> DataFrame:
    """Add sku_id and mapping_confidence (exact_unique, ambiguous, unmapped) by product name."""
    out = stock.join(name_map(sales_names), "product_name_key", "left")
    return out.withColumns({
        "mapping_confidence": F.coalesce("mapping_confidence", F.lit("unmapped")),
        "candidate_skus": F.coalesce("candidate_skus", F.lit(0)),
    })


def _months_before(stock: DataFrame, targets: list[dt.date], reach: int = 6) -> DataFrame:
    """One row per (stock row, target) for the ``reach`` months before the target; lag 1 = the last one."""
    lag = lambda t: (F.year(t) - F.year("stock_month")) * 12 + F.month(t) - F.month("stock_month")
    out = stock.withColumn("target_start", F.explode(F.filter(date_array(targets), lambda t: lag(t).between(1, reach))))
    return out.withColumn("lag", lag(F.col("target_start")))


def _level_block(month: DataFrame, pre: str, qty: str) -> DataFrame:
    at = lambda k: F.coalesce(F.sum(F.when(F.col("lag") == k, F.col(qty))), F.lit(0.0))
    g = month.groupBy("target_start", "sku_id").agg(
        at(1).alias(f"{pre}_prev_month_qty"), at(2).alias(f"{pre}_two_months_before_qty"),
        at(3).alias(f"{pre}_three_months_before_qty"), F.count(F.lit(1)).cast("double").alias(f"{pre}_months_observed_6m"),
        count_if(F.col(qty) <= 0).cast("double").alias(f"{pre}_zero_months_6m"),
        F.max((F.col("lag") == 1).cast("double")).alias(f"{pre}_observed_prev_month"),
        *[F.coalesce(F.sum(F.when(F.col("lag") == 1, F.col(c))), F.lit(0)).cast("double").alias(f"{c}_prev_month")
          for c in month.columns if c.startswith(("stores_", "hyperstores_", "suppliers_"))],
        *([F.coalesce(F.sum(F.when(F.col("lag") == 1, F.col("value"))), F.lit(0.0)).alias(f"{pre}_value_prev_month"),
           (F.coalesce(F.sum(F.when(F.col("lag") <= 3, F.col("value"))), F.lit(0.0)) / 3).alias(f"{pre}_value_trailing_3m_avg")]
          if "value" in month.columns else []))
    p = F.col(f"{pre}_prev_month_qty")
    avg = (p + F.col(f"{pre}_two_months_before_qty") + F.col(f"{pre}_three_months_before_qty")) / 3
    return g.withColumns({f"{pre}_trailing_3m_avg": avg, f"{pre}_trailing_3m_trend": p - avg})


def stock_features(stock: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Store-stock block per (target, sku); stock has one row per (sku, store, month)."""
    pos = F.col("stock_qty") > 0
    month = _months_before(stock, targets).groupBy("target_start", "sku_id", "lag").agg(
        F.sum("stock_qty").alias("q"), F.count(F.lit(1)).alias("stores_observed_stock"), count_if(pos).alias("stores_with_stock"),
        count_if(pos & (F.col("store_type") == "hyperstore")).alias("hyperstores_with_stock"))
    g = _level_block(month, "stock", "q")
    seen = F.col("stores_observed_stock_prev_month")
    return g.withColumns({
        "in_stock_before_target": (F.col("stock_prev_month_qty") > 0).cast("double"),
        "likely_stockout_before_target": ((F.col("stock_observed_prev_month") == 1) & (F.col("stock_prev_month_qty") <= 0)).cast("double"),
        "chain_stock_qty_before_target": F.col("stock_prev_month_qty"),
        "stock_signal_status": F.lit("observed"),
        "stock_coverage_bucket": F.when(seen >= 5, "broad_store_context").when(seen >= 2, "partial_store_context")
        .when(seen >= 1, "single_store_context").otherwise("missing_prev_month"),
    })


def supplier_stock_features(stock: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Supplier-stock block per (target, sku), exact_unique names only."""
    s = stock.where((F.col("mapping_confidence") == "exact_unique") & F.col("sku_id").isNotNull())
    s = s.groupBy("sku_id", "supplier_key", "stock_month").agg(
        F.sum("supplier_stock_qty").alias("q"), F.coalesce(F.sum("supplier_stock_value"), F.lit(0.0)).alias("value"),
        F.max((F.col("supplier_stock_qty") > 0).cast("int")).alias("pos"))
    month = _months_before(s, targets).groupBy("target_start", "sku_id", "lag").agg(
        F.sum("q").alias("q"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("suppliers_observed"),
        F.sum("pos").alias("suppliers_with_stock"))
    g = _level_block(month, "supplier_stock", "q")
    p = F.col("supplier_stock_prev_month_qty")
    return g.withColumns({
        "supplier_available_before_target": (p > 0).cast("double"),
        "supplier_stock_signal_status": F.lit("observed"),
        "supplier_stock_coverage_bucket": F.when(F.col("supplier_stock_observed_prev_month") == 0, "history_no_prev_month")
        .when(p > 0, "positive_supplier_stock").otherwise("zero_supplier_stock"),
    })


def stock_coverage(labels: DataFrame, stock: DataFrame, mapped_supplier: DataFrame, weekly: DataFrame, targets: list[dt.date]) -> DataFrame:
    """Per (target, sku): last-month and any-earlier-month store and supplier stock, and recent selling weeks."""
    key = ["target_start", "sku_id"]

    def side(df: DataFrame, qty: str, pre: str) -> DataFrame:
        m = df.groupBy("sku_id", "stock_month").agg(F.sum(qty).alias("q"))
        prev = lambda t: F.add_months(F.trunc(t, "MM"), -1)
        m = m.withColumn("target_start", F.explode(F.filter(date_array(targets), lambda t: F.col("stock_month") <= prev(t))))
        last = F.col("stock_month") == prev(F.col("target_start"))
        return m.groupBy(*key).agg(
            F.max(last.cast("int")).alias(f"{pre}_prev_observed"), F.sum(F.when(last, F.col("q"))).alias(f"{pre}_prev_qty"),
            F.lit(1).alias(f"{pre}_any_observed"), F.max((F.col("q") > 0).cast("int")).alias(f"{pre}_any_positive"))

    recent = weekly.withColumn("target_start", F.explode(F.filter(
        date_array(targets), lambda t: (F.col("week_start") < t) & (F.col("week_start") >= F.date_sub(t, 91)))))
    recent = recent.groupBy(*key).agg(F.max("num_stores_selling").alias("recent_selling_stores"))
    sup = mapped_supplier.where(F.col("mapping_confidence") == "exact_unique")
    out = (labels.select(*key).join(side(stock, "stock_qty", "store"), key, "left")
           .join(side(sup, "supplier_stock_qty", "supplier"), key, "left").join(recent, key, "left"))
    out = out.fillna(0)
    return out.withColumn("any_prev_positive", ((F.col("store_prev_qty") > 0) | (F.col("supplier_prev_qty") > 0)).cast("int"))


def stock_coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("target_start").agg(
        F.count(F.lit(1)).alias("skus"), F.avg("store_prev_observed").alias("store_prev_share"),
        F.avg("supplier_prev_observed").alias("supplier_prev_share"), F.avg("store_any_observed").alias("store_any_share"),
        F.avg("supplier_any_observed").alias("supplier_any_share"), F.avg("any_prev_positive").alias("positive_share"),
    ).withColumn("decision", F.when(F.col("store_prev_share") >= 0.8, "coverage_ready")
                 .when(F.greatest("store_prev_share", "supplier_prev_share") >= 0.5, "coverage_partial").otherwise("coverage_gap"))


def stock_month_profile(stock: DataFrame) -> DataFrame:
    return stock.groupBy("store_id", "stock_month").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("sku_id").alias("skus"),
        count_if(F.col("stock_qty") == 0).alias("zero_records"), count_if(F.col("stock_qty") < 0).alias("negative_records"),
        F.sum("stock_qty").alias("total_qty"))


def set_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of both key sets, their intersection and both differences."""
    a = left.select(key).distinct().withColumn("a", F.lit(1))
    b = right.select(key).distinct().withColumn("b", F.lit(1))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, key, "full").agg(
        F.count("a").alias("left_keys"), F.count("b").alias("right_keys"), count_if(both).alias("both_keys"),
        count_if(F.col("b").isNull()).alias("only_left"), count_if(F.col("a").isNull()).alias("only_right"))


def stock_overlap(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Per store: skus with sales, with stock, with both."""
    a = sales.select("store_id", "sku_id").distinct().withColumn("a", F.lit(1))
    b = stock.select("store_id", "sku_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, ["store_id", "sku_id"], "full").groupBy("store_id").agg(
        F.count("a").alias("sales_skus"), F.count("b").alias("stock_skus"),
        count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_skus"),
        count_if(F.col("a").isNull()).alias("stock_only"))


def coverage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records, skus and months per store before and after an import."""
    prof = lambda df, p: df.groupBy("store_id").agg(
        F.count(F.lit(1)).alias(f"records_{p}"), F.countDistinct("sku_id").alias(f"skus_{p}"),
        F.countDistinct("stock_month").alias(f"months_{p}"))
    out = prof(before, "before").join(prof(after, "after"), "store_id", "full").fillna(0)
    return out.select("*", *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in ("records", "skus", "months")])


def supplier_map_profile(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy(F.year("stock_month").alias("stock_year"), "mapping_confidence").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("product_name_key").alias("keys"),
        F.countDistinct("sku_id").alias("skus"), count_if(F.col("supplier_stock_qty") == 0).alias("zero_records"),
        count_if(F.col("supplier_stock_qty") < 0).alias("negative_records"))


def new_file_profile(rows: DataFrame, key: list[str], qty: str, month: str) -> DataFrame:
    """Per source file: rows, months, repeated keys, missing, zero and negative values."""
    g = rows.groupBy("source_file", *key, month).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(qty).isNull()).alias("nul"), count_if(F.col(qty) == 0).alias("zer"),
        count_if(F.col(qty) < 0).alias("neg"))
    return g.groupBy("source_file").agg(
        F.sum("n").alias("row_count"), F.countDistinct(month).alias("months"),
        F.sum(F.col("n") - 1).alias("duplicate_key_rows"), F.sum("nul").alias("null_values"), F.sum("zer").alias("zero_values"),
        F.sum("neg").alias("negative_values"))


def rotation_profile(rows: DataFrame, measures: list[str], sales_skus: DataFrame) -> DataFrame:
    """Missing and positive rate of every measure per store, with the share of known skus."""
    t = rows.join(sales_skus.select("sku_id").distinct().withColumn("_k", F.lit(1)), "sku_id", "left")
    return t.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(F.col("_k").isNotNull().cast("double")).alias("known_sku_share"),
        *[F.avg(F.col(m).isNull().cast("double")).alias(f"{m}_missing_rate") for m in measures],
        *[F.avg(F.coalesce(F.col(m) > 0, F.lit(False)).cast("double")).alias(f"{m}_positive_rate") for m in measures])
