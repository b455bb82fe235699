"""The shared test tables in the role of retail tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.functions.calendar import mondays
from stocktide.functions.text import discount_fraction
from stocktide.session import staged
from stocktide.operators.clean import campaign_signals, returns_split, sale_dates

AS_OF = dt.date(2001, 8, 1)
TARGETS = mondays("2000-07-03", 12)
SKU = {
    "dense": "concat(p_brand, '|', p_type)",
    "sparse": "concat('P', l_partkey)",
    "mixed": "CASE WHEN l_partkey % 2 = 0 THEN concat(p_brand, '|', p_type) ELSE concat('P', l_partkey) END",
}


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, d: str, name: str, build, write=staged) -> DataFrame:
    """A derived table that many queries read, written once per session and folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SHARED:
        _SHARED[key] = write(build())
    return _SHARED[key]


def forget_shared() -> None:
    """Make the next query build its tables anew (the benchmark times whole jobs)."""
    _SHARED.clear()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order line with its order, customer and part."""
    return (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    )


def txn(spark: SparkSession, d: str, grain: str = "mixed", parts: bool = True, stores: bool = True) -> DataFrame:
    """Typed transaction lines; joins a caller does not need can be left out."""
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    if stores:
        t = t.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    if parts:
        t = t.join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    sign = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -1.0D ELSE 1.0D END"
    cols = {
        "order_date": "CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END",
        "invoice_date": "CAST(l_shipdate AS DATE)",
        "quantity": f"{sign} * l_quantity",
        "line_value": f"{sign} * floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100",
        "discount_raw": "CASE WHEN l_linenumber = 7 AND l_partkey % 97 = 0 THEN 3.0D ELSE -l_discount END",
        "raion_raw": "CASE o_orderpriority WHEN '1-URGENT' THEN 'ONLINE' WHEN '5-LOW' THEN 'OUTLET' END",
        "campaign_raw": "CASE WHEN l_discount >= 0.08 THEN 'SPRING' WHEN l_partkey % 40 = 0 THEN 'FABRO LINE' END",
        "is_non_product": "CAST(l_partkey % 211 = 0 AS INT)",
        "sku_id": SKU[grain if parts else "sparse"],
    }
    if stores:
        cols["store_id"] = "concat('N', c_nationkey)"
        cols["store_type"] = "CASE c_nationkey % 3 WHEN 0 THEN 'hyperstore' WHEN 1 THEN 'smaller_store' ELSE 'hybrid' END"
    if parts:
        cols |= {
            "category_norm": "p_type", "product_family_v2": "p_brand", "product_name": "p_name",
            "category_source": "'category_raw'", "category_signal_status": "'observed'",
            "product_family_source": "'group_raw'", "product_family_signal_status": "'observed'",
        }
    t = t.withColumns({k: F.expr(v) for k, v in cols.items()})
    t = sale_dates(t).withColumns({
        "discount_pct": discount_fraction(F.col("discount_raw")),
        "campaign_bf_raw": F.expr(
            "CASE WHEN month(sale_date) = 11 AND l_suppkey % 3 = 0 THEN concat('BF ', year(sale_date), ' [03-23 NOIEMBRIE]') END"),
    })
    return returns_split(campaign_signals(t))


def products(df: DataFrame) -> DataFrame:
    """Product lines only."""
    return df.where(F.col("is_non_product") == 0)


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.expr("concat('S', s_suppkey)").alias("supplier_id"), F.col("s_name").alias("supplier_name"),
        F.expr("concat('C', s_nationkey)").alias("country"),
        F.expr("CAST(60 + s_suppkey % 4 * 30 AS INT)").alias("return_window_days"))


def supplier_orders(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(
        table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), F.expr("l_orderkey = o_orderkey"))
    li = li.withColumn("order_date", F.expr("CAST(o_orderdate AS DATE)"))
    li = li.withColumn("promised_date", F.expr("date_add(order_date, CAST(10 + l_suppkey % 15 AS INT))"))
    return li.select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("order_id"),
        F.expr("concat('S', l_suppkey)").alias("supplier_id"), F.expr("concat('P', l_partkey)").alias("sku_id"),
        "order_date", "promised_date",
        F.expr("""CASE WHEN o_orderstatus <> 'P' THEN date_add(promised_date,
            CAST((l_orderkey * 7 + l_linenumber * 3) % (5 + l_suppkey % 45) - 3 AS INT)) END""").alias("actual_date"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """One row per sparse sku and store seen in the lines."""
    t = txn(spark, d, "sparse", parts=False)
    g = t.groupBy("l_partkey", "c_nationkey").agg(F.max("order_date").alias("last_order"), F.min("l_suppkey").alias("s"))
    return g.select(
        F.expr("concat('P', l_partkey)").alias("sku_id"), F.expr("concat('N', c_nationkey)").alias("store_id"),
        F.expr("CAST((l_partkey * 13 + c_nationkey * 7) % 40 AS DOUBLE)").alias("units_in_stock"),
        F.expr("CASE WHEN l_partkey % 17 <> 0 THEN date_add(last_order, CAST(l_partkey % 20 AS INT)) END").alias("last_delivery_date"),
        F.expr("concat('S', s)").alias("supplier_id"))


def sku_dim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.expr("concat('P', p_partkey)").alias("sku_id"), F.col("p_name").alias("sku_name"), F.col("p_type").alias("category"),
        F.expr("concat('S', p_partkey % 100)").alias("supplier_id"),
        F.col("p_retailprice").alias("selling_price"), F.expr("round(p_retailprice * 0.6, 2)").alias("purchase_cost"))


def stock_monthly_store(spark: SparkSession, d: str, grain: str = "mixed") -> DataFrame:
    t = txn(spark, d, grain).where("store_type <> 'hybrid'")
    t = t.withColumn("stock_month", F.trunc("sale_date", "MM"))
    g = t.groupBy("sku_id", "l_partkey", "c_nationkey", "store_id", "store_type", "stock_month").agg(F.count(F.lit(1)).alias("n"))
    qty = F.expr("CAST((12 * month(stock_month) + 5 * l_partkey + 11 * c_nationkey) % 25 AS DOUBLE)")
    return g.groupBy("sku_id", "store_id", "store_type", "stock_month").agg(
        F.sum(qty).alias("stock_qty"), F.count(F.lit(1)).alias("source_row_count"))


_NAME = "concat(upper(p_name), CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat(' ', l_partkey) END)"


def sales_names(spark: SparkSession, d: str) -> DataFrame:
    """Product name keys as the sales lines carry them; every third is shared by many skus."""
    return txn(spark, d, stores=False).select(F.expr(_NAME).alias("product_name_key"), "sku_id").distinct()


def supplier_stock_lines(spark: SparkSession, d: str) -> DataFrame:
    """Monthly supplier stock by product *name*; every seventh name is unknown to sales."""
    t = txn(spark, d, "sparse", stores=False).withColumn("stock_month", F.trunc("sale_date", "MM"))
    name = F.expr(f"concat({_NAME}, CASE WHEN l_partkey % 7 = 0 THEN ' NEW' ELSE '' END)")
    return t.groupBy(name.alias("product_name_key"), F.expr("concat('S', l_suppkey)").alias("supplier_key"), "stock_month").agg(
        F.expr("CAST(sum(l_quantity) % 30 AS DOUBLE)").alias("supplier_stock_qty"),
        F.sum("l_extendedprice").alias("supplier_stock_value"))


def budgets(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "part").select(F.col("p_type").alias("category")).distinct()
    return cats.select(
        "category", F.explode(F.array(F.lit("2001-07"), F.lit("2001-08"))).alias("period"),
        F.expr("CAST(100000 + 1000 * length(category) AS DOUBLE)").alias("budget_lei"),
    ).withColumn("spent_lei", F.expr("round(budget_lei * CASE period WHEN '2001-08' THEN 0.4 ELSE 0.5 END, 2)"))
