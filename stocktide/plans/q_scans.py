"""Readers of text exports on text tables made of all lines, with headers as the exports have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktide.plans.registry import query
from stocktide.sources import files as fs

_DAY = "2026-01-31"


def _text_lines(spark, d, columns):
    """Every line as text: header -> expression; numbers get a decimal comma."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    number = lambda c: f"replace(format_string('%.2f', cast({c} as double)), '.', ',')"
    numbers = ("l_quantity", "l_extendedprice", "l_tax", "l_discount")
    for n in numbers:
        lines = lines.withColumn(f"t_{n[2:]}", F.expr(number(n)))
    return lines.select(*[F.expr(e).alias(h) for h, e in columns.items()])


_TWO = lambda c: f"round({c}::DOUBLE, 2)"

ROTATION_D = (
    "months_of_stock rotation_general_stock_sales rotation_consolidated_stock rotation_supplier_total_stock_sales rotation_supplier_stock"
    " rotation_store_stock_sales rotation_store_stock store_available_qty store_total_qty store_reserved_qty")


@query("scan_rotation_snapshot", f"""
SELECT 'P' || l_partkey AS sku_id, CASE WHEN l_linenumber = 2 THEN 'HINT' ELSE 'N' || l_suppkey END AS store_id, {_TWO('l_quantity')} AS months_of_stock,
 CASE WHEN l_linenumber <> 3 THEN {_TWO('l_tax')} END AS rotation_general_stock_sales, {_TWO('l_discount')} AS rotation_consolidated_stock,
 {_TWO('l_tax')} AS rotation_supplier_total_stock_sales, l_linenumber::DOUBLE AS rotation_supplier_stock, {_TWO('l_quantity')} AS rotation_store_stock_sales,
 {_TWO('l_tax')} AS rotation_store_stock, {_TWO('l_quantity')} AS store_available_qty, {_TWO('l_extendedprice')} AS store_total_qty,
 CASE WHEN l_linenumber >= 4 THEN {_TWO('l_discount')} END AS store_reserved_qty, DATE '{_DAY}' AS snapshot_date
FROM lineitem WHERE l_linenumber <> 7""", ROTATION_D)
def _(spark, d):
    raw = _text_lines(spark, d, {
        "COD ARTICOL": "if(l_linenumber = 7, '#NULL', concat('P', l_partkey))", "MAGAZIN": "if(l_linenumber = 2, ' ', concat('N', l_suppkey))",
        "_store_hint": "'HINT'", "Nr luni de stoc": "t_quantity", "Viteza de rotatie general": "if(l_linenumber = 3, 'n/a', t_tax)",
        "Viteza de Rotatie Consolidat": "t_discount", "Viteza de rotatie Furnizor total": "t_tax", "Viteza de rotatie furnizor": "cast(l_linenumber as string)",
        "Viteza de rotatie Magazine Vanzari": "t_quantity", "Viteza de rotatie magazine": "t_tax", "Stoc disponibil": "t_quantity",
        "Stoc total": "t_extendedprice", "Stoc rezervat": "if(l_linenumber < 4, '', t_discount)"})
    return fs.rotation_snapshot(raw, _DAY)


SNAPSHOT_D = " ".join([*fs.SNAPSHOT_HEADERS, *fs.SNAPSHOT_PATTERNS])
_ABSENT = ("sellable_store_qty", "reserved_value", "rotation_m12", "months_stock_general", "avg_sales_metric")


@query("scan_stock_snapshot", f"""
SELECT 'P' || l_partkey AS sku_id, 'N' || (l_suppkey % 30) AS store_id, l_returnflag AS product_name, l_linestatus AS collection_age_bucket,
 CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS stock_entry_date,
 CASE WHEN l_linenumber = 1 THEN {_TWO('l_extendedprice')} ELSE {_TWO('l_quantity')} END AS supplier_available_qty, {_TWO('l_tax')} AS reserved_qty,
 l_orderkey::DOUBLE AS stock_age_days, {_TWO('l_discount')} AS months_stock_supplier, {', '.join(f'NULL::DOUBLE AS {c}' for c in _ABSENT)},
 {_TWO('l_quantity')} AS available_store_qty, {_TWO('l_tax')} AS outlet_available_qty,
 CASE WHEN l_linenumber = 3 THEN {_TWO('l_extendedprice')} ELSE {_TWO('l_quantity')} END AS total_store_qty, {_TWO('l_discount')} AS position_stock_qty,
 DATE '{_DAY}' AS snapshot_date, 'current_snapshot' AS feature_scope
FROM lineitem WHERE 'N' || (l_suppkey % 30) IN (SELECT 'N' || s_nationkey FROM supplier)""", SNAPSHOT_D)
def _(spark, d):
    raw = _text_lines(spark, d, {
        "ARTICOL COD": "concat('P', l_partkey)", "MAGAZIN": "concat('N', l_suppkey % 30)", "DENUMIRE ARTICOL": """concat('"', l_returnflag, '"')""",
        "VECHIME IN COLECTIE": "l_linestatus",
        "DATA INTRARE STOC": "case when l_linenumber = 5 then '31.02.1995' when l_linenumber % 2 = 0 then date_format(l_shipdate, 'd.M.yyyy') else date_format(l_shipdate, 'yyyy-M-d') end",
        "STOC DISPONIBIL FURNIZOR": "if(l_linenumber = 1, '', t_quantity)", "Stoc Disponibil Cantitativ Furnizor": "t_extendedprice",
        "Cantitate Stoc Rezervat": "t_tax", "NR ZILE STOC": "cast(l_orderkey as string)", "LUNI STOC FURNIZOR": "t_discount",
        "Stoc disponibil cantitativ": "t_quantity", "Stoc disponibil outlet": "t_tax", "CANTSTOC": "if(l_linenumber = 3, '#null', t_quantity)",
        "Stoc total cantitativ": "t_extendedprice", "Stoc total pozitie": "t_discount"})
    stores = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("N"), "s_nationkey").alias("store_id"))
    return fs.stock_snapshot(raw, _DAY, stores)


@query("scan_discount_lines", f"""
SELECT 'RED' || l_linenumber AS item_code, l_linestatus AS description, CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS line_date,
 CASE WHEN l_linenumber <> 6 THEN -{_TWO('l_extendedprice')} END AS line_value FROM lineitem""", "line_value")
def _(spark, d):
    raw = _text_lines(spark, d, {
        "Cod articol SEC": "concat('RED', l_linenumber)", "Denumire linie": "l_linestatus",
        "Data document": "if(l_linenumber = 5, 'unknown', date_format(l_shipdate, 'd.M.yyyy'))", "Valoare lei": "if(l_linenumber = 6, '-', concat('-', t_extendedprice))"})
    return fs.discount_export(raw)
