"""Cleaning, de-duplication, tiers and promotions on text rows derived from the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktide.functions import calendar as cal
from stocktide.functions import numbers as nu
from stocktide.functions import text as tx
from stocktide.operators import audit as au
from stocktide.operators import clean as cl
from stocktide.operators import hierarchy as hi
from stocktide.operators import labels as lab
from stocktide.operators import promo as pr
from stocktide.operators import weekly as wk
from stocktide.plans import fixtures as fx

from stocktide.plans.oracle import BLOCKS
from stocktide.plans.q_series import weekly
from stocktide.plans.registry import query
from stocktide.sources import files as fs
from stocktide.sources import sinks as sn

# raw category text by part key, and what it stands for
RAW_NAMES = [
    ("017 MOBILIER DE CASA - MIC MOBILIER", "MOBILIER DE CASA", "MOBILIER DE CASA - MIC MOBILIER"),
    ("TOTAL OFFICE", "MOBILIER OFFICE", "OFFICE"),
    ("Canapele  si fotolii", "CANAPELE SI FOTOLII", "CANAPELE SI FOTOLII"),
    ("Saltele pentru copii", "SALTELE SI SOMIERE", "SALTELE PENTRU COPII"),
    ("#null", None, None),
    ("MOBILIER BAIE SI SANITRE", "MOBILIER BAIE SI SANITARE", "MOBILIER BAIE SI SANITARE"),
    ("Decoratiuni outdoor", "ACCESORII", "DECORATIUNI OUTDOOR"),
    ("MOBILIER DE CASA -BUCATARII", "MOBILIER BUCATARII", "BUCATARII"),
    ("Ceva nou", None, "CEVA NOU"),
]


def pick_sql(values: list[str | None], key: str, n: int) -> str:
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


NAMES = [r[0] for r in RAW_NAMES]
_AISLE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'ONLINE' WHEN '5-LOW' THEN 'OUTLET' WHEN '2-HIGH' THEN 'Gradina' END"


def exports(spark, d):
    """Lines as an all-text export with blanks, #null, quotes, BOM, decimal commas and two date formats."""
    t = fx.raw_lines(spark, d)
    sign = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -1 ELSE 1 END"
    comma = lambda e: f"replace(format_string('%.2f', CAST({e} AS DOUBLE)), '.', ',')"
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "c_nationkey", *[F.expr(e).alias(n) for n, e in {
        "COD ARTICOL": "CASE WHEN l_partkey % 89 = 0 THEN '#null' ELSE concat(' \"P', l_partkey, '\" ') END",
        "DATA COMANDA": "CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN l_linenumber % 2 = 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END",
        "DATA": "CASE WHEN o_orderkey % 100 = 0 AND l_linenumber = 1 THEN '31.02.2000' ELSE date_format(l_shipdate, 'dd.MM.yyyy') END",
        "MAGAZIN": "CASE WHEN c_nationkey % 5 = 4 THEN concat('Shop & Co. ', c_nationkey) ELSE concat('store ', c_nationkey, ' srl') END",
        "CANTITATE FACTURATA": comma(f"{sign} * l_quantity"),
        "VALOARE FACTURATA": comma(f"{sign} * floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100"),
        "Reducere %": "CASE WHEN l_linenumber = 7 AND l_partkey % 97 = 0 THEN 'Infinity' WHEN l_linenumber = 6 AND l_partkey % 97 = 1 THEN '3' WHEN l_linenumber = 5 THEN '#null' ELSE concat('-', replace(CAST(l_discount AS STRING), '.', ',')) END",
        "CATEGORIE": pick_sql(NAMES, "l_partkey", len(NAMES)),
        "CLASA": "CASE WHEN l_partkey % 4 = 0 THEN 'Montaj si servicii' WHEN l_partkey % 18 = 4 THEN '055 MESE SI SCAUNE' END",
        "RAION": _AISLE,
        "DENUMIRE ARTICOL": "concat(p_name, CASE l_partkey % 3 WHEN 0 THEN ' 160x200' WHEN 1 THEN ' 43,5 x 48,5x56.5cm' ELSE '' END)",
        "CAMPANIE": "CASE WHEN l_discount >= 0.08 THEN 'SPRING' WHEN l_partkey % 40 = 0 THEN 'FABRO LINE' WHEN l_suppkey % 11 = 0 THEN concat('Black Friday ', 1994 + l_suppkey % 7) END",
        "CAMPANIE BF": "CASE WHEN month(o_orderdate) = 11 AND l_suppkey % 3 = 0 THEN concat('BF ', year(o_orderdate), ' [03-23 NOIEMBRIE]') WHEN l_suppkey % 97 = 5 THEN 'BF special' END",
        "ID COMANDA": "CAST(l_orderkey AS STRING)", "ID FACTURA": "concat(l_orderkey, '-', l_linenumber)",
        "FURNIZOR": "CASE WHEN l_suppkey % 10 <> 0 THEN concat('S', l_suppkey) END",
        "puncte": "CASE l_linenumber % 4 WHEN 0 THEN 'da' WHEN 1 THEN 'NU' WHEN 2 THEN 'maybe' END",
        "source_file": "concat('store_', c_nationkey, CASE WHEN l_linenumber <= 5 THEN '_full.csv' ELSE '_old.csv' END)",
    }.items()])


def stores(spark, d):
    """Store list: every store but each fifth nation has a known legal name."""
    n = fx.table(spark, d, "nation").where("n_nationkey % 5 <> 4")
    return n.selectExpr("concat('STORE ', n_nationkey, ' SRL') AS store_name", "concat('N', n_nationkey) AS store_id",
                        "CASE n_nationkey % 3 WHEN 0 THEN 'hyperstore' WHEN 1 THEN 'smaller_store' ELSE 'hybrid' END AS store_type")


def clean(spark, d):
    return cl.normalize_sales(exports(spark, d), stores(spark, d), "puncte")


BLOCKS["ex0"] = """
SELECT *, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -1.0 ELSE 1.0 END::DOUBLE AS s, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS od,
 CASE WHEN NOT (o_orderkey % 100 = 0 AND l_linenumber = 1) THEN CAST(l_shipdate AS DATE) END AS idt, month(o_orderdate) = 11 AND l_suppkey % 3 = 0 AS lab, l_suppkey % 97 = 5 AS lab2,
 CASE WHEN l_discount >= 0.08 THEN 'SPRING' WHEN l_partkey % 40 = 0 THEN 'FABRO LINE' WHEN l_suppkey % 11 = 0 THEN 'Black Friday ' || (1994 + l_suppkey % 7) END AS cam,
 CASE WHEN (l_linenumber = 7 AND l_partkey % 97 = 0) OR (l_linenumber = 6 AND l_partkey % 97 = 1) OR l_linenumber = 5 THEN NULL ELSE l_discount END AS dp
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""
BLOCKS["ex1"] = """
SELECT *, coalesce(od, idt) AS sd, s * l_quantity AS quantity, s * floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS line_value FROM ex0
WHERE l_partkey % 89 <> 0 AND coalesce(od, idt) IS NOT NULL"""
BLOCKS["ex2"] = """
SELECT *, make_date(year(sd), 11, 30) - CAST((isodow(make_date(year(sd), 11, 30)) + 2) % 7 AS INTEGER) AS lf,
 cam LIKE 'Black%' AND 1994 + l_suppkey % 7 >= 2000 AND 1994 + l_suppkey % 7 = year(sd) OR (cam LIKE 'Black%' AND 1994 + l_suppkey % 7 < 2000) AS fresh FROM ex1"""
BLOCKS["ex3"] = """
SELECT *, sd BETWEEN lf - 4 AND lf + 2 AS seas, lab AND sd BETWEEN make_date(CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) ELSE year(sd) END, 11, 3)
  AND make_date(CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) ELSE year(sd) END, 11, 23) AS ins FROM ex2"""
BLOCKS["ex4"] = """
SELECT *, CASE WHEN lab AND ins THEN 'campaign_bf_raw' WHEN lab THEN 'campaign_bf_outside_timing_window' WHEN lab2 AND seas THEN 'campaign_bf_raw_calendar_window'
 WHEN lab2 THEN 'campaign_bf_without_timing_evidence' WHEN seas AND coalesce(fresh, false) THEN 'inferred_current_year_campaign_and_calendar' WHEN seas AND dp >= 0.1 THEN 'inferred_calendar_discount'
 WHEN seas THEN 'inferred_calendar_window' WHEN coalesce(fresh, false) THEN 'campaign_label_without_timing_evidence' ELSE 'unknown' END AS src FROM ex3"""
_RAWV = ", ".join(f"({i}, {'NULL' if c is None else repr(c)}, {'NULL' if f is None else repr(f)})" for i, (_, c, f) in enumerate(RAW_NAMES))
BLOCKS["ex_h"] = f"SELECT * FROM (VALUES {_RAWV}) h(k, cat, fam)"
BLOCKS["ex5"] = """
SELECT *, CASE WHEN l_partkey % 18 = 4 AND l_partkey % 4 <> 0 THEN 'MOBILIER DE CASA' END AS cls, CASE WHEN o_orderpriority = '2-HIGH' THEN 'MOBILIER TERASA SI GRADINA' END AS ais FROM ex4 JOIN ex_h ON k = l_partkey % 9"""
BLOCKS["exx"] = """
SELECT 'P' || l_partkey AS sku_id, CASE WHEN c_nationkey % 5 = 4 THEN 'shop_co_' || c_nationkey ELSE 'N' || c_nationkey END AS store_id,
 CASE WHEN c_nationkey % 5 = 4 THEN 'unknown' ELSE CASE c_nationkey % 3 WHEN 0 THEN 'hyperstore' WHEN 1 THEN 'smaller_store' ELSE 'hybrid' END END AS store_type,
 sd AS sale_date, CASE WHEN od IS NULL THEN 'invoice_date_fallback' ELSE 'order_date' END AS sale_date_source, idt - od AS invoice_lag_days, CAST(date_trunc('week', sd) AS DATE) AS week_start,
 quantity, line_value, dp AS discount_pct, quantity AS net_units, line_value AS net_revenue, CASE WHEN quantity < 0 OR line_value < 0 THEN 1 ELSE 0 END AS is_return,
 CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS is_non_product,
 coalesce(cat, cls, ais, 'NECUNOSCUT') AS category_norm, CASE WHEN cat IS NOT NULL THEN 'category_raw' WHEN cls IS NOT NULL THEN 'class_raw' WHEN ais IS NOT NULL THEN 'raion_raw' ELSE 'unknown' END AS category_source,
 CASE WHEN coalesce(cat, cls, ais) IS NOT NULL THEN 'observed' ELSE 'unknown' END AS category_signal_status,
 CASE l_partkey % 3 WHEN 0 THEN '160x200' WHEN 1 THEN '43.5x48.5x56.5' END AS product_dimensions_raw, CASE WHEN l_partkey % 3 < 2 THEN 'product_name' ELSE 'unknown' END AS product_dimensions_source,
 src AS bf_signal_source, CASE WHEN src = 'campaign_bf_raw' THEN 'observed' WHEN src IN ('campaign_bf_raw_calendar_window', 'inferred_current_year_campaign_and_calendar', 'inferred_calendar_discount', 'inferred_calendar_window') THEN 'inferred' ELSE 'unknown' END AS bf_signal_status,
 CASE WHEN lab OR lab2 THEN 1 WHEN cam LIKE 'Black%' THEN 1 ELSE 0 END AS is_bf_campaign, CASE WHEN cam = 'FABRO LINE' THEN 1 ELSE 0 END AS is_product_program,
 CASE WHEN cam IS NULL THEN 'unknown' ELSE 'observed' END AS campaign_signal_status, CASE WHEN l_suppkey % 10 <> 0 THEN 'observed' ELSE 'unknown' END AS supplier_signal_status,
 CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS loyalty_points_used, l_orderkey || '-' || l_linenumber AS invoice_id, CAST(l_orderkey AS VARCHAR) AS order_id, p_name || CASE l_partkey % 3 WHEN 0 THEN ' 160x200' WHEN 1 THEN ' 43,5 x 48,5x56.5cm' ELSE '' END AS product_name,
 'store_' || c_nationkey || CASE WHEN l_linenumber <= 5 THEN '_full.csv' ELSE '_old.csv' END AS source_file FROM ex5"""
NORM_D = "quantity line_value discount_pct net_units net_revenue"
NORM_N = "invoice_lag_days is_return is_non_product is_bf_campaign is_product_program loyalty_points_used"
NORM = ["sku_id", "store_id", "store_type", "sale_date", "sale_date_source", "invoice_lag_days", "week_start", "quantity", "line_value", "discount_pct", "net_units", "net_revenue",
        "is_return", "is_non_product", "category_norm", "category_source", "category_signal_status", "product_dimensions_raw", "product_dimensions_source", "bf_signal_source",
        "bf_signal_status", "is_bf_campaign", "is_product_program", "campaign_signal_status", "supplier_signal_status", "loyalty_points_used", "source_file"]


@query("normalize_sales", f"SELECT {', '.join(NORM)} FROM exx", NORM_D, NORM_N)
def _(spark, d):
    return clean(spark, d).select(*NORM)


def tally(name, cols, sql_cols, longs="", doubles="", src="exx"):
    """Counts per distinct result of some cleaned columns, over all rows."""
    @query(name, f"SELECT {sql_cols}, count(*) AS row_count FROM {src} GROUP BY ALL", doubles, (longs + " row_count").strip())
    def _(spark, d):
        return clean(spark, d).groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count"))


tally("effective_sale_date", ["sale_date", "sale_date_source"], "sale_date, sale_date_source")
tally("invoice_lag_days", ["invoice_lag_days"], "invoice_lag_days", "invoice_lag_days")
tally("week_start", ["week_start"], "week_start")
tally("yes_no_flag", ["loyalty_points_used"], "loyalty_points_used", "loyalty_points_used")
tally("store_lookup", ["store_id", "store_type"], "store_id, store_type")
tally("non_product_flag", ["sku_id", "is_non_product"], "sku_id, is_non_product", "is_non_product")
tally("extract_dimensions", ["product_name", "product_dimensions_raw", "product_dimensions_source"], "product_name, product_dimensions_raw, product_dimensions_source")
tally("campaign_signals", ["bf_signal_source", "bf_signal_status", "is_bf_campaign", "is_product_program", "campaign_signal_status"],
      "bf_signal_source, bf_signal_status, is_bf_campaign, is_product_program, campaign_signal_status", "is_bf_campaign is_product_program")
tally("hierarchy_normalize", ["category_norm", "category_source", "category_signal_status"], "category_norm, category_source, category_signal_status")
tally("discount_fraction", ["discount_pct"], "discount_pct", "", "discount_pct")


@query("returns_split", """
SELECT sku_id, sum(greatest(quantity, 0)) AS gross_units, sum(greatest(-quantity, 0)) AS returned_units, sum(quantity) AS net_units, sum(greatest(line_value, 0)) AS gross_revenue,
 sum(greatest(-line_value, 0)) AS returned_revenue, sum(line_value) AS net_revenue, sum(is_return) AS is_return FROM exx GROUP BY sku_id""",
       "gross_units returned_units net_units gross_revenue returned_revenue net_revenue", "is_return")
def _(spark, d):
    return clean(spark, d).groupBy("sku_id").agg(*[F.sum(c).alias(c) for c in (*wk.MEASURES, "is_return")])


@query("null_if_empty", """
SELECT CASE WHEN l_partkey % 89 <> 0 THEN 'P' || l_partkey END AS sku_id, CASE WHEN l_partkey % 9 <> 4 THEN l_partkey % 9 END AS name_no, count(*) AS row_count FROM lineitem GROUP BY ALL""", "", "name_no row_count")
def _(spark, d):
    e = exports(spark, d)
    names = F.array(*[F.lit(n) for n in NAMES])
    no = F.array_position(names, tx.null_if_empty(F.col("CATEGORIE"))) - 1
    return e.groupBy(tx.null_if_empty(F.col("COD ARTICOL")).alias("sku_id"), no.alias("name_no")).agg(F.count(F.lit(1)).alias("row_count"))


@query("parse_decimal_comma", "SELECT l_orderkey, sum(quantity) AS quantity, sum(line_value) AS line_value FROM (SELECT l_orderkey, s * l_quantity AS quantity, s * floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS line_value FROM ex0) GROUP BY l_orderkey",
       "quantity line_value")
def _(spark, d):
    p = lambda c: F.sum(tx.parse_decimal_comma(F.col(c)))
    return exports(spark, d).groupBy("l_orderkey").agg(p("CANTITATE FACTURATA").alias("quantity"), p("VALOARE FACTURATA").alias("line_value"))


@query("parse_date_multi", "SELECT od AS order_date, idt AS invoice_date, count(*) AS row_count FROM ex0 GROUP BY ALL", "", "row_count")
def _(spark, d):
    p = lambda c: tx.parse_date_multi(F.col(c))
    return exports(spark, d).groupBy(p("DATA COMANDA").alias("order_date"), p("DATA").alias("invoice_date")).agg(F.count(F.lit(1)).alias("row_count"))


@query("transaction_key", """
SELECT sha256(store_id || '|' || invoice_id || '|' || order_id || '|' || sku_id || '|' || CAST(sale_date AS VARCHAR) || '|' || CAST(line_value AS VARCHAR) || '|' || CAST(quantity AS VARCHAR) || '|' || product_name) AS transaction_key,
 count(*) AS row_count FROM exx GROUP BY ALL""", "", "row_count")
def _(spark, d):
    return clean(spark, d).groupBy("transaction_key").agg(F.count(F.lit(1)).alias("row_count"))


@query("strip_accents", "SELECT upper(p_name) AS name_key, count(*) AS row_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL", "", "row_count")
def _(spark, d):
    """Names written with accents and double spaces fold back to the plain key."""
    t = fx.table(spark, d, "lineitem").select("l_partkey").join(fx.table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    accented = F.concat(F.lit("  "), F.replace(F.translate("p_name", "aeiou", "ăéîöű"), F.lit(" "), F.lit("   ")))
    return t.groupBy(tx.strip_accents(accented).alias("name_key")).agg(F.count(F.lit(1)).alias("row_count"))


@query("month_label_to_date", "SELECT CASE WHEN year(o_orderdate) >= 2000 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month_start, count(*) AS row_count FROM orders GROUP BY ALL", "", "row_count")
def _(spark, d):
    label = F.concat(F.element_at(F.array(*[F.lit(m.title()) for m in tx.MONTH_NAMES]), F.month("o_orderdate")), F.lit("  "), F.year("o_orderdate").cast("string"), F.lit("/STOC"))
    return fx.table(spark, d, "orders").groupBy(tx.month_label_to_date(label).alias("month_start")).agg(F.count(F.lit(1)).alias("row_count"))


@query("bf_window_dim", """
SELECT y AS sale_year, lf - 4 AS signal_start, lf + 2 AS signal_end, make_date(y, 11, 3) AS feature_start, make_date(y, 11, 23) AS feature_end,
 count(*) FILTER (sale_date BETWEEN lf - 4 AND lf + 2) AS signal_lines, count(*) FILTER (sale_date BETWEEN make_date(y, 11, 3) AND make_date(y, 11, 23)) AS feature_lines
FROM (SELECT sale_date, y, lastfri AS lf FROM txn_sparse) GROUP BY y, lf""", "", "sale_year signal_lines feature_lines")
def _(spark, d):
    t = fx.txn(spark, d, parts=False, stores=False).withColumn("sale_year", F.year("sale_date"))
    (a, b), (p, q) = cal.bf_window_signal(F.col("sale_year")), cal.bf_window_feature(F.col("sale_year"))
    inside = lambda x, y: F.count(F.when(F.col("sale_date").between(x, y), 1))
    g = t.groupBy("sale_year").agg(inside(a, b).alias("signal_lines"), inside(p, q).alias("feature_lines"))
    return g.select("*", a.alias("signal_start"), b.alias("signal_end"), p.alias("feature_start"), q.alias("feature_end"))


@query("parse_campaign_window", """
SELECT CASE WHEN lab THEN make_date(CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) ELSE year(coalesce(od, idt)) END, 11, 3) END AS window_start, count(*) AS row_count FROM ex0 GROUP BY ALL""", "", "row_count")
def _(spark, d):
    e = exports(spark, d)
    sale = F.coalesce(tx.parse_date_multi(F.col("DATA COMANDA")), tx.parse_date_multi(F.col("DATA")))
    start, _ = cal.parse_campaign_window(tx.clean_text(F.col("CAMPANIE BF")), F.year(sale))
    return e.groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("row_count"))


@query("category_legacy", """
SELECT CASE WHEN l_partkey % 9 = 1 THEN 'MOBILIER OFFICE' WHEN l_partkey % 18 = 4 AND l_partkey % 4 <> 0 THEN 'MOBILIER DE CASA' ELSE 'NECUNOSCUT' END AS category,
 CASE WHEN l_partkey % 9 = 1 THEN 'category' WHEN l_partkey % 18 = 4 AND l_partkey % 4 <> 0 THEN 'class_part' ELSE 'unknown' END AS category_method, count(*) AS row_count FROM lineitem GROUP BY ALL""", "", "row_count")
def _(spark, d):
    e = exports(spark, d).select(F.col("CATEGORIE").alias("category_raw"), F.col("CLASA").alias("class_raw"))
    out = hi.category_legacy(e, {"TOTAL OFFICE": "MOBILIER OFFICE", "MESE SI SCAUNE": "MOBILIER DE CASA"})
    return out.groupBy("category", "category_method").agg(F.count(F.lit(1)).alias("row_count"))


@query("hierarchy_profile", """
WITH p AS (SELECT * FROM exx) SELECT 'category' AS kind, category_norm AS value, category_signal_status AS status, count(*) AS row_count, count(DISTINCT sku_id) AS skus FROM p GROUP BY ALL
UNION ALL SELECT 'store_unknown', store_id, 'unknown', count(*) FILTER (category_norm = 'NECUNOSCUT'), count(DISTINCT CASE WHEN category_norm = 'NECUNOSCUT' THEN sku_id END) FROM p GROUP BY store_id
UNION ALL SELECT 'campaign_signal', bf_signal_source, bf_signal_status, count(*), count(DISTINCT sku_id) FROM p GROUP BY ALL""", "", "row_count skus")
def _(spark, d):
    """Every line is cleaned once and stands for one row of each kind; the products of a value are counted from its distinct ones."""
    bad = F.col("category_norm") == hi.UNKNOWN
    row = lambda kind, value, status, counted: F.struct(
        F.lit(kind).alias("kind"), F.col(value).alias("value"), status.alias("status"), F.when(counted, F.col("sku_id")).alias("sku_id"), counted.cast("int").alias("n"))
    long = clean(spark, d).select(F.inline(F.array(
        row("category", "category_norm", F.col("category_signal_status"), F.lit(True)),
        row("store_unknown", "store_id", F.lit("unknown"), bad),
        row("campaign_signal", "bf_signal_source", F.col("bf_signal_status"), F.lit(True)))))
    per = long.groupBy("kind", "value", "status", "sku_id").agg(F.sum("n").alias("n"))
    return per.groupBy("kind", "value", "status").agg(F.sum("n").alias("row_count"), F.count("sku_id").alias("skus"))


@query("drop_superseded_sources", "SELECT source_file, count(*) AS row_count FROM exx WHERE source_file LIKE '%_full.csv' OR source_file IN ('store_7_old.csv', 'store_8_old.csv') GROUP BY ALL", "", "row_count")
def _(spark, d):
    sup = fx.table(spark, d, "nation").where("n_nationkey NOT IN (7, 8)").selectExpr(
        "concat('store_', n_nationkey, '_full.csv') AS preferred_file", "concat('store_', n_nationkey, '_old.csv') AS legacy_file")
    return cl.drop_superseded_sources(clean(spark, d), sup).groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))


_DUP = ["l_orderkey", "l_linenumber"]
_ORD = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("dedup_transactions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, line_value FROM txn_sparse
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""", "quantity line_value", "l_linenumber")
def _(spark, d):
    t = fx.txn(spark, d, parts=False, stores=False).select(*_DUP, *_ORD, "quantity", "line_value")
    return cl.dedup_transactions(t, _DUP, _ORD).drop("l_quantity", "l_extendedprice")


@query("source_ledger", """
WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS k, 'store_' || c_nationkey || CASE WHEN l_linenumber <= 5 THEN '_full.csv' ELSE '_old.csv' END AS source_file, coalesce(od, idt) AS sd, od IS NULL AS fb,
  l_partkey % 89 = 0 AS ns, coalesce(od, idt) IS NOT NULL AND l_partkey % 89 <> 0 AS ok FROM ex0),
 k AS (SELECT source_file, count(*) AS n FROM (SELECT k, min(source_file) AS source_file FROM r WHERE ok GROUP BY k) GROUP BY source_file)
SELECT r.source_file, count(*) AS rows_seen, max(coalesce(n, 0)) AS rows_inserted, count(*) FILTER (ok) - max(coalesce(n, 0)) AS rows_duplicate, count(*) FILTER (NOT ok) AS rows_filtered,
 count(*) FILTER (fb) AS date_fallback_rows, count(*) FILTER (sd IS NULL) AS missing_date, count(*) FILTER (ns) AS missing_sku, 0 AS missing_store,
 min(sd) FILTER (ok) AS min_sale_date, max(sd) FILTER (ok) AS max_sale_date FROM r LEFT JOIN k USING (source_file) GROUP BY r.source_file""", "",
       "rows_seen rows_inserted rows_duplicate rows_filtered date_fallback_rows missing_date missing_sku missing_store")
def _(spark, d):
    e = exports(spark, d)
    r = cl.sale_dates(e.select(
        "source_file", tx.null_if_empty(F.col("COD ARTICOL")).alias("sku_id"), tx.null_if_empty(F.col("MAGAZIN")).alias("store_id"), F.col("ID FACTURA").alias("transaction_key"),
        tx.parse_date_multi(F.col("DATA COMANDA")).alias("order_date"), tx.parse_date_multi(F.col("DATA")).alias("invoice_date")))
    return fs.source_ledger(r)


@query("incremental_txn_append", """
WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 5), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r
 FROM lineitem WHERE l_linenumber >= 4)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM b WHERE r = 1 AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM a)""", "l_quantity", "l_linenumber")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("transaction_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    new = li.where("l_linenumber >= 4").select("transaction_key", "l_orderkey", "l_linenumber", *_ORD)
    old = li.where("l_linenumber <= 5").select("transaction_key").distinct()
    return sn.new_transactions(new, old, order=_ORD).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("ingest_pos_lines", """
SELECT sku_id, store_id, sale_date, sum(greatest(quantity, 0)) AS units_sold, sum(greatest(-quantity, 0)) AS units_returned, sum(abs(line_value)) AS value, count(*) AS line_count FROM txn_sparse
WHERE is_non_product = 0 AND NOT (line_value = 0 AND quantity >= 0) AND l_partkey % 2 = 0 GROUP BY ALL""", "units_sold units_returned value", "line_count")
def _(spark, d):
    t = fx.txn(spark, d, parts=False).select("sku_id", "store_id", "sale_date", "quantity", "line_value", F.col("is_non_product").alias("is_service"),
                                             F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supplier_id"))
    skus = fx.table(spark, d, "part").where("p_partkey % 2 = 0").selectExpr("concat('P', p_partkey) AS sku_id")
    return cl.pos_lines(t, skus).groupBy("sku_id", "store_id", "sale_date").agg(
        F.sum("units_sold").alias("units_sold"), F.sum("units_returned").alias("units_returned"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("line_count"))


# ---- tiers ---------------------------------------------------------------------------
def tiers(spark, d):
    def build():
        t = fx.products(fx.txn(spark, d, stores=False)).where(F.col("week_start") <= F.lit("2001-07-23").cast("date"))
        w = t.groupBy("sku_id", "week_start").agg(F.sum("net_revenue").alias("r"), F.max("category_norm").alias("c"))
        g = w.groupBy("sku_id").agg(F.max("c").alias("category"), F.sum("r").alias("revenue"), F.count(F.lit(1)).alias("weeks_with_rows"))
        weeks = g.select("sku_id", "weeks_with_rows", w.select("week_start").distinct().agg(F.count(F.lit(1))).scalar().alias("weeks_in_data"))
        return lab.abc_tiers(g.select("sku_id", "category", "revenue"), weeks)
    return fx.shared(spark, d, "tiers", build)


BLOCKS["abc0"] = """
SELECT sku_id, max(category_norm) AS category, sum(net_revenue) AS revenue, count(DISTINCT week_start) AS w FROM txn_mixed WHERE is_non_product = 0 AND week_start <= DATE '2001-07-23' GROUP BY sku_id"""
BLOCKS["abc1"] = """
SELECT *, sum(revenue) OVER (ORDER BY revenue DESC, sku_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(revenue) OVER () AS cs, revenue / sum(revenue) OVER () AS sh,
 1 - w / (SELECT count(DISTINCT week_start) FROM txn_mixed WHERE is_non_product = 0 AND week_start <= DATE '2001-07-23') AS zw FROM abc0"""
BLOCKS["abc"] = """
SELECT sku_id, category, revenue, sh AS revenue_share, cs AS cumulative_share, CASE WHEN cs <= 0.8 THEN 'A' WHEN cs <= 0.95 THEN 'B' ELSE 'C' END AS tier, zw AS zero_week_share,
 CASE WHEN zw > 0.8 THEN 'LUMPY' ELSE 'SMOOTH' END AS demand_pattern FROM abc1"""


@query("abc_tiers", "SELECT * FROM abc", "revenue revenue_share cumulative_share zero_week_share")
def _(spark, d):
    return tiers(spark, d)


@query("abc_summary", """
WITH s AS (SELECT *, unnest(CASE WHEN tier = 'A' THEN ['ALL', category] ELSE ['ALL'] END) AS scope FROM abc)
SELECT tier, scope, count(*) AS skus, sum(revenue) AS total_revenue, count(*) FILTER (demand_pattern = 'SMOOTH') AS smooth_skus, count(*) FILTER (demand_pattern = 'LUMPY') AS lumpy_skus FROM s GROUP BY ALL""",
       "total_revenue", "skus smooth_skus lumpy_skus")
def _(spark, d):
    return lab.abc_summary(tiers(spark, d))


BLOCKS["atier"] = "SELECT sku_id FROM abc WHERE tier = 'A'"


def a_weekly(spark, d):
    return weekly(spark, d).join(tiers(spark, d).where("tier = 'A'").select("sku_id"), "sku_id", "left_semi")


@query("tier_filter", "SELECT * FROM ser WHERE sku_id IN (SELECT sku_id FROM atier)", "units")
def _(spark, d):
    return a_weekly(spark, d)


@query("integrity_checks", """
SELECT (SELECT count(*) FROM txn_mixed) AS source_lines, (SELECT sum(num_transactions) FROM store_week_mixed) AS target_lines, (SELECT count(DISTINCT sku_id) FROM txn_mixed) AS source_skus,
 (SELECT count(DISTINCT sku_id) FROM store_week_mixed) AS target_skus, 0 AS phantom_skus, (SELECT count(DISTINCT sku_id) FROM txn_mixed WHERE sku_id NOT IN (SELECT sku_id FROM store_week_mixed)) AS lost_skus,
 (SELECT count(DISTINCT sku_id) FROM store_week_mixed WHERE sku_id NOT IN (SELECT sku_id FROM abc)) AS untiered_skus""", "", "source_lines target_lines source_skus target_skus phantom_skus lost_skus untiered_skus")
def _(spark, d):
    t = fx.txn(spark, d)
    return wk.integrity_checks(t, wk.weekly_store_demand(t), tiers(spark, d))


_WIN = "week_start >= DATE '2001-01-01' AND week_start < DATE '2001-05-28'"


@query("actuals_first_n_rows", f"""
WITH r AS (SELECT sku_id, units, row_number() OVER (PARTITION BY sku_id ORDER BY week_start) AS r FROM ser WHERE {_WIN})
SELECT sku_id, sum(units) FILTER (r <= 4) AS actual_first_4, sum(units) FILTER (r <= 8) AS actual_first_8 FROM r GROUP BY sku_id""", "actual_first_4 actual_first_8")
def _(spark, d):
    w = weekly(spark, d).where(_WIN)
    return au.actuals_first_rows(w, ["sku_id"], "units", 4).join(au.actuals_first_rows(w, ["sku_id"], "units", 8), "sku_id")


@query("naive_same_month", """
WITH p AS (SELECT sku_id, sum(units) FILTER (week_start >= DATE '2001-01-01' AND week_start < DATE '2001-01-29') AS a, sum(units) FILTER (week_start >= DATE '2000-01-03' AND week_start < DATE '2000-01-31') AS b FROM ser
 WHERE sku_id IN (SELECT sku_id FROM atier) GROUP BY sku_id)
SELECT 'same_period_last_year' AS method, count(*) AS n, sum(abs(b - a)) / sum(a) AS wmape, avg((abs(b - a) / a <= 0.2)::DOUBLE) AS hit20, avg((abs(b - a) / a <= 0.3)::DOUBLE) AS hit30, avg((b - a) / a) AS bias,
 avg(abs(b - a)) AS mae, quantile_cont(abs((b - a) / a), 0.5) AS median_ape FROM p WHERE a > 0 AND b IS NOT NULL""", "wmape hit20 hit30 bias mae median_ape", "n")
def _(spark, d):
    s = lambda lo, hi: F.sum(F.when((F.col("week_start") >= F.lit(lo)) & (F.col("week_start") < F.lit(hi)), F.col("units")))
    p = a_weekly(spark, d).groupBy("sku_id").agg(s("2001-01-01", "2001-01-29").alias("actual_units"), s("2000-01-03", "2000-01-31").alias("pred_units"))
    return au.score_one_window(p.where("pred_units IS NOT NULL").withColumn("method", F.lit("same_period_last_year")), ["method"])


@query("revenue_bucket", "SELECT revenue_bucket, is_top_80_revenue, count(*) AS skus, min(revenue_rank) AS first_rank FROM labels_x GROUP BY ALL", "", "is_top_80_revenue skus first_rank")
def _(spark, d):
    from stocktide.plans.q_core import labels_of
    t = labels_of(spark, d).withColumn("revenue_bucket", nu.revenue_bucket(F.col("revenue_rank"), F.col("is_top_80_revenue")))
    return t.groupBy("revenue_bucket", "is_top_80_revenue").agg(F.count(F.lit(1)).alias("skus"), F.min("revenue_rank").alias("first_rank"))


@query("volume_bucket", "SELECT volume_bucket, count(*) AS skus, sum(trailing_52w_pos_units) AS units FROM labels_x GROUP BY ALL", "units", "skus")
def _(spark, d):
    from stocktide.plans.q_core import labels_of
    t = labels_of(spark, d).withColumn("volume_bucket", nu.volume_bucket(F.col("trailing_52w_pos_units")))
    return t.groupBy("volume_bucket").agg(F.count(F.lit(1)).alias("skus"), F.sum("trailing_52w_pos_units").alias("units"))


# ---- promotions ------------------------------------------------------------------------
def discount_rows(spark, d):
    """All lines written as accounting lines: those of at least 9 % discount have a discount code, the others their product's."""
    t = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    t = t.withColumn("s", F.expr("date_add(DATE '1999-06-01', CAST(l_suppkey * 13 % 700 AS INT))")).withColumn("e", F.expr("date_add(s, CAST(10 + l_suppkey % 20 AS INT))"))
    return t.select(
        "l_orderkey", "l_linenumber", *_ORD,
        F.expr("CASE WHEN l_discount < 0.09 OR l_discount IS NULL THEN concat('P', l_partkey) ELSE CASE l_suppkey % 10 WHEN 8 THEN 'DISCOUNT' WHEN 9 THEN 'VOUCHERVANZARE' ELSE concat('DISCOUNT', l_suppkey) END END").alias("item_code"),
        F.expr("""CASE WHEN l_suppkey % 10 = 8 AND l_linenumber % 2 = 0 THEN 'Fidelizare client' WHEN month(s) = month(e) AND year(s) = year(e)
          THEN concat('Campanie ', lower(p_type), ' ', 5 + l_suppkey % 30, ' %, ', day(s), '-', date_format(e, 'dd.MM.yyyy'))
          ELSE concat('Campanie ', lower(p_type), ' ', 5 + l_suppkey % 30, '%, ', date_format(s, 'dd.MM'), ' - ', date_format(e, 'dd.MM.yyyy')) END""").alias("description"))


WORDS = tuple((w.lower(), w, c) for w, c in (("ECONOMY", 1.0), ("STANDARD", 0.8), ("PROMO", 0.7), ("SMALL", 1.0), ("MEDIUM", 0.9), ("LARGE", 1.0)))
BLOCKS["dl0"] = """
SELECT *, DATE '1999-06-01' + CAST(l_suppkey * 13 % 700 AS INTEGER) AS s, DATE '1999-06-01' + CAST(l_suppkey * 13 % 700 + 10 + l_suppkey % 20 AS INTEGER) AS e, l_suppkey % 10 = 8 AND l_linenumber % 2 = 0 AS loy
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.09"""
_CONF = "CASE p_type " + " ".join(f"WHEN '{w}' THEN {c}" for _, w, c in WORDS) + " ELSE 0 END"
BLOCKS["dl"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE l_suppkey % 10 WHEN 8 THEN 'DISCOUNT' WHEN 9 THEN 'VOUCHERVANZARE' ELSE 'DISCOUNT' || l_suppkey END AS item_code,
 CASE WHEN NOT loy THEN s END AS start_date, CASE WHEN NOT loy THEN e END AS end_date, CASE WHEN NOT loy THEN (5 + l_suppkey % 30)::DOUBLE END AS discount_percent,
 CASE WHEN NOT loy THEN p_type ELSE '' END AS category, CASE WHEN NOT loy THEN {_CONF} ELSE 0 END::DOUBLE AS confidence,
 CASE l_suppkey % 10 WHEN 8 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'loyalty' ELSE 'discount_other' END WHEN 9 THEN 'voucher' ELSE 'campaign' END AS line_type FROM dl0"""


@query("promo_text_fields", "SELECT line_type, start_date, end_date, discount_percent, category, confidence, count(*) AS row_count FROM dl GROUP BY ALL", "discount_percent confidence", "row_count")
def _(spark, d):
    f = pr.promo_text_fields(pr.discount_lines(discount_rows(spark, d)), words=WORDS)
    return f.groupBy("line_type", "start_date", "end_date", "discount_percent", "category", "confidence").agg(F.count(F.lit(1)).alias("row_count"))


def calendar(spark, d):
    f = pr.promo_text_fields(pr.discount_lines(discount_rows(spark, d)), words=WORDS)
    return pr.promo_calendar(f, ["l_orderkey", "l_linenumber", *_ORD])


BLOCKS["pcal"] = """
SELECT item_code AS campaign_id, start_date, end_date, discount_percent, lower(category) AS category_hint, category, confidence FROM dl WHERE line_type = 'campaign'
QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1"""


@query("promo_calendar", "SELECT * FROM pcal", "discount_percent confidence")
def _(spark, d):
    return calendar(spark, d)


BLOCKS["aser"] = "SELECT * FROM ser WHERE sku_id IN (SELECT sku_id FROM atier)"
BLOCKS["spw"] = """
SELECT a.sku_id, a.week_start, a.category, (max(coalesce(confidence, 0)) > 0)::INT AS promo_flag, 1 AS loyalty_flag, max(coalesce(confidence, 0)) AS confidence
FROM aser a LEFT JOIN pcal p ON p.category = a.category AND a.week_start <= end_date AND a.week_start + 6 >= start_date GROUP BY a.sku_id, a.week_start, a.category"""


@query("sku_promo_weeks", "SELECT * FROM spw", "confidence")
def _(spark, d):
    return pr.sku_promo_weeks(a_weekly(spark, d), calendar(spark, d))


def ratios(spark, d):
    w = fx.shared(spark, d, "a_weekly", lambda: a_weekly(spark, d))
    return pr.yearly_ratios(w, pr.sku_promo_weeks(w, calendar(spark, d)))


BLOCKS["plr"] = """
SELECT n.category, promo_flag, n.units / p.units AS ratio FROM aser n JOIN aser p ON p.sku_id = n.sku_id AND p.week_start = n.week_start - 364 JOIN spw s ON s.sku_id = n.sku_id AND s.week_start = n.week_start WHERE p.units <> 0"""
_LIFT = """SELECT category, count(*) FILTER (promo_flag = 1) AS promo_events, count(*) FILTER (promo_flag = 0) AS non_promo_events,
 CASE WHEN count(*) FILTER (promo_flag = 1) >= 30 AND avg(ratio) FILTER (promo_flag = 0) > 0 THEN avg(ratio) FILTER (promo_flag = 1) / avg(ratio) FILTER (promo_flag = 0) END AS lift FROM plr GROUP BY category"""


@query("promo_lift", _LIFT,
       "lift", "promo_events non_promo_events")
def _(spark, d):
    return pr.promo_lift(ratios(spark, d))


_DRAW = "CASE mean " + " ".join(f"WHEN {m} THEN len(list_filter([{', '.join(repr(x) for x in pr.poisson_limits(m))}], lambda x: x <= u))" for m in pr.DRAWS) + " END"


@query("promo_lift_ci", f"""
WITH eq AS (SELECT category, promo_flag, CAST(round(ratio * 1000000000) AS BIGINT) AS r, count(*) AS n FROM plr GROUP BY ALL),
 cp AS (SELECT category, promo_flag, r, list_concat([16 FOR i IN range(n // 16)], [m FOR m IN [8, 4, 2, 1] IF (n // m) % 2 = 1]) AS means FROM eq),
 pt AS (SELECT category, promo_flag, r, unnest(means) AS mean, unnest(range(len(means))) AS copy FROM cp),
 un AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', '42', category, promo_flag, r, copy, b)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u FROM pt, (SELECT unnest(range(1, 1001)) AS b) bs),
 dr AS (SELECT category, promo_flag, b, r / 1000000000::DOUBLE AS ratio, {_DRAW} AS w FROM un),
 sm AS (SELECT category, b, sum(w * ratio) FILTER (promo_flag = 1) / sum(w) FILTER (promo_flag = 1 AND w > 0) AS p,
  sum(w * ratio) FILTER (promo_flag = 0) / sum(w) FILTER (promo_flag = 0 AND w > 0) AS q FROM dr GROUP BY ALL),
 ci AS (SELECT category, quantile_cont(p / q, 0.025) AS lo, quantile_cont(p / q, 0.975) AS hi FROM sm WHERE q > 0 AND p IS NOT NULL GROUP BY category)
SELECT l.*, CASE WHEN lift IS NOT NULL THEN lo END AS ci_low, CASE WHEN lift IS NOT NULL THEN hi END AS ci_high FROM ({_LIFT}) l LEFT JOIN ci ON ci.category = l.category""",
       "lift ci_low ci_high", "promo_events non_promo_events")
def _(spark, d):
    return pr.promo_lift_ci(ratios(spark, d))


@query("campaign_value_profile", """
SELECT coalesce(campaign_raw, '(blank)') AS value, count(*) AS row_count, sum(net_units) AS net_units, sum(net_revenue) AS net_revenue, min(sale_date) AS first_date, max(sale_date) AS last_date
FROM txn_sparse WHERE is_non_product = 0 GROUP BY ALL ORDER BY row_count DESC, value LIMIT 20""", "net_units net_revenue", "row_count")
def _(spark, d):
    return pr.campaign_values(fx.products(fx.txn(spark, d, parts=False, stores=False)), "campaign_raw")
