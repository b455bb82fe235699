"""Cleaning rules read every value once, and give what their plain patterns give."""

from pyspark.sql import functions as F

from stocktide.functions import text as tx
from stocktide.operators import clean as cl

ODD = [None, "", " ", '"', ' "a" ', "a", "a b", '\ufeff"x', "x\ufeff", "\ta\n", "a \n", "a \x85", "a\u2028", 'a"\u2029', "a \r\n", "#null", "#NULL ", "#nulls", "#null\x85",
       '"#Null"', "\x0b1,5", "é ", "\u00a0a", '""a""b""']


def test_clean_text_and_null_if_empty_equal_their_plain_patterns(spark):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(ODD)], "i int, v string")
    plain = F.regexp_replace(F.replace(F.coalesce("v", F.lit("")), F.lit("\ufeff"), F.lit("")), r'^\s*"*\s*|\s*"*\s*$', "")
    null = F.nullif(F.regexp_replace(plain, "(?i)^#null$", ""), F.lit(""))
    rows = t.select("v", tx.clean_text(F.col("v")).alias("a"), plain.alias("b"), tx.null_if_empty(F.col("v")).alias("c"), null.alias("d")).collect()
    assert [(r["v"], r["a"], r["c"]) for r in rows] == [(r["v"], r["b"], r["d"]) for r in rows]


def test_a_cleaned_date_is_one_reading_of_its_text(spark):
    """Before, rules within rules held 24 copies of the text of one date, and a filter as many again."""
    raw = spark.createDataFrame([("1.2.2000", "P1", "s")], "`DATA COMANDA` string, `COD ARTICOL` string, MAGAZIN string")
    stores = spark.createDataFrame([("S", "N1", "hybrid")], "store_name string, store_id string, store_type string")
    out = cl.normalize_sales(raw.withColumn("DATA COMANDA", F.concat(F.col("DATA COMANDA"), F.lit("marked"))), stores).select("sale_date", "sku_id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("marked") <= 2  # in the projection and in the filter


def test_hierarchy_profile_reads_the_lines_twice(spark):
    """Once for the distinct raw tuples, once for all three kinds; before, once for each kind."""
    from stocktide.plans.registry import QUERIES

    out = QUERIES["hierarchy_profile"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("l_extendedprice") == 1
    kinds = {r["kind"]: r["n"] for r in out.where("kind <> 'store_unknown'").groupBy("kind").agg(F.sum("row_count").alias("n")).collect()}
    assert len(kinds) == 2 and len(set(kinds.values())) == 1
