"""Tables that scores read are Parquet: compressed, and read by column."""

from pyspark.sql import functions as F

from stocktide.plans import fixtures as fx
from stocktide.session import staged


def test_a_staged_table_is_read_by_column(spark):
    fx.forget_shared()
    rows = spark.range(1000).select("id", F.lit("a long text that repeats " * 8).alias("text"), F.array("id").alias("a"), F.lit(None).cast("date").alias("d"))
    t = fx.shared(spark, "/none", "staged_test", lambda: rows, staged)
    assert t.schema.names == rows.schema.names and sorted(t.collect()) == sorted(rows.collect())
    assert fx.shared(spark, "/none", "staged_test", lambda: None) is t
    plan = t.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "text" not in plan.split("ReadSchema")[1]
    fx.forget_shared()
