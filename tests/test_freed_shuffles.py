"""Shared tables are compressed files, and the shuffles that made them end with them."""

import pytest
from pyspark.sql import functions as F

from stocktide import session as se
from stocktide.plans import fixtures as fx


@pytest.mark.parametrize("write", [se.staged, se.cut_lineage])
def test_shuffle_files_are_removed_once_a_table_is_written(spark, write):
    """Before, they stayed on disk until the driver's garbage collector came by."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before, setting = files(), spark.conf.get(se.FREED, None)
    t = write(spark.range(5000).groupBy((F.col("id") % 999).alias("k")).agg(F.sum("id").alias("s")))
    assert t.count() == 999 and spark.conf.get(se.FREED, None) == setting
    again = files()
    assert t.agg(F.sum("s")).first()[0] == sum(range(5000))
    assert again <= before + 4  # the count's own


def test_a_setting_is_restored_after_a_failure(spark):
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        se.staged(bad)
    assert spark.conf.get(se.FREED, "false") == "false"


def test_shared_tables_are_parquet(spark):
    fx.forget_shared()
    t = fx.shared(spark, "/none", "freed_test", lambda: spark.range(10))
    assert "parquet" in t._jdf.queryExecution().executedPlan().toString().lower() and t.count() == 10
    fx.forget_shared()
