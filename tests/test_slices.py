"""Stored transactions by slices: what a batch reads, repeated batches, months that are missing."""

import datetime as dt

from pyspark.sql import functions as F

from stocktide.sources import sinks as sn


def batch(spark, month, start, n):
    rows = [(f"k{month}-{start + i}", dt.date(2000 + month // 12, month % 12 + 1, 1 + (start + i) % 28), float(start + i)) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_key string, sale_date date, quantity double")


def files_read(spark, path, rows):
    old = sn.touched_slices(sn.with_slices(rows, "transaction_key", "sale_date", sn.BUCKETS), spark.read.parquet(path))
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "key_span" in plan.split("PartitionFilters: [")[1] and "Filter (" not in plan  # slices are pruned before files are opened
    return old.select(F.input_file_name().alias("f")).distinct().count()


def test_files_read_by_a_batch_do_not_grow_with_history(spark, tmp_path):
    path, read = str(tmp_path / "t"), []
    for month in range(6):
        sn.append_transactions(batch(spark, month, 0, 40), path, f"a{month}", span="sale_date")
        late = batch(spark, month, 20, 40)
        read.append(files_read(spark, path, late))
        sn.append_transactions(late, path, f"b{month}", span="sale_date")
    assert max(read) <= sn.BUCKETS and max(read) == max(read[:2])
    t = spark.read.parquet(path)
    assert t.count() == 6 * 60 and t.select("transaction_key").distinct().count() == 6 * 60


def test_repeated_batches_and_missing_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), ("b", dt.date(2001, 3, 4), 3.0)], "transaction_key string, sale_date date, quantity double")
    for _ in range(2):
        sn.append_transactions(rows, path, 1, order=["quantity"], span="sale_date")
    sn.append_transactions(rows, path, 2, order=["quantity"], span="sale_date")
    assert sorted((r.transaction_key, r.quantity) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 3.0)]


def test_without_a_span_buckets_are_the_slices(spark, tmp_path):
    path = str(tmp_path / "t")
    sn.append_transactions(batch(spark, 0, 0, 100), path, 1)
    one = batch(spark, 0, 5, 1)
    old = sn.touched_slices(sn.with_slices(one, "transaction_key", None, sn.BUCKETS), spark.read.parquet(path))
    assert old.select(F.input_file_name()).distinct().count() == 1
    sn.append_transactions(batch(spark, 0, 50, 100), path, 2)
    assert spark.read.parquet(path).count() == 150
