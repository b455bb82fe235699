"""Ranks and running totals over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.session import cut_lineage


def global_running(df: DataFrame, order: list[Column], measure: str, parts: list[str] = ()) -> DataFrame:
    """Add ``row_rank``, ``running_total`` and ``grand_total`` per ``parts``.

    Rows are range-partitioned on (parts, order); each range is written once,
    so that the range numbers stay fixed on a retry. Totals per range (at most
    one row per shuffle partition and part) give the offset of every range,
    and the window then runs inside one range only. Ties of the measure are
    cut by the full sort key, so no value can overload a range.
    """
    parts = list(parts)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(p) for p in parts], *order)
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy(*parts, "_range").agg(F.sum(measure).alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    offsets = per.select(
        *parts, "_range",
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_s").over(whole).alias("grand_total"),
    )
    inner = Window.partitionBy(*parts, "_range").orderBy(*order)
    joined = ranged.join(F.broadcast(offsets), [*parts, "_range"])
    return joined.select(
        *df.columns,
        (F.col("_n0") + F.row_number().over(inner)).alias("row_rank"),
        (F.col("_s0") + F.sum(measure).over(inner.rowsBetween(Window.unboundedPreceding, 0))).alias("running_total"),
        "grand_total",
    )
