"""Idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def upsert_slice(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace exactly the slices (partitions) present in ``df``; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def new_transactions(new: DataFrame, existing: DataFrame | None, key: str = "transaction_key", order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key."""
    rest = [c for c in new.columns if c != key and c not in (order or [])]
    first = new.groupBy(key).agg(F.min(F.struct(*(order or []), *rest)).alias("_f")).select(key, "_f.*").select(*new.columns)
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


#: Buckets of the key's hash that a stored table of transactions is cut into.
BUCKETS = 8


def with_slices(rows: DataFrame, key: str, span: str | None, buckets: int) -> DataFrame:
    """Add the slice of each row: the bucket of its key and, if ``span`` names a date that belongs to the key, that date's month."""
    rows = rows.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    month = F.coalesce(F.date_format(span, "'m'yyyy_MM"), F.lit("m_none")) if span else F.lit("m_all")
    return rows.withColumn("key_span", month)


def touched_slices(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``existing`` in the slices that ``rows`` fall into; all other slices are pruned before a file is opened.

    Equal keys always share a slice, so nothing else can hold a key of ``rows``.
    The slices are collected: at most buckets x months of the batch.
    """
    by_span: dict[str, list[int]] = {}
    for r in rows.select("key_span", "key_bucket").distinct().collect():
        by_span.setdefault(r["key_span"], []).append(r["key_bucket"])
    met = F.lit(False)
    for span, buckets in sorted(by_span.items()):
        met = met | ((F.col("key_span") == span) & F.col("key_bucket").isin(sorted(buckets)))
    return existing.where(met)


def append_transactions(new: DataFrame, path: str, batch_id: int | str, key: str = "transaction_key", order: list[str] | None = None,
                        span: str | None = None, buckets: int = BUCKETS) -> None:
    """Append late or overlapping files without double counting.

    The table is stored by month of ``span`` (a date that equal keys have in
    common), bucket of the key and batch. A batch meets only the slices it falls
    into, so what it reads does not grow with the months before it. Each batch owns
    its partitions and rewrites only those, so a batch that is repeated after a
    failure gives the same table. ``buckets`` is fixed for the life of a table.
    """
    new = with_slices(new, key, span, buckets)
    old = stored(new.sparkSession, path)
    if old is not None:
        old = touched_slices(new, old.where(F.col("batch_id") != F.lit(str(batch_id))))
    slices = ["key_span", "key_bucket"]
    fresh = new_transactions(new, old, key, order).withColumn("batch_id", F.lit(f"{batch_id}"))
    upsert_slice(fresh.repartition(*slices), path, [*slices, "batch_id"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
