"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | None = None, app: str = "stocktide") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("STOCKTIDE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="stocktide-checkpoint-")
    sc.setCheckpointDir(path)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Plans made here remove their shuffle files as soon as they have run: what they wrote is read from then on."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    Used where one intermediate table feeds several branches (so the line
    scan is not repeated) or where partition numbers must stay fixed.
    """
    _checkpoint_dir(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read back.

    It cuts the lineage, survives lost executors and has file statistics. Unlike
    a checkpoint's rows its columns are compressed, and a reader takes only those
    it needs.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
