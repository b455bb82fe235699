"""Registry of queries: name -> (spark, sf_dir) -> DataFrame, with comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.plans.oracle import finish

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame, doubles: str, longs: str, digits: int = 4) -> DataFrame:
    d, n = set(doubles.split()), set(longs.split())
    missing = (d | n) - set(df.columns)
    if missing:
        raise ValueError(f"not in result: {sorted(missing)}")
    return df.select(*[
        F.round(F.col(c).cast("double") + 1e-9, digits).alias(c) if c in d
        else F.col(c).cast("long").alias(c) if c in n else F.col(c)
        for c in df.columns
    ])


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = "", digits: int = 4):
    """Register a query; ``sql`` None means a rows-only check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, d: tidy(fn(spark, d), doubles, longs, digits)
        if sql is not None:
            ORACLE[name] = finish(sql, doubles, longs, digits)
        return fn

    return add
