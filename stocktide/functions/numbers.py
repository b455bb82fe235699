"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is zero."""
    return F.when(F.abs(den) > 1e-9, num / den).otherwise(F.lit(0.0))


def div(num: Column, den: Column) -> Column:
    """num / den, NULL unless the denominator is positive."""
    return F.when(den > 0, num / den)


def positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def row_median(*cols: Column) -> Column:
    """Median of the non-NULL values of one row."""
    a = F.sort_array(F.filter(F.array(*cols), lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(a)
    lo = F.get(a, ((n - 1) / 2).cast("int"))
    hi = F.get(a, (n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def clean_numeric(c: Column, default: float = 0.0) -> Column:
    """Non-finite or missing -> default."""
    d = c.cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.when(ok, d).otherwise(F.lit(default))


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def revenue_bucket(rank: Column, top80: Column) -> Column:
    return (
        F.when(rank.isNull(), "no_revenue")
        .when(rank <= 100, "top_100")
        .when(rank <= 500, "101_500")
        .when(rank <= 1000, "501_1000")
        .when(rank <= 5000, "1001_5000")
        .when(top80 == 1, "rest_to_80pct")
        .otherwise("outside_80pct")
    )


def volume_bucket(units: Column) -> Column:
    return (
        F.when(units <= 0, "zero_52w")
        .when(units < 4, "1_3_units_52w")
        .when(units < 13, "4_12_units_52w")
        .when(units < 52, "13_51_units_52w")
        .when(units < 156, "52_155_units_52w")
        .otherwise("156_plus_units_52w")
    )
