import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from stocktide.functions import calendar as cal
from stocktide.functions import numbers as nu
from stocktide.functions import text as tx


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("﻿ \"x y\" ", "x y"), ("#NULL", None), ("  ", None), (None, None), ('""', None), ("a#null", "a#null")])
def test_null_if_empty(spark, raw, want):
    assert one(spark, raw, tx.null_if_empty) == want


@pytest.mark.parametrize("raw,want", [("1,5", 1.5), ("-0,2", -0.2), ("#null", None), ("abc", None), ("", None), ("7", 7.0)])
def test_parse_decimal(spark, raw, want):
    assert one(spark, raw, tx.parse_decimal_comma) == want


@pytest.mark.parametrize("raw,want", [(-0.2, 0.2), (3.0, None), (float("inf"), None), (float("nan"), None), (1.0, 1.0), (None, None)])
def test_discount_fraction(spark, raw, want):
    assert one(spark, raw, tx.discount_fraction, "double") == want


@pytest.mark.parametrize("raw,want", [("05.03.2024", dt.date(2024, 3, 5)), ("2024-03-05", dt.date(2024, 3, 5)), ("31.02.2024", None), ("x", None), ("5.3.2024", dt.date(2024, 3, 5))])
def test_parse_date(spark, raw, want):
    assert one(spark, raw, tx.parse_date_multi) == want


def test_parse_date_order_of_formats(spark):
    f = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy")
    assert one(spark, "03/04/2024", lambda c: tx.parse_date_multi(c, f)) == dt.date(2024, 4, 3)
    assert one(spark, "03/14/2024", lambda c: tx.parse_date_multi(c, f)) == dt.date(2024, 3, 14)


@pytest.mark.parametrize("raw,want", [("da", 1), (" YES", 1), ("nu", 0), ("0", 0), ("maybe", None), ("", None)])
def test_yes_no(spark, raw, want):
    assert one(spark, raw, tx.yes_no_flag) == want


@pytest.mark.parametrize("raw,want", [("Pat 160x200", "160x200"), ("Corp 43,5 x 48,5X56.5cm", "43.5x48.5X56.5"), ("A 1x2 B 3x4x5", "1x2|3x4x5"), ("none", None)])
def test_dimensions(spark, raw, want):
    assert one(spark, raw, tx.extract_dimensions) == want


def test_accent_table_is_complete(spark):
    assert len(tx.ACCENTED) == len(tx.UNACCENTED)
    for a, b in zip(tx.ACCENTED, tx.UNACCENTED):
        assert "".join(c for c in unicodedata.normalize("NFKD", a) if not unicodedata.combining(c)) == b
    assert one(spark, "  Şezlong  ţesătură ĭn ", tx.strip_accents) == "SEZLONG TESATURA IN"


def test_month_label(spark):
    assert one(spark, "NOIEMBRIE 2024/STOC", tx.month_label_to_date) == dt.date(2024, 11, 1)
    assert one(spark, "Brumar 2024", tx.month_label_to_date) is None


@pytest.mark.parametrize("name,code,want", [("Servicii montaj", "X", 1), ("Scaun", "discount012", 1), ("Scaun", "LMPM", 1), ("Scaun", "A1", 0)])
def test_non_product(spark, name, code, want):
    df = spark.createDataFrame([(name, code)], "n string, c string")
    e = F.lit(None).cast("string")
    assert df.select(tx.non_product_flag(e, e, e, F.col("n"), F.col("c"))).first()[0] == want


@pytest.mark.parametrize("year,want", [(2000, dt.date(2000, 4, 30)), (2023, dt.date(2023, 4, 16)), (2024, dt.date(2024, 5, 5)), (2025, dt.date(2025, 4, 20))])
def test_easter(spark, year, want):
    assert one(spark, year, cal.orthodox_easter, "int") == want


def test_bf_windows(spark):
    r = spark.createDataFrame([(2024,), (2001,)], "y int").select(
        *[c for p in (cal.bf_window_signal(F.col("y")), cal.bf_window_feature(F.col("y"))) for c in p]).collect()
    assert [str(x) for x in r[0]] == ["2024-11-04", "2024-11-24", "2024-11-04", "2024-11-24"]
    assert [str(x) for x in r[1]] == ["2001-11-26", "2001-12-02", "2001-11-03", "2001-11-23"]


@pytest.mark.parametrize("text,year,want", [
    ("BF 2025 [03-23 NOIEMBRIE]", 2024, (dt.date(2025, 11, 3), dt.date(2025, 11, 23))),
    ("BF [3 - 9 Noiembrie x]", 2024, (dt.date(2024, 11, 3), dt.date(2024, 11, 9))),
    ("BF [31-40 NOIEMBRIE]", 2024, (None, None)), ("BF", 2024, (None, None))])
def test_campaign_window(spark, text, year, want):
    a, b = cal.parse_campaign_window(F.col("t"), F.col("y"))
    assert tuple(spark.createDataFrame([(text, year)], "t string, y int").select(a, b).first()) == want


def test_legacy_week_moves_monday(spark):
    assert one(spark, dt.date(2024, 3, 4), cal.week_start, "date") == dt.date(2024, 3, 4)
    assert one(spark, dt.date(2024, 3, 4), cal.week_start_shifted, "date") == dt.date(2024, 2, 26)
    assert one(spark, dt.date(2024, 3, 5), cal.week_start_shifted, "date") == dt.date(2024, 3, 4)


def test_calendar_day_strongest_event(spark):
    days = spark.createDataFrame([(dt.date(2024, 12, 1),), (dt.date(2024, 12, 30),), (dt.date(2024, 7, 10),)], "date date")
    r = {x["date"]: x for x in cal.calendar_days(days).collect()}
    assert r[dt.date(2024, 12, 1)]["event_multiplier"] == 1.35
    assert r[dt.date(2024, 12, 30)]["event_multiplier"] == 1.60
    assert r[dt.date(2024, 7, 10)]["combined_multiplier"] == round(1.15 * 0.8 * 1.1, 4)


def test_median3_and_row_median(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0), (5.0, 5.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(nu.median3(*map(F.col, "abc"))).collect()] == [2.0, 5.0]
    assert df.select(nu.row_median(F.col("a"), F.lit(None).cast("double"), F.col("b"))).first()[0] == 2.0
