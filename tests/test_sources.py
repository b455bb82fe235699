import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide.operators.clean import dedup_transactions, normalize_sales
from stocktide.operators.stock import header_month, monthly_store_stock
from stocktide.sources import files as fs
from stocktide.sources import sinks as sn
from stocktide.streaming.append import append_stream

HEAD = "COD ARTICOL;DATA COMANDA;DATA;MAGAZIN;CANTITATE FACTURATA;VALOARE FACTURATA;Reducere %;DENUMIRE ARTICOL;ID FACTURA"


@pytest.fixture()
def sales(tmp_path):
    a, b = tmp_path / "shop_full.csv", tmp_path / "NORD_2024.csv"
    a.write_text("﻿" + HEAD + "\n" + "\n".join([
        'A1;01.03.2024;05.03.2024;"STORE ONE SRL";1,5;10,00;-0,2;Pat 160x200;F1', "", 'A2;;06.03.2024;STORE ONE SRL;-2;-20;3;Montaj;F2',
        'A1;01.03.2024;05.03.2024;STORE ONE SRL;1,5;10,00;-0,2;Pat 160x200;F1', '#null;01.03.2024;;STORE ONE SRL;1;1;;x;F3']) + "\n", encoding="utf-8")
    b.write_text("COD ARTICOL\tDATA\tCANTITATE FACTURATA\tVALOARE FACTURATA\nB1\t2024-03-07\t2\t5,5\nB2\tbad\t1\t1\n", encoding="utf-8")
    return [str(a), str(b)]


def stores(spark):
    return spark.createDataFrame([("Store One SRL", "one", "hyperstore")], "store_name string, store_id string, store_type string")


def test_scan_and_normalize(spark, sales):
    raw = fs.store_hint(fs.raw_row_archive(fs.scan_export(spark, sales)), {"NORD": "Nord & Co"})
    assert raw.count() == 6
    rows = normalize_sales(raw, stores(spark)).collect()
    assert len(rows) == 4
    a1 = [r for r in rows if r["sku_id"] == "A1"][0]
    assert (a1["store_id"], a1["quantity"], a1["discount_pct"], a1["product_dimensions_raw"], a1["invoice_lag_days"]) == ("one", 1.5, 0.2, "160x200", 4)
    assert '"DATA":"05.03.2024"' in a1["raw_row_json"]
    a2 = [r for r in rows if r["sku_id"] == "A2"][0]
    assert (a2["sale_date_source"], a2["is_return"], a2["is_non_product"], a2["discount_pct"], a2["returned_units"]) == ("invoice_date_fallback", 1, 1, None, 2.0)
    b1 = [r for r in rows if r["sku_id"] == "B1"][0]
    assert (b1["store_id"], b1["store_type"], b1["week_start"]) == ("nord_co", "unknown", dt.date(2024, 3, 4))


def test_duplicate_lines_and_ledger(spark, sales):
    rows = normalize_sales(fs.scan_export(spark, sales), stores(spark))
    one = dedup_transactions(rows, ["transaction_key"], ["source_file", "source_block", "source_row_number"])
    assert rows.count() - one.count() == 1
    led = {r["source_file"]: r for r in fs.source_ledger(rows).collect()}
    assert (led["shop_full.csv"]["rows_seen"], led["shop_full.csv"]["rows_duplicate"]) == (3, 1)


def test_monthly_stock(spark):
    assert header_month("MAI 2024/STOC") == dt.date(2024, 5, 1) and header_month("MAI/STOC") is None
    df = spark.createDataFrame([("a", "s", "1,5", ""), ("a", "s", "2", "4")], ["sku_id", "store_id", "MAI 2024/STOC", "IUNIE 2024/STOC"])
    got = {(r["stock_month"], r["stock_qty"], r["source_row_count"]) for r in monthly_store_stock(df, ["sku_id", "store_id"]).collect()}
    assert got == {(dt.date(2024, 5, 1), 3.5, 2), (dt.date(2024, 6, 1), 4.0, 1)}


def test_snapshots_pick_columns_by_header(spark):
    df = spark.createDataFrame([("a", "s", "5", "7", "1", "2,5")], [
        "COD ARTICOL", "MAGAZIN", "Stoc Disponibil Cantitativ Magazin", "STOC TOTAL CANTITATIV", "STOC DISPONIBIL OUTLET", "Nr Luni de Stoc General"])
    s = fs.stock_snapshot(df, "2024-05-01").first()
    assert (s["available_store_qty"], s["total_store_qty"], s["outlet_available_qty"], s["feature_scope"]) == (5.0, 7.0, 1.0, "current_snapshot")
    assert fs.rotation_snapshot(df, "2024-05-01").first()["months_of_stock"] == 2.5


def test_daily_sales_checks(spark):
    cols = ["sku_id", "store_id", "sale_date", "units_sold", "units_returned"]
    ok = spark.createDataFrame([("a", "s", "2024-01-05", "2", "0")], cols)
    assert fs.load_daily_sales(ok).first()["sale_date"] == dt.date(2024, 1, 5)
    with pytest.raises(ValueError, match="bad units_sold"):
        fs.load_daily_sales(ok.withColumn("units_sold", F.lit("-1")))
    with pytest.raises(ValueError, match="missing columns"):
        fs.load_daily_sales(ok.drop("store_id"))


def test_retail_files(spark):
    sales = spark.createDataFrame([(1, "a", "n1", "s", "2024-01-01", "2", "5", "", "9", "4", "C"), (2, "a", "n2", "s", "02/01/2024", "1", "0", "x", "8", "4", "C"),
                                   (3, "b", "nb", "s", "2024-01-01", "1", "0", "", "9", "4", "C"), (4, "a", "n", "", "2024-01-01", "1", "0", "", "9", "4", "C")],
                                  ["n", "sku_id", "sku_name", "store_id", "sale_date", "units_sold", "units_returned", "return_reason", "selling_price_lei", "purchase_cost_lei", "category"])
    inv = spark.createDataFrame([(1, "a", "s", "5", "2024-01-01", "U1"), (2, "a", "s", "7", "", "U2")], ["n", "sku_id", "store_id", "units_in_stock", "last_delivery_date", "supplier_id"])
    orders = spark.createDataFrame([(1, "o1", "U1", "a", "2024-01-01", "2024-01-09", "", "3"), (2, "o1", "U9", "a", "2024-01-01", "2024-01-09", "", "3")],
                                   ["n", "order_id", "supplier_id", "sku_id", "order_date", "promised_delivery_date", "actual_delivery_date", "units_ordered"])
    sup = spark.createDataFrame([("U1", "One", "RO", "")], ["supplier_id", "supplier_name", "country", "default_return_window_days"])
    t = fs.load_retail(sales, inv, orders, sup, ["n"])
    sku = t["skus"].collect()
    assert [(r["sku_id"], r["sku_name"], r["supplier_id"]) for r in sku] == [("a", "n1", "U2")]
    assert t["sales"].count() == 3 and t["sales"].agg(F.max("units_returned")).first()[0] == 2.0
    assert t["inventory"].first()["units_in_stock"] == 7.0
    assert [r["supplier_id"] for r in t["supplier_orders"].collect()] == ["U1"]
    assert t["suppliers"].first()["return_window_days"] == 90


def test_upsert_slice_replaces_only_its_slice(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "run string, v int")
    sn.upsert_slice(make([("a", 1), ("b", 2)]), path, ["run"])
    sn.upsert_slice(make([("a", 9)]), path, ["run"])
    assert sorted((r["run"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "transaction_key string, v int")
    for _ in range(2):
        sn.append_transactions(make([("a", 1), ("b", 2), ("b", 2)]), path, 1)
        sn.append_transactions(make([("b", 7), ("c", 3)]), path, 2)
    assert sorted((r["transaction_key"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_stream_takes_late_files_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    schema = T.StructType([T.StructField("transaction_key", T.StringType()), T.StructField("v", T.StringType())])
    run = lambda: append_stream(spark, str(inbox), schema, str(tmp_path / "t"), str(tmp_path / "c"), lambda df: df).awaitTermination(120)
    (inbox / "1.csv").write_text("transaction_key,v\na,1\nb,2\n")
    run()
    (inbox / "2.csv").write_text("transaction_key,v\nb,2\nc,3\n")
    run()
    assert sorted(r["transaction_key"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b", "c"]


def test_lines_that_differ_in_the_third_decimal_keep_their_own_key(spark):
    from stocktide.functions.text import transaction_key
    rows = spark.createDataFrame([("s", "i", "o", "k", "d", 1.0, q, "n") for q in (0.124, 0.121)], "a string, b string, c string, d string, e string, v double, q double, n string")
    assert rows.select(transaction_key(*[F.col(c) for c in rows.columns]).alias("k")).distinct().count() == 2


def test_two_streams_and_a_new_checkpoint_keep_all_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("transaction_key", T.StringType()), T.StructField("v", T.StringType())])
    for name, row, checkpoint in (("one", "a,1", "c1"), ("two", "b,2", "c2"), ("one", "a,1", "c3")):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "1.csv").write_text(f"transaction_key,v\n{row}\n")
        append_stream(spark, str(tmp_path / name), schema, str(tmp_path / "t"), str(tmp_path / checkpoint), lambda df: df).awaitTermination()
    assert sorted(r["transaction_key"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_export_with_a_blank_head_and_a_quoted_line_break(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('\n\nNAME;NOTE\nx;"one\ntwo"\ny;three\n')
    (tmp_path / "c.csv").write_text("NAME,NOTE\nz,four\n")
    got = sorted((r["NAME"], r["NOTE"], r["source_file"]) for r in fs.scan_export(spark, [str(tmp_path / "a b.csv"), str(tmp_path / "c.csv")]).collect())
    assert [g[:2] for g in got] == [("x", "one\ntwo"), ("y", "three"), ("z", "four")] or [g[:2] for g in got] == [("x", "one two"), ("y", "three"), ("z", "four")]
