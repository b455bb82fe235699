"""Delimited exports: everything is read as text and typed afterwards."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide.functions import text as tx
from stocktide.operators.clean import pick

DELIMITERS = ",;\t|"


def _line_patterns(sep: str) -> tuple[str, str]:
    """Patterns of a line that ends outside quotes: if it began outside of them, and if it began inside."""
    sep = "\\t" if sep == "\t" else "\\" + sep if sep == "|" else sep
    inner = '[^"]*+(?:""[^"]*+)*+"' + f"[^{sep}]*+"
    field = f'(?:"{inner}|(?!")[^{sep}]*+)'
    return f"^{field}(?:{sep}{field})*+$", f"^{inner}(?:{sep}{field})*+$"


def _left_open(line: Column, sep: str) -> Column:
    """Whether a record that begins with this line goes on in the next one."""
    return line.contains('"') & ~line.rlike(_line_patterns(sep)[0])


def header_lines(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, set[str]]]:
    """By one job over all files: the first line of each that is not blank, and the delimiters by which a line of it ends inside quotes."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("value"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    filled = F.trim(F.translate("value", "\ufeff\t\r", "")) != ""
    found = lines.where(filled).groupBy("path").agg(
        F.min_by("value", "place").alias("line"), *[F.bool_or(_left_open(F.col("value"), sep)).alias(f"open{k}") for k, sep in enumerate(DELIMITERS)])
    return {unquote(r.path): (r.line, {sep for k, sep in enumerate(DELIMITERS) if r[f"open{k}"]}) for r in found.collect()}  # one row per file


def layout_of(line: str) -> tuple[str, list[str]]:
    """Delimiter and trimmed column names of a header line."""
    line = line.lstrip("﻿")
    sep = max(DELIMITERS, key=lambda c: (line.count(c), -DELIMITERS.index(c)))
    names = next(csv.reader([line], delimiter=sep), [])
    return sep, [n.replace("﻿", "").strip().strip('"').strip() for n in names]


def whole_records(lines: DataFrame, sep: str) -> DataFrame:
    """``(path, block, row, record)`` of files in which quoted values hold line breaks, read by any number of tasks.

    ``lines`` holds ``(path, block, row, value)``: the lines of every file split.
    A line begins outside or inside quotes. What it makes of either state is one
    of four functions: both end the same (a reset), both stay, or both swap. So
    the state before a line is that after the last reset, swapped as often as
    lines swap since; it is found within each split first, then over one row per
    split, and a split's first lines may end a record of an earlier one.
    """
    from_out, from_in = (F.when(F.col("value").contains('"'), ~F.col("value").rlike(p)).otherwise(F.lit(k == 1)) for k, p in enumerate(_line_patterns(sep)))
    lines = lines.withColumns({"_out": from_out, "_in": from_in})
    lines = lines.withColumns({"_reset": F.col("_out") == F.col("_in"), "_swap": (F.col("_out") & ~F.col("_in")).cast("int")})

    def before(df: DataFrame, w: Window) -> DataFrame:
        """Last reset before a row (its end state and the swaps up to it), and swaps before the row."""
        df = df.withColumn("_swaps", F.sum("_swap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(F.col("_reset"), F.struct(F.col("_out").cast("int").alias("state"), F.col("_swaps").alias("swaps"))), ignorenulls=True)
        return df.withColumns({"_last": last.over(earlier), "_sum": F.coalesce(F.sum("_swap").over(earlier), F.lit(0))})

    own = before(lines, Window.partitionBy("path", "block").orderBy("row"))
    after = F.struct(F.col("_reset").alias("reset"), F.col("_out").cast("int").alias("state"), F.col("_swaps").alias("swaps"))
    splits = own.groupBy("path", "block").agg(
        F.max_by(after, F.when(F.col("_reset"), F.col("row"))).alias("_tail"), F.sum("_swap").alias("_total"))
    # a split as one line: a reset if it holds one, then its swaps since
    since = F.col("_total") - F.coalesce(F.col("_tail.swaps"), F.lit(0))
    splits = splits.select(
        "path", "block", F.col("_tail.reset").isNotNull().alias("_reset"),
        ((F.col("_tail.state") + since) % 2 == 1).alias("_out"), F.when(F.col("_tail.reset").isNull(), since).otherwise(0).alias("_swap"))
    state = lambda: (F.coalesce(F.col("_last.state"), F.lit(0)) + F.col("_sum") - F.coalesce(F.col("_last.swaps"), F.lit(0))) % 2
    entry = before(splits, Window.partitionBy("path").orderBy("block")).select("path", "block", state().alias("_entry"))
    own = own.join(entry, ["path", "block"])
    start = F.when(F.col("_last").isNull(), F.col("_entry") + F.col("_sum")).otherwise(F.col("_last.state") + F.col("_sum") - F.col("_last.swaps")) % 2 == 0
    own = own.withColumn("_start", F.when(start, F.col("row")))
    own = own.withColumn("_record", F.max("_start").over(Window.partitionBy("path", "block").orderBy("row")))
    # lines before a split's first record end the last record of the nearest earlier split that begins one
    begun = own.groupBy("path", "block").agg(F.max("_start").alias("row"))
    carry = F.last(F.when(F.col("row").isNotNull(), F.struct("block", "row")), ignorenulls=True)
    begun = begun.select("path", "block", carry.over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    own = own.join(begun, ["path", "block"])
    mine = F.col("_record").isNotNull()
    place = F.struct(F.col("block").alias("b"), F.col("row").alias("r"), F.col("value").alias("v"))
    return own.groupBy(
        "path", F.when(mine, F.col("block")).otherwise(F.col("_carry.block")).alias("_block"), F.coalesce("_record", "_carry.row").alias("_row"),
    ).agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda e: e["v"]), "\n").alias("record")).select(
        "path", F.col("_block").alias("block"), F.col("_row").alias("row"), "record")


def _broken_export(spark: SparkSession, files: list[str], sep: str, names: list[str]) -> DataFrame:
    """Rows of exports with line breaks inside quotes; the first record that is not blank is the header."""
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    records = whole_records(lines, sep).where(F.trim(F.translate("record", "\ufeff\t\r\n", "")) != "")
    head = records.where(F.col("block") == 0).groupBy("path").agg(F.min("row").alias("_head"))
    records = records.join(head, "path", "left").where((F.col("block") != 0) | (F.col("row") > F.col("_head")))
    ddl = ", ".join(f"c{k} string" for k in range(len(names)))
    value = F.from_csv("record", ddl, {"sep": sep, "quote": '"', "escape": '"'})
    return records.withColumn("_value", value).select(
        *[tx.clean_text(F.col(f"_value.c{k}")).alias(n) for k, n in enumerate(names)], F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.col("block").alias("source_block"), F.col("row").alias("source_row_number"))


def scan_export(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of many exports with differing layouts as trimmed text.

    Files with the same layout are read in one scan, and large files by several
    tasks. A record may hold line breaks inside quotes: files that have such
    records are put together from their lines (``whole_records``), all others
    are read line by line. Blank lines at a file's head are passed over, and a
    file without any line has no rows. Lineage: source_file, and (source_block,
    source_row_number) which together order the rows of a file.
    """
    layouts: dict[tuple[str, tuple[str, ...], bool], list[str]] = {}
    for p, (line, broken) in sorted(header_lines(spark, paths).items()):
        sep, names = layout_of(line)
        layouts.setdefault((sep, tuple(names), sep in broken), []).append(p)
    out = None
    for (sep, names, broken), files in layouts.items():
        if broken:
            df = _broken_export(spark, files, sep, list(names))
        else:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            df = spark.read.csv(files, sep=sep, header=True, schema=schema, quote='"', escape='"', enforceSchema=True)
            df = df.select(
                *[tx.clean_text(F.col(f"`{n}`")).alias(n) for n in names],
                F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"),
                F.col("_metadata.file_block_start").alias("source_block"), F.monotonically_increasing_id().alias("source_row_number"))
        df = df.where(F.concat(*[F.col(f"`{n}`") for n in names]) != "")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


LINEAGE = ("source_file", "source_block", "source_row_number")


def raw_row_archive(df: DataFrame) -> DataFrame:
    """Keep the untouched row as JSON with sorted keys."""
    cols = sorted(c for c in df.columns if c not in LINEAGE)
    return df.withColumn("raw_row_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}))


def store_hint(df: DataFrame, hints: dict[str, str]) -> DataFrame:
    """Store name from a token in the file name, for exports without a store column."""
    name = F.upper("source_file")
    c = F.lit(None).cast("string")
    for token, store in reversed(list(hints.items())):
        c = F.when(name.contains(token.upper()), F.lit(store)).otherwise(c)
    return df.withColumn("_store_hint", c)


def by_pattern(df: DataFrame, includes: list[str], excludes: list[str] = ()) -> list[str]:
    """Columns whose header holds all of ``includes`` and none of ``excludes``."""
    return [c for c in df.columns if all(i.upper() in c.upper() for i in includes) and not any(e.upper() in c.upper() for e in excludes)]


def number_of(df: DataFrame, names: list[str]) -> Column:
    have = [tx.parse_decimal_comma(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


# Measure -> exact headers of a store stock snapshot.
SNAPSHOT_HEADERS = {
    "supplier_available_qty": ["STOC DISPONIBIL FURNIZOR", "Stoc Disponibil Cantitativ Furnizor"],
    "sellable_store_qty": ["Cantitate Stoc Disponibil Vandabil Magazine"],
    "reserved_qty": ["Cantitate Stoc Rezervat"],
    "reserved_value": ["Valoare Stoc Rezervat"],
    "stock_age_days": ["NR ZILE STOC"],
    "rotation_m12": ["Viteza de Rotatie Stoc Magazine (M12)"],
    "months_stock_supplier": ["LUNI STOC FURNIZOR"],
    "months_stock_general": ["LUNI STOC GENERAL"],
    "avg_sales_metric": ["MEDIU VANZARE", "Vanzari Cantitative Magazine 2024 (client final)"],
}
# Measure -> header parts wanted and not wanted.
SNAPSHOT_PATTERNS = {
    "available_store_qty": (["STOC DISPONIBIL", "CANTITATIV"], ["FURNIZOR", "OUTLET"]),
    "outlet_available_qty": (["STOC DISPONIBIL", "OUTLET"], []),
    "total_store_qty": (["STOC TOTAL", "CANTITATIV"], []),
    "position_stock_qty": (["STOC TOTAL", "POZITIE"], []),
}
ROTATION_PATTERNS = {
    "months_of_stock": (["NR LUNI DE STOC"], []),
    "rotation_general_stock_sales": (["VITEZA DE ROTATIE", "GENERAL"], []),
    "rotation_consolidated_stock": (["VITEZA DE ROTATIE", "CONSOLIDAT"], []),
    "rotation_supplier_total_stock_sales": (["VITEZA DE ROTATIE", "FURNIZOR", "TOTAL"], []),
    "rotation_supplier_stock": (["VITEZA DE ROTATIE", "FURNIZOR"], ["TOTAL"]),
    "rotation_store_stock_sales": (["VITEZA DE ROTATIE", "MAGAZINE", "VANZARI"], []),
    "rotation_store_stock": (["VITEZA DE ROTATIE", "MAGAZINE"], ["VANZARI"]),
    "store_available_qty": (["STOC DISPONIBIL"], ["FURNIZOR", "VITEZA"]),
    "store_total_qty": (["STOC TOTAL"], ["VITEZA"]),
    "store_reserved_qty": (["STOC REZERVAT"], ["VITEZA"]),
}


def stock_snapshot(raw: DataFrame, snapshot_date: str, allowed: DataFrame | None = None) -> DataFrame:
    """Current stock of a store; stamped so that it can never feed a backtest."""
    out = raw.select(
        *[c for c in ("source_file",) if c in raw.columns], pick(raw, "COD ARTICOL", "ARTICOL COD").alias("sku_id"),
        pick(raw, "store_id", "MAGAZIN", "_store_hint").alias("store_id"), pick(raw, "DENUMIRE ARTICOL").alias("product_name"),
        pick(raw, "VECHIME IN COLECTIE").alias("collection_age_bucket"), tx.parse_date_multi(pick(raw, "DATA INTRARE STOC")).alias("stock_entry_date"),
        *[number_of(raw, h).alias(m) for m, h in SNAPSHOT_HEADERS.items()],
        *[number_of(raw, (["CANTSTOC"] if m == "total_store_qty" else []) + by_pattern(raw, *p)).alias(m) for m, p in SNAPSHOT_PATTERNS.items()],
        F.lit(snapshot_date).cast("date").alias("snapshot_date"), F.lit("current_snapshot").alias("feature_scope"),
    ).where(F.col("sku_id").isNotNull() & F.col("store_id").isNotNull())
    return out if allowed is None else out.join(allowed.select("store_id").distinct(), "store_id", "left_semi")


def rotation_snapshot(raw: DataFrame, snapshot_date: str) -> DataFrame:
    """Months of stock, six rotation speeds and three stock quantities, found by header."""
    return raw.select(
        pick(raw, "COD ARTICOL", "ARTICOL COD").alias("sku_id"), pick(raw, "store_id", "MAGAZIN", "_store_hint").alias("store_id"),
        *[number_of(raw, by_pattern(raw, *p)).alias(m) for m, p in ROTATION_PATTERNS.items()],
        F.lit(snapshot_date).cast("date").alias("snapshot_date")).where(F.col("sku_id").isNotNull())


def discount_export(raw: DataFrame) -> DataFrame:
    """Discount accounting lines; columns are found by part of their header."""
    first = lambda part: F.col(f"`{by_pattern(raw, [part])[0]}`") if by_pattern(raw, [part]) else F.lit(None).cast("string")
    return raw.select(
        first("COD ARTICOL").alias("item_code"), first("DENUMIRE").alias("description"), tx.parse_date_multi(first("DATA")).alias("line_date"),
        tx.parse_decimal_comma(first("VALOARE")).alias("line_value"), *[c for c in LINEAGE if c in raw.columns])


def load_daily_sales(raw: DataFrame) -> DataFrame:
    """Five-column daily sales with strict checks; any bad row raises with its count."""
    need = ["sku_id", "store_id", "sale_date", "units_sold", "units_returned"]
    gone = [c for c in need if c not in raw.columns]
    if gone:
        raise ValueError(f"missing columns: {gone}")
    t = raw.select(
        tx.null_if_empty(F.col("sku_id")).alias("sku_id"), tx.null_if_empty(F.col("store_id")).alias("store_id"),
        F.try_to_date(F.trim("sale_date"), "yyyy-MM-dd").alias("sale_date"),
        *[F.trim(c).try_cast("double").alias(c) for c in ("units_sold", "units_returned")])
    bad = lambda c: F.count(F.when(c, 1))
    checks = {"empty sku_id": F.col("sku_id").isNull(), "empty store_id": F.col("store_id").isNull(), "bad sale_date": F.col("sale_date").isNull()}
    for c in ("units_sold", "units_returned"):
        checks[f"bad {c}"] = F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0)
    row = t.agg(F.count(F.lit(1)).alias("n"), *[bad(c).alias(k) for k, c in checks.items()]).first()
    found = {k: row[k] for k in checks if row[k]}
    if row["n"] == 0:
        raise ValueError("no rows")
    if found:
        raise ValueError(f"bad rows: {found}")
    return t


def load_retail(sales: DataFrame, inventory: DataFrame, orders: DataFrame, suppliers: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Generic four-file layout -> typed tables.

    ``order`` names the columns that give the input order. First sales row of
    a sku with a supplier makes its dimension row; the last inventory row of a
    (sku, store) and the first order row of an order id win.
    """
    o = F.struct(*order)
    s = lambda c: tx.null_if_empty(F.col(c))
    n = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    d = lambda c: tx.parse_date_multi(F.col(c), ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy"))
    inv = inventory.select(s("sku_id").alias("sku_id"), s("store_id").alias("store_id"), s("supplier_id").alias("supplier_id"),
                           n("units_in_stock").alias("units_in_stock"), d("last_delivery_date").alias("last_delivery_date"), o.alias("_o"))
    owner = inv.where("sku_id IS NOT NULL AND supplier_id IS NOT NULL").groupBy("sku_id").agg(F.max_by("supplier_id", "_o").alias("supplier_id"))
    t = sales.select(
        s("sku_id").alias("sku_id"), s("store_id").alias("store_id"), d("sale_date").alias("sale_date"), n("units_sold").alias("units_sold"),
        n("units_returned").alias("units_returned"), s("return_reason").alias("return_reason"), n("selling_price_lei").alias("selling_price"),
        n("purchase_cost_lei").alias("purchase_cost"), s("sku_name").alias("sku_name"), s("category").alias("category"), o.alias("_o"))
    dim = ["sku_name", "category", "selling_price", "purchase_cost"]
    skus = t.where("sku_id IS NOT NULL").groupBy("sku_id").agg(F.min_by(F.struct(*dim), "_o").alias("f")).select("sku_id", "f.*").join(owner, "sku_id")
    first = orders.where(s("order_id").isNotNull()).select(
        s("order_id").alias("order_id"), s("supplier_id").alias("supplier_id"), s("sku_id").alias("sku_id"), d("order_date").alias("order_date"),
        d("promised_delivery_date").alias("promised_date"), d("actual_delivery_date").alias("actual_date"), n("units_ordered").alias("units_ordered"), o.alias("_o"))
    first = first.where("supplier_id IS NOT NULL AND sku_id IS NOT NULL AND order_date IS NOT NULL AND promised_date IS NOT NULL")
    cols = [c for c in first.columns if c not in ("order_id", "_o")]
    return {
        "suppliers": suppliers.select(s("supplier_id").alias("supplier_id"), s("supplier_name").alias("supplier_name"), s("country").alias("country"),
                                      F.coalesce(F.trim("default_return_window_days").try_cast("int"), F.lit(90)).alias("return_window_days")).where("supplier_id IS NOT NULL"),
        "skus": skus,
        "sales": t.where("sku_id IS NOT NULL AND store_id IS NOT NULL AND sale_date IS NOT NULL").withColumn(
            "units_returned", F.least("units_returned", "units_sold")).select(
            "sku_id", "store_id", "sale_date", "units_sold", "units_returned", "return_reason", "selling_price", "purchase_cost"),
        "inventory": inv.where("sku_id IS NOT NULL AND store_id IS NOT NULL").groupBy("sku_id", "store_id").agg(
            F.max_by(F.struct("units_in_stock", "last_delivery_date", "supplier_id"), "_o").alias("f")).select("sku_id", "store_id", "f.*"),
        "supplier_orders": first.groupBy("order_id").agg(F.min_by(F.struct(*cols), "_o").alias("f")).select("order_id", "f.*"),
    }


def source_ledger(rows: DataFrame, key: str = "transaction_key") -> DataFrame:
    """One row per file: seen, kept, duplicate, filtered and fallback rows and the date span.

    Needs source_file, sale_date, sku_id, store_id, used_invoice_date_fallback and the transaction key.
    """
    ok = F.col("sale_date").isNotNull() & F.col("sku_id").isNotNull() & F.col("store_id").isNotNull()
    first = rows.where(ok).groupBy(key).agg(F.min("source_file").alias("source_file"))
    kept = first.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_inserted"))
    n = lambda c: F.count(F.when(c, 1))
    seen = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_seen"), n(ok).alias("rows_valid"), n(F.col("sale_date").isNull()).alias("missing_date"),
        n(F.col("sku_id").isNull()).alias("missing_sku"), n(F.col("store_id").isNull()).alias("missing_store"),
        F.coalesce(F.sum("used_invoice_date_fallback"), F.lit(0)).alias("date_fallback_rows"),
        F.min(F.when(ok, F.col("sale_date"))).alias("min_sale_date"), F.max(F.when(ok, F.col("sale_date"))).alias("max_sale_date"))
    out = seen.join(kept, "source_file", "left").fillna(0, ["rows_inserted"])
    return out.withColumns({"rows_duplicate": F.col("rows_valid") - F.col("rows_inserted"), "rows_filtered": F.col("rows_seen") - F.col("rows_valid")}).drop("rows_valid")


