"""Raw export rows -> typed transaction lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions import calendar as cal
from stocktide.functions import text as tx
from stocktide.functions.numbers import positive
from stocktide.operators.hierarchy import hierarchy_columns

# Campaign labels that name a product line, not a campaign.
PROGRAM_LABELS = ("FABRO", "FABRICAT IN ROMANIA", "PATSPRING")
_BF = r"(?i)\bBF\b|BLACK[_ ]?FRIDAY"
_YEAR = r"\b(20\d{2})\b"


def returns_split(df: DataFrame, quantity: str = "quantity", value: str = "line_value") -> DataFrame:
    """Signed quantity and value -> gross, returned and net columns."""
    q, v = F.col(quantity), F.col(value)
    return df.withColumns({
        "gross_units": positive(q),
        "returned_units": positive(-q),
        "net_units": positive(q) - positive(-q),
        "gross_revenue": positive(v),
        "returned_revenue": positive(-v),
        "net_revenue": positive(v) - positive(-v),
        "is_return": ((q < 0) | (v < 0)).cast("int"),
    })


def sale_dates(df: DataFrame) -> DataFrame:
    """Demand date = order date, else invoice date; lag and source beside it."""
    order, invoice = F.col("order_date"), F.col("invoice_date")
    return df.withColumns({
        "sale_date": F.coalesce(order, invoice),
        "sale_date_source": F.when(order.isNotNull(), "order_date").otherwise("invoice_date_fallback"),
        "used_invoice_date_fallback": order.isNull().cast("int"),
        "invoice_lag_days": F.datediff(invoice, order),
        "week_start": cal.week_start(F.coalesce(order, invoice)),
    })


def campaign_signals(df: DataFrame) -> DataFrame:
    """Campaign and campaign-week flags of every line.

    Needs sale_date, campaign_raw, campaign_bf_raw and discount_pct. A label in
    the dedicated column is direct evidence; a label in the general column can
    be an old one, so it only counts with the sale date behind it.
    """
    step = df.withColumns({"_c": tx.clean_text(F.col("campaign_raw")), "_b": tx.clean_text(F.col("campaign_bf_raw")), "_y": F.year("sale_date")})
    campaign, year = F.col("_c"), F.col("_y")
    step = step.withColumns({"_bf": F.col("_b").rlike(_BF), "_label": campaign.rlike(_BF)})
    # only the few labelled lines pay for reading the window and the years out of the text
    w0, w1 = cal.parse_campaign_window(F.col("_b"), year)
    k0, k1 = cal.bf_window_signal(year)
    years = F.regexp_extract_all(campaign, F.lit(_YEAR), F.lit(1))
    step = step.withColumns({
        "_w0": F.when(F.col("_bf"), w0), "_w1": F.when(F.col("_bf"), w1),
        "_season": (F.month("sale_date").between(11, 12)) & F.col("sale_date").between(k0, k1),
        "_years": F.when(F.col("_label"), years),
    })
    step = step.withColumns({
        "_named": F.col("_w0").isNotNull(), "_inside": F.col("sale_date").between(F.col("_w0"), F.col("_w1")),
        "_fresh": F.col("_label") & ((F.size("_years") == 0) | F.array_contains("_years", year.cast("string"))),
        "_bf_year": F.col("_b").rlike(_YEAR),
        "campaign_signal_status": F.when(campaign != "", "observed").otherwise("unknown"),
        "campaign_signal_source": F.when(campaign != "", "campaign_raw").otherwise("unknown"),
        "is_product_program": F.upper(campaign).rlike("|".join(PROGRAM_LABELS)).cast("int"),
    })
    bf_, named, inside, season = F.col("_bf"), F.col("_named"), F.col("_inside"), F.col("_season")
    source = (
        F.when(bf_ & named & inside, "campaign_bf_raw")
        .when(bf_ & named, "campaign_bf_outside_timing_window")
        .when(bf_ & season, "campaign_bf_raw_calendar_window")
        .when(bf_, "campaign_bf_without_timing_evidence")
        .when(season & F.col("_fresh"), "inferred_current_year_campaign_and_calendar")
        .when(season & (F.col("discount_pct") >= 0.10), "inferred_calendar_discount")
        .when(season, "inferred_calendar_window")
        .when(F.col("_fresh"), "campaign_label_without_timing_evidence")
        .otherwise("unknown")
    )
    step = step.withColumn("bf_signal_source", source)
    observed = F.col("bf_signal_source") == "campaign_bf_raw"
    inferred = F.col("bf_signal_source").isin(
        "campaign_bf_raw_calendar_window", "inferred_current_year_campaign_and_calendar",
        "inferred_calendar_discount", "inferred_calendar_window")
    is_bf = F.when(bf_, True).when(season, F.col("_label")).otherwise(F.col("_label") | F.col("_bf_year"))
    return step.withColumns({
        "is_bf_campaign": is_bf.cast("int"),
        "is_bf_timing": (observed | inferred).cast("int"),
        "is_bf_observed": observed.cast("int"),
        "is_bf_inferred": inferred.cast("int"),
        "bf_signal_status": F.when(observed, "observed").when(inferred, "inferred").otherwise("unknown"),
    }).drop(
        "_c", "_b", "_y", "_bf", "_label", "_w0", "_w1", "_years", "_named", "_inside", "_season", "_fresh", "_bf_year")


def store_lookup(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Legal store name -> (store_id, store_type); unknown names become a slug.

    ``stores`` (store_name, store_id, store_type) is a hand-kept list of shops;
    it is joined without a hint, so its measured size picks the strategy.
    """
    dim = stores.select(
        F.upper(F.trim("store_name")).alias("_name"), F.col("store_id").alias("_id"), F.col("store_type").alias("_type"))
    out = df.withColumn("_name", F.upper(tx.clean_text(F.col("store_raw")))).join(dim, "_name", "left")
    return out.withColumns({
        "store_id": F.coalesce("_id", tx.slug(F.col("store_raw"))),
        "store_type": F.coalesce("_type", F.lit("unknown")),
    }).drop("_name", "_id", "_type")


def pick(df: DataFrame, *names: str) -> Column:
    """First non-empty of the named source columns; absent columns count as empty."""
    have = [tx.null_if_empty(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


# Target column -> source headers in order of preference.
SOURCE_HEADERS = {
    "sku_id": ("COD ARTICOL",),
    "store_raw": ("MAGAZIN", "_store_hint"),
    "category_raw": ("CATEGORIE",),
    "class_raw": ("CLASA",),
    "subclass_raw": ("SUBCLASA",),
    "group_raw": ("GRUPA_PRODUSE", "GRUPA", "GRUPA DIRECTII_LICITATII"),
    "raion_raw": ("RAION",),
    "product_name": ("DENUMIRE ARTICOL",),
    "dimensions_raw": ("DIMENSIUNI",),
    "campaign_raw": ("CAMPANIE",),
    "campaign_bf_raw": ("CAMPANIE BF",),
    "campaign_selected_raw": ("CAMPANIE SELECTATA",),
    "supplier_name": ("FURNIZOR",),
    "supplier_ext": ("FURNIZOR EXT",),
    "supplier_id": ("ID FURNIZOR",),
    "order_id": ("ID COMANDA",),
    "invoice_id": ("ID FACTURA",),
    "client_id": ("ID CLIENT",),
    "client_specific": ("CLIENT SPECIFIC",),
    "export_year": ("AN",),
    "order_number": ("NR COMANDA",),
}


def normalize_sales(raw: DataFrame, stores: DataFrame, loyalty_header: str | None = None) -> DataFrame:
    """All-string export rows of any known layout -> typed transaction lines.

    Rows without a sale date, sku or store are dropped. Lineage columns
    (source_file, source_row_number, raw_row_json) are carried along if present.
    """
    carry = [c for c in ("source_file", "source_block", "source_row_number", "raw_row_json") if c in raw.columns]
    loyalty = F.col(f"`{loyalty_header}`") if loyalty_header in raw.columns else F.lit(None).cast("string")
    out = raw.select(
        *carry,
        *[pick(raw, *src).alias(name) for name, src in SOURCE_HEADERS.items()],
        tx.parse_date_multi(pick(raw, "DATA COMANDA")).alias("order_date"),
        tx.parse_date_multi(pick(raw, "DATA")).alias("invoice_date"),
        F.coalesce(tx.parse_decimal_comma(pick(raw, "CANTITATE FACTURATA")), F.lit(0.0)).alias("quantity"),
        F.coalesce(tx.parse_decimal_comma(pick(raw, "VALOARE FACTURATA")), F.lit(0.0)).alias("line_value"),
        tx.once(tx.parse_decimal_comma(pick(raw, "Reducere %")), tx.discount_fraction).alias("discount_pct"),
        tx.null_if_empty(loyalty).alias("loyalty_points_raw"),
        tx.yes_no_flag(loyalty).alias("loyalty_points_used"),
    )
    out = sale_dates(out).where(F.col("sale_date").isNotNull() & F.col("sku_id").isNotNull() & F.col("store_raw").isNotNull())
    out = store_lookup(out, stores)
    named = F.col("_named")
    out = out.withColumn("_named", tx.extract_dimensions(F.col("product_name"))).withColumns({
        "product_dimensions_raw": F.coalesce("dimensions_raw", named),
        "product_dimensions_source": F.when(F.col("dimensions_raw").isNotNull(), "dimensiuni_field")
        .when(named.isNotNull(), "product_name").otherwise("unknown"),
        "product_dimensions_signal_status": F.when(F.coalesce("dimensions_raw", named).isNotNull(), "observed")
        .otherwise("unknown"),
        "supplier_signal_status": F.when(F.coalesce("supplier_name", "supplier_ext", "supplier_id").isNotNull(), "observed")
        .otherwise("unknown"),
        "supplier_signal_source": F.when(F.coalesce("supplier_name", "supplier_ext", "supplier_id").isNotNull(),
                                         "supplier_fields").otherwise("unknown"),
        "is_non_product": tx.non_product_flag(
            F.col("category_raw"), F.col("class_raw"), F.col("subclass_raw"), F.col("product_name"), F.col("sku_id")),
    }).drop("dimensions_raw", "_named")
    out = returns_split(campaign_signals(hierarchy_columns(out)))
    return out.withColumn("transaction_key", tx.transaction_key(
        F.col("store_id"), F.col("invoice_id"), F.col("order_id"), F.col("sku_id"), F.col("sale_date"),
        F.col("line_value"), F.col("quantity"), F.col("product_name")))


def dedup_transactions(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of every key.

    ``min`` over a struct combines before the shuffle, so a key that holds a
    large part of all rows arrives as one row per task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, "_first.*").select(*df.columns)


def drop_superseded_sources(df: DataFrame, supersede: DataFrame) -> DataFrame:
    """Drop legacy-file rows of every store that also delivered a preferred file.

    ``supersede`` (preferred_file, legacy_file) is a short hand-kept list.
    """
    seen = df.select(F.col("source_file").alias("preferred_file")).distinct()
    gone = supersede.join(seen, "preferred_file", "left_semi").select(F.col("legacy_file").alias("source_file")).distinct()
    return df.join(gone, "source_file", "left_anti")


def pos_lines(df: DataFrame, skus: DataFrame | None = None) -> DataFrame:
    """Older single-store line shape: keep valid product lines and split the signed quantity.

    Needs sale_date, sku_id, quantity, line_value, category, supplier_id, is_service.
    """
    out = df.where(
        F.col("sale_date").isNotNull() & (F.coalesce("sku_id", F.lit("")) != "") & (F.col("is_service") == 0)
        & ~((F.col("line_value") == 0) & (F.col("quantity") >= 0)))
    if skus is not None:
        out = out.join(skus.select("sku_id").distinct(), "sku_id", "left_semi")
    return out.withColumns({
        "units_sold": positive(F.col("quantity")),
        "units_returned": positive(-F.col("quantity")),
        "value": F.abs("line_value"),
        "supplier_id": F.coalesce("supplier_id", F.lit("UNKNOWN")),
    })


def first_category(df: DataFrame, order: list[str]) -> DataFrame:
    """Category of the first line of every sku."""
    return df.groupBy("sku_id").agg(F.min_by("category", F.struct(*order)).alias("category"))
