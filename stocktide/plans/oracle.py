"""Comparison SQL: named building blocks, written apart from the Spark code."""

from __future__ import annotations

import re

from stocktide.plans.fixtures import TARGETS

_SKU = {
    "dense": "p_brand || '|' || p_type",
    "sparse": "'P' || l_partkey",
    "mixed": "CASE WHEN l_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE 'P' || l_partkey END",
}

BLOCKS: dict[str, str] = {}

BLOCKS["line0"] = """
SELECT *, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS order_date, CAST(l_shipdate AS DATE) AS invoice_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey"""

BLOCKS["line1"] = """
SELECT *, coalesce(order_date, invoice_date) AS sale_date, sgn * l_quantity AS quantity,
  sgn * floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS line_value,
  CASE WHEN l_linenumber = 7 AND l_partkey % 97 = 0 THEN 3.0 ELSE -l_discount END::DOUBLE AS discount_raw,
  'N' || c_nationkey AS store_id,
  CASE c_nationkey % 3 WHEN 0 THEN 'hyperstore' WHEN 1 THEN 'smaller_store' ELSE 'hybrid' END AS store_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ONLINE' WHEN '5-LOW' THEN 'OUTLET' END AS raion_raw,
  CASE WHEN l_discount >= 0.08 THEN 'SPRING' WHEN l_partkey % 40 = 0 THEN 'FABRO LINE' END AS campaign_raw,
  CASE WHEN l_partkey % 211 = 0 THEN 1 ELSE 0 END AS is_non_product,
  p_type AS category_norm, p_brand AS product_family_v2, p_name AS product_name
FROM line0"""

# The labels of the fixture only ever name days 3 to 23 of November of the sale year.
BLOCKS["line2"] = """
SELECT *, CAST(date_trunc('week', sale_date) AS DATE) AS week_start, year(sale_date) AS y,
  CASE WHEN abs(discount_raw) <= 1 THEN abs(discount_raw) END AS discount_pct,
  greatest(quantity, 0) AS gross_units, greatest(-quantity, 0) AS returned_units, quantity AS net_units,
  greatest(line_value, 0) AS gross_revenue, greatest(-line_value, 0) AS returned_revenue, line_value AS net_revenue,
  CASE WHEN quantity < 0 OR line_value < 0 THEN 1 ELSE 0 END AS is_return,
  month(sale_date) = 11 AND l_suppkey % 3 = 0 AS has_bf,
  day(sale_date) BETWEEN 3 AND 23 AS bf_in,
  make_date(year(sale_date), 11, 30) - CAST((isodow(make_date(year(sale_date), 11, 30)) + 2) % 7 AS INTEGER) AS lastfri
FROM line1"""

BLOCKS["line3"] = """
SELECT *, CASE WHEN has_bf AND bf_in THEN 1 ELSE 0 END AS is_bf_observed,
  CASE WHEN NOT has_bf AND sale_date BETWEEN lastfri - 4 AND lastfri + 2 THEN 1 ELSE 0 END AS is_bf_inferred,
  CASE WHEN has_bf THEN 1 ELSE 0 END AS is_bf_campaign,
  CASE WHEN campaign_raw = 'FABRO LINE' THEN 1 ELSE 0 END AS is_product_program,
  CASE WHEN campaign_raw IS NULL THEN 'unknown' ELSE 'observed' END AS campaign_signal_status,
  CASE WHEN has_bf AND bf_in THEN 'campaign_bf_raw' WHEN has_bf THEN 'campaign_bf_outside_timing_window'
    WHEN sale_date BETWEEN lastfri - 4 AND lastfri + 2 THEN
      CASE WHEN discount_pct >= 0.10 THEN 'inferred_calendar_discount' ELSE 'inferred_calendar_window' END
    ELSE 'unknown' END AS bf_signal_source
FROM line2"""

for _g, _s in _SKU.items():
    BLOCKS[f"txn_{_g}"] = f"SELECT *, is_bf_observed + is_bf_inferred AS is_bf_timing, {_s} AS sku_id FROM line3"
    BLOCKS[f"store_week_{_g}"] = f"""
SELECT sku_id, store_id, store_type, week_start, max(category_norm) AS category_norm, max(product_family_v2) AS product_family_v2,
  sum(gross_units) AS gross_units, sum(returned_units) AS returned_units, sum(net_units) AS net_units,
  sum(gross_revenue) AS gross_revenue, sum(returned_revenue) AS returned_revenue, sum(net_revenue) AS net_revenue,
  count(*) AS num_transactions, sum(is_return) AS num_return_lines, avg(discount_pct) AS avg_discount_pct,
  max(discount_pct) AS max_discount_pct, sum(is_bf_timing) AS bf_transaction_count,
  sum(is_bf_observed) AS bf_observed_transaction_count, sum(is_bf_inferred) AS bf_inferred_transaction_count,
  count(*) FILTER (raion_raw = 'ONLINE') AS online_transaction_count,
  count(*) FILTER (raion_raw = 'OUTLET') AS outlet_transaction_count
FROM txn_{_g} WHERE is_non_product = 0 GROUP BY ALL"""
    BLOCKS[f"chain_week_{_g}"] = f"""
SELECT sku_id, week_start, max(category_norm) AS category_norm, max(product_family_v2) AS product_family_v2,
  sum(gross_units) AS gross_units, sum(returned_units) AS returned_units, sum(net_units) AS net_units,
  sum(gross_revenue) AS gross_revenue, sum(returned_revenue) AS returned_revenue, sum(net_revenue) AS net_revenue,
  sum(num_transactions) AS num_transactions,
  count(DISTINCT CASE WHEN net_units > 0 THEN store_id END) AS num_stores_selling,
  count(DISTINCT CASE WHEN net_units > 0 AND store_type = 'hyperstore' THEN store_id END) AS num_hyperstores_selling,
  count(DISTINCT CASE WHEN net_units > 0 AND store_type = 'smaller_store' THEN store_id END) AS num_smaller_stores_selling,
  avg(avg_discount_pct) AS avg_discount_pct, max(max_discount_pct) AS max_discount_pct,
  sum(bf_transaction_count) AS bf_transaction_count, sum(bf_observed_transaction_count) AS bf_observed_transaction_count,
  sum(bf_inferred_transaction_count) AS bf_inferred_transaction_count,
  sum(online_transaction_count) AS online_transaction_count, sum(outlet_transaction_count) AS outlet_transaction_count
FROM store_week_{_g} GROUP BY ALL"""

BLOCKS["targets"] = "SELECT unnest([" + ", ".join(f"DATE '{t}'" for t in TARGETS) + "]) AS target_start"


def with_blocks(body: str) -> str:
    """Put the named blocks that ``body`` uses in front of it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", text)):
            if word in BLOCKS and word not in need:
                visit(BLOCKS[word])
                need.append(word)

    visit(body)
    if not need:
        return body
    head = "WITH " + ", ".join(f"{n} AS ({BLOCKS[n].strip()})" for n in need)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        return head + ", " + stripped[5:]
    return head + " " + stripped


def finish(sql: str, doubles: str = "", longs: str = "", digits: int = 4) -> str:
    """Round doubles to ``digits`` places and widen counts, as the Spark side does.

    The 1e-9 keeps exact ties from falling either way with the order of summing.
    """
    items = [f"round({c} + 1e-9, {digits}) AS {c}" for c in doubles.split()]
    items += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    inner = with_blocks(sql)
    return f"SELECT * REPLACE ({', '.join(items)}) FROM ({inner})" if items else inner
