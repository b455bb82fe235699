"""Buyer decisions: dead stock, supplier reliability, demand trend, queue, order scenarios."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions.calendar import week_start
from stocktide.functions.numbers import div, positive

INACTIVE_DAYS, NEVER_SOLD_DAYS, URGENT_DAYS, DEFAULT_WINDOW_DAYS = 60, 9999, 14, 90
NEVER_MOVED_UNITS, SUDDEN_WEEKS, SUDDEN_ACTIVE = 5, 12, 8
MIN_ORDERS, RECENT_ORDERS, TREND_DAYS, RISK_GAP_DAYS = 3, 6, 2.0, 5
QUEUE_TYPES = ("RETURN_WINDOW_CLOSING", "DEAD_STOCK", "STOCKOUT_RISK", "DEMAND_DECLINING", "OVER_ORDER_RISK")
ACTIONS = ("approve", "skip", "override")
SCENARIOS = (("conservative", 0.8), ("base", 1.0), ("aggressive", 1.2))
DEMAND_LEVELS = (("low_demand", 0.8), ("base_demand", 1.0), ("high_demand", 1.2))


def net_sales_clean(sales: DataFrame) -> DataFrame:
    """net_units = sold - returned, not below 0; missing returns count as 0."""
    return sales.withColumn("net_units", positive(F.col("units_sold") - F.coalesce("units_returned", F.lit(0.0))))


def return_window(delivery: Column, days: Column, as_of: dt.date) -> tuple[Column, Column, Column]:
    """(open, days remaining, urgent) of a supplier return window."""
    left = F.datediff(F.date_add(delivery, days), F.lit(as_of))
    return (
        F.coalesce(left > 0, F.lit(False)).cast("int"),
        F.when(left > 0, left).when(left <= 0, 0),
        F.coalesce((left > 0) & (left <= URGENT_DAYS), F.lit(False)).cast("int"),
    )


def trajectories(sales: DataFrame, as_of: dt.date, anchor: str = "as_of") -> DataFrame:
    """Last sale, lifetime units and class of every sold (sku, store).

    ``anchor='last_sale'`` counts the active weeks back from the last sale, so
    that SUDDEN_STOP can occur for rows that have been silent for long.
    """
    net = F.col("units_sold") - F.coalesce("units_returned", F.lit(0.0))
    # weekly bins end on Sunday, so a bin counts when its Sunday is in the look-back
    wk = sales.groupBy("sku_id", "store_id", F.date_add(week_start(F.col("sale_date")), 6).alias("w")).agg(
        F.sum(net).alias("net"), F.max(F.when(net > 0, F.col("sale_date"))).alias("last"))
    last = F.max("last").over(Window.partitionBy("sku_id", "store_id")) if anchor == "last_sale" else F.lit(as_of)
    wk = wk.withColumn("ref", last)
    recent = (F.col("w") >= F.date_sub("ref", 7 * SUDDEN_WEEKS)) & (F.col("net") > 0)
    g = wk.groupBy("sku_id", "store_id").agg(
        F.max("last").alias("last_sale_date"), F.sum("net").alias("lifetime_units"),
        F.count(F.when(recent, 1)).alias("active_recent_weeks"))
    return g.withColumn("trajectory", (
        F.when(F.col("lifetime_units") <= NEVER_MOVED_UNITS, "NEVER_MOVED")
        .when(F.col("active_recent_weeks") >= SUDDEN_ACTIVE, "SUDDEN_STOP").otherwise("LIFECYCLE_DECLINE")))


def dead_stock(sales: DataFrame, inventory: DataFrame, skus: DataFrame, suppliers: DataFrame, as_of: dt.date,
               anchor: str = "as_of") -> DataFrame:
    """Stocked (sku, store) rows without a net sale for 60 days."""
    out = inventory.where(F.col("units_in_stock") > 0).join(trajectories(sales, as_of, anchor), ["sku_id", "store_id"], "left")
    idle = F.coalesce(F.datediff(F.lit(as_of), "last_sale_date"), F.lit(NEVER_SOLD_DAYS))
    out = out.withColumn("days_inactive", idle).where(F.col("days_inactive") >= INACTIVE_DAYS)
    out = out.join(skus.select("sku_id", "sku_name", "category", F.col("supplier_id").alias("_s"), "purchase_cost"), "sku_id", "left")
    out = out.withColumn("supplier_id", F.coalesce("supplier_id", "_s"))
    out = out.join(suppliers.select("supplier_id", "return_window_days"), "supplier_id", "left")
    is_open, left, urgent = return_window(
        F.col("last_delivery_date"), F.coalesce("return_window_days", F.lit(DEFAULT_WINDOW_DAYS)).cast("int"), as_of)
    capital = F.round(F.col("units_in_stock") * F.col("purchase_cost"), 2)
    out = out.withColumns({
        "capital_at_risk": capital, "dead_stock_score": F.round(F.col("days_inactive") * capital, 2),
        "trajectory": F.coalesce("trajectory", F.lit("NEVER_MOVED")),
        "return_window_open": is_open, "return_window_days_remaining": left, "return_window_urgent": urgent,
    }).withColumn("budget_unlock", F.when(F.col("return_window_open") == 1, F.col("capital_at_risk")).otherwise(0.0))
    return out.select(
        "sku_id", "sku_name", "store_id", "category", "supplier_id", "days_inactive", "units_in_stock", "purchase_cost",
        "capital_at_risk", "dead_stock_score", "trajectory", "return_window_open", "return_window_days_remaining",
        "return_window_urgent", "budget_unlock")


def dead_stock_summary(dead: DataFrame) -> DataFrame:
    return dead.agg(
        F.round(F.coalesce(F.sum("capital_at_risk"), F.lit(0.0)), 2).alias("total_dead_stock"),
        F.round(F.coalesce(F.sum("budget_unlock"), F.lit(0.0)), 2).alias("total_budget_unlock"),
        F.countDistinct("sku_id").alias("sku_count"), F.coalesce(F.sum("return_window_urgent"), F.lit(0)).alias("urgent_return_count"))


def supplier_leads(orders: DataFrame) -> DataFrame:
    """Lead days of delivered orders."""
    return orders.where(F.col("actual_date").isNotNull()).withColumns({
        "promised_days": F.datediff("promised_date", "order_date"), "actual_days": F.datediff("actual_date", "order_date"),
        "late_days": F.datediff("actual_date", "promised_date")})


def recent_vs_history(orders: DataFrame) -> DataFrame:
    """Mean lateness of the last six orders of a supplier against the earlier ones.

    The rank filter keeps six rows per supplier in every task before anything
    is shuffled, and the earlier mean is what is left of the total, so a
    supplier with a large part of all orders is no hot spot.
    """
    lead = supplier_leads(orders)
    last = Window.partitionBy("supplier_id").orderBy(F.desc("order_date"), F.desc("order_id"))
    recent = lead.select("supplier_id", "order_date", "order_id", "late_days").withColumn("_r", F.row_number().over(last))
    recent = recent.where(F.col("_r") <= RECENT_ORDERS).groupBy("supplier_id").agg(
        F.sum("late_days").alias("rs"), F.count(F.lit(1)).alias("rn"))
    g = lead.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.avg("promised_days").alias("promised"), F.avg("actual_days").alias("actual"),
        F.stddev_samp("late_days").alias("spread"), F.sum("late_days").alias("ls"))
    out = g.join(recent, "supplier_id")
    rest = F.when(F.col("order_count") > RECENT_ORDERS, (F.col("ls") - F.col("rs")) / (F.col("order_count") - F.col("rn"))).otherwise(
        F.col("ls") / F.col("order_count"))
    return out.select(
        "supplier_id", "order_count", "promised", "actual", F.bround(F.col("actual") - F.col("promised"), 2).alias("lead_time_gap_days"),
        F.coalesce(F.bround("spread", 2), F.lit(0.0)).alias("delivery_consistency_std"),
        F.bround(F.col("rs") / F.col("rn"), 2).alias("recent_avg_variance_days"), F.bround(rest, 2).alias("historical_avg_variance_days"))


def supplier_reliability(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Score 0-100 and status of every supplier with at least three delivered orders."""
    m = recent_vs_history(orders).where(F.col("order_count") >= MIN_ORDERS)
    delta = F.bround(F.col("recent_avg_variance_days") - F.col("historical_avg_variance_days"), 2)
    score = (100 - F.least(F.lit(40.0), F.col("lead_time_gap_days") * 2)
             - F.least(F.lit(30.0), F.col("delivery_consistency_std") * 1.5) - positive(delta) * 3)
    m = m.withColumns({
        "trend": F.when(delta > TREND_DAYS, "WORSENING").when(delta < -TREND_DAYS, "IMPROVING").otherwise("STABLE"),
        "reliability_score": F.bround(F.least(F.lit(100.0), positive(score)), 1)})
    r = F.col("reliability_score")
    out = m.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
    return out.select(
        "supplier_id", F.coalesce("supplier_name", "supplier_id").alias("supplier_name"), "reliability_score",
        F.when(r >= 75, "GREEN").when(r >= 50, "YELLOW").otherwise("RED").alias("status"),
        F.bround("promised", 1).alias("avg_promised_lead_days"), F.bround("actual", 1).alias("avg_actual_lead_days"),
        "lead_time_gap_days", "delivery_consistency_std", "trend", "recent_avg_variance_days", "historical_avg_variance_days", "order_count")


def whole(c: Column) -> Column:
    return F.bround(c, 0).cast("long").cast("string")


def stockout_risk(orders: DataFrame, reliability: DataFrame, skus: DataFrame) -> DataFrame:
    """Every distinct sku ordered from a supplier that is more than five days late on average."""
    pairs = orders.where(F.col("actual_date").isNotNull()).select("supplier_id", "sku_id").distinct()
    late = reliability.where(F.col("lead_time_gap_days") > RISK_GAP_DAYS)
    out = pairs.join(late, "supplier_id").join(skus.select("sku_id", "sku_name"), "sku_id", "left")
    return out.select(
        "supplier_id", "supplier_name", "sku_id", F.coalesce("sku_name", "sku_id").alias("sku_name"), "avg_promised_lead_days",
        "avg_actual_lead_days", F.bround("lead_time_gap_days", 1).alias("days_overdue"),
        F.concat(F.lit("promised "), whole(F.col("avg_promised_lead_days")), F.lit(" days, actual "),
                 whole(F.col("avg_actual_lead_days")), F.lit(" days: order "), whole(F.col("lead_time_gap_days")),
                 F.lit(" days earlier")).alias("message"))


def demand_trend(sales: DataFrame, skus: DataFrame, as_of: dt.date) -> DataFrame:
    """Real and apparent demand, 8-week slope, trend and forecasts per sku.

    The slope is the least-squares slope over the last eight complete weeks
    with missing weeks as 0: with x fixed at 1..8 it is a weighted sum, so one
    grouped aggregate is enough.
    """
    last = as_of - dt.timedelta(days=as_of.weekday() + 7)
    sold, back = F.col("units_sold"), F.coalesce("units_returned", F.lit(0.0))
    age = (F.datediff(F.lit(last), week_start(F.col("sale_date"))) / 7).cast("int")
    past = (F.col("sale_date") <= F.lit(as_of)) & (age < 52)
    w8 = age.between(0, 7) & (F.col("sale_date") < F.lit(last + dt.timedelta(days=7)))
    month = dt.date(as_of.year - 1, as_of.month, 1)
    days = ((month.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - month).days
    same = F.trunc("sale_date", "MM") == F.lit(month)
    g = sales.where(F.col("sale_date") <= F.lit(as_of)).groupBy("sku_id").agg(
        (F.coalesce(F.sum(F.when(past, sold)), F.lit(0.0)) / 12).alias("apparent_demand_monthly"),
        (F.coalesce(F.sum(F.when(past, sold - back)), F.lit(0.0)) / 12).alias("real_demand_monthly"),
        F.coalesce(F.sum(F.when(past, back)) / F.sum(F.when(past & (sold > 0), sold)), F.lit(0.0)).alias("return_rate"),
        (F.coalesce(F.sum(F.when(w8, sold - back)), F.lit(0.0)) / 8).alias("base_weekly"),
        (F.coalesce(F.sum(F.when(w8, (3.5 - age) * (sold - back))), F.lit(0.0)) / 42).alias("trend_slope"),
        (F.coalesce(F.sum(F.when(same, sold)), F.lit(0.0)) / days * 28).alias("last_year_estimate_4_weeks"))
    base, slope = F.col("base_weekly"), F.col("trend_slope")
    g = g.withColumns({
        "return_flag": (F.col("return_rate") > 0.20).cast("int"),
        "trend_status": F.when(slope > 0.05 * F.abs(base), "GROWING").when(slope < -0.05 * F.abs(base), "DECLINING").otherwise("STABLE"),
        "forecast_4_weeks": positive(base * 4 + slope * 10), "forecast_8_weeks": positive(base * 8 + slope * 36)})
    g = g.join(skus.select("sku_id", "sku_name", "category", "purchase_cost"), "sku_id")
    gap = F.col("last_year_estimate_4_weeks") - F.col("forecast_4_weeks")
    return g.withColumns({"gap_units": gap, "gap_lei": gap * F.col("purchase_cost")}).drop("purchase_cost")


def demand_history(sales: DataFrame, trend: DataFrame) -> DataFrame:
    """Weekly real and apparent series and eight forecast points per sku, as one long table."""
    past = sales.groupBy("sku_id", week_start(F.col("sale_date")).alias("week_start")).agg(
        F.sum("units_sold").alias("apparent_units"), F.sum(F.col("units_sold") - F.coalesce("units_returned", F.lit(0.0))).alias("real_units"))
    past = past.select("sku_id", F.lit("history").alias("kind"), "week_start", F.lit(0).alias("step"), "apparent_units", "real_units")
    n = F.explode(F.sequence(F.lit(1), F.lit(8)))
    ahead = trend.select("sku_id", "base_weekly", "trend_slope", n.alias("step")).select(
        "sku_id", F.lit("forecast").alias("kind"), F.lit(None).cast("date").alias("week_start"), "step",
        F.lit(None).cast("double").alias("apparent_units"), (F.col("base_weekly") + F.col("trend_slope") * F.col("step")).alias("real_units"))
    return past.unionByName(ahead)


def decision_queue(dead: DataFrame, reliability: DataFrame, risk: DataFrame, trend: DataFrame) -> DataFrame:
    """Five kinds of items with what, why and action; the caller orders or limits them."""
    none = F.lit(None).cast("string")

    def item(df, kind, name, why, impact, action, status, sku, supplier, *details):
        return df.select(
            F.lit(kind).alias("queue_type"), F.concat(name, F.lit(f" - {kind}")).alias("what"), why.alias("why"),
            F.round(impact, 2).alias("financial_impact"), action.alias("recommended_action"), status.alias("status"),
            sku.alias("sku_id"), supplier.alias("supplier_id"), F.to_json(F.struct(*details)).alias("details"))

    c = F.col
    urgent = dead.where("return_window_urgent = 1")
    large = dead.where("return_window_urgent = 0 AND capital_at_risk > 5000")
    parts = [
        item(urgent, "RETURN_WINDOW_CLOSING", c("sku_name"),
             F.concat(F.lit("Return window closes in "), c("return_window_days_remaining").cast("string"), F.lit(" days")),
             c("capital_at_risk"), F.lit("Return to supplier"), F.lit("URGENT"), c("sku_id"), c("supplier_id"),
             "store_id", "days_inactive", "trajectory", "return_window_days_remaining"),
        item(large, "DEAD_STOCK", c("sku_name"),
             F.concat(c("days_inactive").cast("string"), F.lit(" days inactive, "), whole(c("units_in_stock")), F.lit(" units in stock")),
             c("capital_at_risk"), F.when(c("return_window_open") == 1, "Plan return").otherwise("Clear or write off"),
             F.when(c("days_inactive") > 120, "REVIEW").otherwise("INFO"), c("sku_id"), c("supplier_id"),
             "store_id", "days_inactive", "trajectory", "return_window_open"),
        item(reliability.where("status = 'RED'"), "SUPPLIER_RED", c("supplier_name"),
             F.concat(F.lit("Reliability "), whole(c("reliability_score")), F.lit("/100, trend "), c("trend")),
             F.lit(0.0), F.lit("Review contract"), F.lit("URGENT"), none, c("supplier_id"),
             "reliability_score", "lead_time_gap_days", "trend"),
        item(risk, "STOCKOUT_RISK", c("sku_name"), c("message"), F.lit(0.0),
             F.concat(F.lit("Order "), whole(c("days_overdue")), F.lit(" days earlier")), F.lit("URGENT"), c("sku_id"), c("supplier_id"),
             "supplier_name", "avg_promised_lead_days", "avg_actual_lead_days"),
        item(trend.where("trend_status = 'DECLINING' AND gap_lei > 2000"), "DEMAND_DECLINING", c("sku_name"),
             F.concat(F.lit("Gap of "), whole(c("gap_units")), F.lit(" units")), c("gap_lei"), F.lit("Reduce order"), F.lit("REVIEW"),
             c("sku_id"), none, "trend_slope", "forecast_4_weeks", "last_year_estimate_4_weeks"),
        item(trend.where("return_flag = 1 AND gap_lei > 1000"), "OVER_ORDER_RISK", c("sku_name"),
             F.concat(F.lit("Return rate "), whole(c("return_rate") * 100), F.lit(" percent")), c("gap_lei"),
             F.lit("Look into return reasons"), F.lit("REVIEW"), c("sku_id"), none,
             "return_rate", "apparent_demand_monthly", "real_demand_monthly"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(c("status") == "URGENT", 0).when(c("status") == "REVIEW", 1).otherwise(2)
    return out.withColumn("priority", rank)


def queue_order() -> list[Column]:
    return [F.col("priority"), F.desc("financial_impact"), F.col("queue_type"), F.col("sku_id"), F.col("supplier_id"), F.col("details")]


def queue_summary(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("total_items"), *[F.count(F.when(F.col("status") == s, 1)).alias(f"{s.lower()}_count")
                                                  for s in ("URGENT", "REVIEW", "INFO")],
        F.coalesce(F.sum("financial_impact"), F.lit(0.0)).alias("total_impact"))


def category_budget(budgets: DataFrame) -> DataFrame:
    """Latest budget of every category with what is left of it."""
    g = budgets.groupBy("category").agg(F.max_by(F.struct("period", "budget_lei", "spent_lei"), "period").alias("b")).select("category", "b.*")
    return g.withColumn("remaining_lei", positive(F.col("budget_lei") - F.coalesce("spent_lei", F.lit(0.0))))


def order_scenario_grid(skus: DataFrame) -> DataFrame:
    """Nine outcomes (3 order sizes x 3 demand levels) for every sku.

    Needs current_stock, forecast_8_weeks, selling_price, purchase_cost and remaining_lei (may be NULL).
    """
    grid = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(q).alias("qx"), F.lit(d).alias("demand_level"), F.lit(m).alias("dx"))
                     for s, q in SCENARIOS for d, m in DEMAND_LEVELS])
    c = F.col
    out = skus.withColumn("recommended_qty", F.greatest(F.lit(0), F.bround(c("forecast_8_weeks") - c("current_stock"), 0).cast("long")))
    out = out.select("*", F.inline(grid))
    out = out.withColumns({
        "order_qty": F.greatest(F.lit(0), F.bround(c("recommended_qty") * c("qx"), 0).cast("long")),
        "_fc": c("forecast_8_weeks") * c("dx")})
    out = out.withColumn("_have", c("current_stock") + c("order_qty"))
    cost = F.round(c("order_qty") * c("purchase_cost"), 2)
    revenue = F.round(F.least("_have", "_fc") * c("selling_price"), 2)
    out = out.withColumns({
        "order_cost": cost, "units_sold": F.least("_have", "_fc"), "revenue": revenue,
        "unsold_units": positive(c("_have") - c("_fc")), "dead_stock_value": F.round(positive(c("_have") - c("_fc")) * c("purchase_cost"), 2),
        "shortage_units": positive(c("_fc") - c("_have")), "lost_revenue": F.round(positive(c("_fc") - c("_have")) * c("selling_price"), 2),
        "margin": revenue - cost, "margin_pct": F.coalesce(div(revenue - cost, revenue), F.lit(0.0)),
        "within_budget": F.coalesce(cost <= c("remaining_lei"), F.lit(True)).cast("int"), "budget_after": c("remaining_lei") - cost})
    return out.drop("qx", "dx", "_fc", "_have")


def stock_totals(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("sku_id").agg(F.sum("units_in_stock").alias("current_stock"), F.count(F.lit(1)).alias("stores_stocked"))


def stock_cover(profile: DataFrame) -> DataFrame:
    """Weeks of cover, lead time and reorder flag; NULL without real demand."""
    weekly = F.when((F.col("real_demand_monthly") > 0) & (F.col("forecast_8_weeks") > 0), F.col("forecast_8_weeks") / 8)
    lead = F.coalesce(F.col("avg_actual_lead_days") / 7, F.lit(3.0))
    weeks = F.bround(F.col("current_stock") / weekly, 1)
    return profile.withColumns({
        "weeks_of_cover": weeks, "lead_time_weeks": F.when(weekly.isNotNull(), F.bround(lead, 1)),
        "reorder_needed": (weeks < lead + 1).cast("int")})


def sku_profile(skus: DataFrame, inventory: DataFrame, trend: DataFrame, reliability: DataFrame, risk: DataFrame, dead: DataFrame) -> DataFrame:
    """One row per sku with stock, demand, supplier, risk and dead-stock roll-up."""
    worst = F.max_by(F.struct("store_id", "days_inactive", "trajectory"), F.struct("capital_at_risk", "store_id")).alias("_w")
    roll = dead.groupBy("sku_id").agg(
        worst, F.sum("capital_at_risk").alias("dead_capital"), F.sum("budget_unlock").alias("dead_budget_unlock"),
        F.max("return_window_open").alias("any_window_open"), F.max("return_window_urgent").alias("any_window_urgent"),
        F.count(F.lit(1)).alias("dead_stores"),
    ).select("*", F.col("_w.store_id").alias("worst_store"), F.col("_w.trajectory").alias("worst_trajectory")).drop("_w")
    flagged = risk.groupBy("sku_id", "supplier_id").agg(F.lit(1).alias("stockout_risk"))
    out = (skus.join(stock_totals(inventory), "sku_id", "left").join(trend.drop("sku_name", "category"), "sku_id", "left")
           .join(reliability.select("supplier_id", "reliability_score", "status", "avg_actual_lead_days"), "supplier_id", "left")
           .join(flagged, ["sku_id", "supplier_id"], "left").join(roll, "sku_id", "left"))
    out = out.fillna(0, ["current_stock", "stores_stocked", "stockout_risk", "dead_stores"])
    return stock_cover(out).withColumn("is_dead_stock", (F.col("dead_stores") > 0).cast("int"))


def split_decisions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) buyer decisions; rejected rows carry the reason."""
    r = requests.withColumns({"action": F.lower(F.trim("action")), "queue_type": F.upper(F.trim("queue_type"))})
    reason = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "bad_action")
        .when(~F.coalesce(F.col("queue_type").isin(*QUEUE_TYPES), F.lit(False)), "bad_queue_type")
        .when((F.col("action") == "override") & F.col("override_qty").isNull(), "override_without_qty"))
    r = r.withColumn("reject_reason", reason)
    return r.where(reason.isNull()).drop("reject_reason"), r.where(reason.isNotNull())


def of_day(decisions: DataFrame, day: dt.date | None) -> DataFrame:
    """Decisions of one day, or all of them; those without a time belong to no day."""
    return decisions if day is None else decisions.where(F.to_date("decided_at") == F.lit(day))


def decisions_summary(decisions: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Counts and impact by action, and the impact of all actions, over all rows (of a day, if one is given) and by queue type."""
    both = of_day(decisions, day).withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("queue_type"))))
    impact = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("financial_impact"))), F.lit(0.0))
    return both.groupBy("scope").agg(
        F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("action") == a, 1)).alias(f"{a}_count") for a in ACTIONS],
        *[impact(a).alias(f"{a}_impact") for a in ACTIONS], F.coalesce(F.sum("financial_impact"), F.lit(0.0)).alias("impact"))


def recent_decisions(decisions: DataFrame, day: dt.date | None = None, k: int = 10) -> DataFrame:
    """The last ``k`` decisions (of a day, if one is given), ties to the larger id."""
    cols = ("id", "sku_id", "queue_type", "action", "override_qty", "financial_impact", "decided_at")
    return of_day(decisions, day).select(*cols).orderBy(F.desc_nulls_last("decided_at"), F.desc_nulls_last("id")).limit(k)


def financial_impact(rows: DataFrame) -> DataFrame:
    """Cost of ordering too much or too little for a basic estimate and a forecast.

    Needs basic_order, engine_order, actual_units, purchase_cost and selling_price.
    """
    c = F.col
    over = lambda o: positive(c(o) - c("actual_units")) * c("purchase_cost")
    under = lambda o: positive(c("actual_units") - c(o)) * (c("selling_price") - c("purchase_cost")) * 1.5
    return rows.agg(
        F.count(F.lit(1)).alias("skus"), F.sum(over("basic_order")).alias("basic_over_cost"), F.sum(under("basic_order")).alias("basic_out_cost"),
        F.sum(over("engine_order")).alias("engine_over_cost"), F.sum(under("engine_order")).alias("engine_out_cost"),
    ).withColumn("savings", c("basic_over_cost") + c("basic_out_cost") - c("engine_over_cost") - c("engine_out_cost"))


def sku_search(skus: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Case-insensitive part of name or id, by name; the first 20 are the feature."""
    like = f"%{text}%"
    return skus.where(F.col("sku_name").ilike(like) | F.col("sku_id").ilike(like)).orderBy("sku_name", "sku_id").limit(limit)


def top_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
