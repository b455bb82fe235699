"""Discount lines -> campaign calendar, promo weeks and promo lift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a campaign text -> category and how sure the mapping is.
CATEGORY_WORDS = (
    ("corpuri iluminat", "ACCESORII", 1.0), ("covoare", "ACCESORII", 1.0), ("covor", "ACCESORII", 1.0),
    ("decoratiuni perete", "ACCESORII", 1.0), ("decoratiuni", "ACCESORII", 0.8), ("mexkids", "MOBILIER DE CASA", 0.9),
    ("mobilier copii", "MOBILIER DE CASA", 1.0), ("mobilier de copii", "MOBILIER DE CASA", 1.0),
    ("mobilier de copiii", "MOBILIER DE CASA", 1.0), ("mese si scaune", "CANAPELE SI FOTOLII", 1.0),
    ("jucarie", "ALTELE", 0.8), ("jucariei", "ALTELE", 0.8),
)
_LONG = r"(\d{1,2})\.(\d{2})\s*[-–]\s*(\d{1,2})\.(\d{2})\.(\d{4})"
_SHORT = r"(\d{1,2})\s*[-–]\s*(\d{1,2})\.(\d{2})\.(\d{4})"


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def promo_text_fields(df: DataFrame, code: str = "item_code", text: str = "description", words=CATEGORY_WORDS) -> DataFrame:
    """Start and end date, percent, category hint and line type of a discount line.

    '20.03-02.04.2024' and '6-26.09.2023' are read; a start month after the
    end month lies in the year before.
    """
    t = F.col(text)
    g = lambda p, i: F.regexp_extract(t, p, i)
    long = F.regexp_like(t, F.lit(_LONG))
    short = ~long & F.regexp_like(t, F.lit(_SHORT))
    year = g(_LONG, 5).try_cast("int") - F.when(g(_LONG, 2).try_cast("int") > g(_LONG, 4).try_cast("int"), 1).otherwise(0)
    start = F.when(long, _date(year, g(_LONG, 2), g(_LONG, 1))).when(short, _date(g(_SHORT, 4), g(_SHORT, 3), g(_SHORT, 1)))
    end = F.when(long, _date(g(_LONG, 5), g(_LONG, 4), g(_LONG, 3))).when(short, _date(g(_SHORT, 4), g(_SHORT, 3), g(_SHORT, 2)))
    low, c = F.lower(t), F.upper(F.trim(code))
    hint, cat, conf = F.lit(""), F.lit(""), F.lit(0.0)
    for w, target, sure in reversed(words):
        hit = low.contains(w)
        hint, cat, conf = (F.when(hit, F.lit(v)).otherwise(o) for v, o in ((w, hint), (target, cat), (float(sure), conf)))
    return df.withColumns({
        "start_date": start, "end_date": end, "discount_percent": F.regexp_extract(t, r"(\d+)\s*%", 1).try_cast("double"),
        "category_hint": hint, "category": cat, "confidence": conf,
        "line_type": F.when(c.rlike(r"^DISCOUNT\d+$"), "campaign").when((c == "DISCOUNT") & low.contains("fidelizare"), "loyalty")
        .when(c == "DISCOUNT", "discount_other").when(c.contains("VOUCHER"), "voucher").otherwise("unknown"),
    })


def discount_lines(raw: DataFrame, code: str = "item_code") -> DataFrame:
    """Accounting lines whose code starts with DISCOUNT or contains VOUCHER."""
    c = F.upper(F.trim(F.col(code)))
    return raw.where(c.startswith("DISCOUNT") | c.contains("VOUCHER"))


def promo_calendar(fields: DataFrame, order: list[str], code: str = "item_code") -> DataFrame:
    """First line of every campaign code."""
    cols = ["start_date", "end_date", "discount_percent", "category_hint", "category", "confidence"]
    first = F.min_by(F.struct(*cols), F.struct(*order)).alias("f")
    return fields.where(F.col("line_type") == "campaign").groupBy(F.col(code).alias("campaign_id")).agg(first).select("campaign_id", "f.*")


def sku_promo_weeks(weekly: DataFrame, calendar: DataFrame) -> DataFrame:
    """sku x week with promo flag and the best confidence of the category's campaigns.

    A campaign is unfolded to the Mondays it touches, so the overlap test is
    an equal join on (category, Monday) instead of a range join.
    """
    c = calendar.where(F.col("start_date").isNotNull() & (F.col("end_date") >= F.col("start_date")) & (F.col("category") != ""))
    weeks = c.select("category", "confidence", F.explode(F.sequence(
        F.date_trunc("week", F.col("start_date")).cast("date"), F.col("end_date"), F.expr("interval 7 days"))).alias("week_start"))
    best = weeks.groupBy("category", "week_start").agg(F.max("confidence").alias("confidence"))
    rows = weekly.select("sku_id", "week_start", "category").distinct()
    return rows.join(best, ["category", "week_start"], "left").select(
        "sku_id", "week_start", "category", F.coalesce((F.col("confidence") > 0).cast("int"), F.lit(0)).alias("promo_flag"),
        F.lit(1).alias("loyalty_flag"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def yearly_ratios(weekly: DataFrame, flags: DataFrame) -> DataFrame:
    """Units over the units of the same sku 364 days earlier, with the promo flag."""
    now = weekly.join(flags.select("sku_id", "week_start", "promo_flag"), ["sku_id", "week_start"], "left").fillna(0, ["promo_flag"])
    past = weekly.select("sku_id", F.date_add("week_start", 364).alias("week_start"), F.col("units").alias("prior"))
    return now.join(past, ["sku_id", "week_start"]).where(F.col("prior") != 0).select(
        "sku_id", "week_start", "category", "promo_flag", (F.col("units") / F.col("prior")).alias("ratio"))


def promo_lift(ratios: DataFrame, min_events: int = 30) -> DataFrame:
    """Mean yearly ratio in promo weeks over that of other weeks; NULL under 30 promo events."""
    on = F.col("promo_flag") == 1
    g = ratios.groupBy("category").agg(
        F.count(F.when(on, 1)).alias("promo_events"), F.count(F.when(~on, 1)).alias("non_promo_events"),
        F.avg(F.when(on, F.col("ratio"))).alias("p"), F.avg(F.when(~on, F.col("ratio"))).alias("q"))
    ok = (F.col("promo_events") >= min_events) & (F.col("q") > 0)
    return g.select("category", "promo_events", "non_promo_events", F.when(ok, F.col("p") / F.col("q")).alias("lift"))


#: Means of the Poisson draws that a count is made of, largest first.
DRAWS = (16, 8, 4, 2, 1)
#: Decimals that ratios are taken at, so that equal ones fall together.
RATIO_DIGITS = 9


def poisson_limits(mean: int) -> list[float]:
    """Upper limits of 0, 1, 2, ... for a uniform number; they go on until the next one can't be told from 1 in double precision."""
    limits, term, cum, k = [], math.exp(-mean), 0.0, 0
    while cum + term > cum or k < mean:
        cum += term
        limits.append(cum)
        k += 1
        term *= mean / k
    return limits


def poisson_draw(u: Column, mean: int) -> Column:
    """Poisson draw from a uniform number: how many limits lie at or below it."""
    return F.size(F.filter(F.array(*map(F.lit, poisson_limits(mean))), lambda limit: limit <= u))


def promo_lift_ci(ratios: DataFrame, samples: int = 1000, seed: int = 42, min_events: int = 30) -> DataFrame:
    """95 % interval of the lift by a Poisson bootstrap on sufficient statistics.

    A bootstrap draws a Poisson(1) weight for each row, and the weights of n equal
    rows add up to one Poisson(n) draw. So rows with equal category, flag and ratio
    (at nine decimals) are counted first; a count is drawn as independent draws of
    mean 16, 8, 4, 2 and 1 that add up to it, each from the first 32 bits of the MD5
    of its name. Sums per (category, resample) combine in the map tasks.
    """
    unit = 10 ** RATIO_DIGITS
    equal = ratios.groupBy("category", "promo_flag", F.round(F.col("ratio") * unit).cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    copies = F.concat(F.array_repeat(F.lit(DRAWS[0]), F.floor(F.col("n") / DRAWS[0]).cast("int")),
                      *[F.array_repeat(F.lit(m), F.floor(F.col("n") / m).cast("int") % 2) for m in DRAWS[1:]])
    parts = equal.select("category", "promo_flag", "r", F.posexplode(copies).alias("copy", "mean"))
    # a few rows become many: they are spread first, whatever their bytes
    spread = int(ratios.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = parts.repartition(spread, "r", "copy").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    name = F.concat_ws("|", F.lit(str(seed)), "category", "promo_flag", "r", "copy", "b")
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    draw = F.lit(0)
    for m in DRAWS:
        draw = F.when(F.col("mean") == m, poisson_draw(F.col("u"), m)).otherwise(draw)
    r = r.withColumn("u", u).withColumn("w", draw).where("w > 0").withColumn("ratio", F.col("r") / unit)
    on = F.col("promo_flag") == 1
    part = lambda c, x: F.sum(F.when(c, x))
    g = r.groupBy("category", "b").agg(
        (part(on, F.col("w") * F.col("ratio")) / part(on, F.col("w"))).alias("p"),
        (part(~on, F.col("w") * F.col("ratio")) / part(~on, F.col("w"))).alias("q"))
    ci = g.where(F.col("q") > 0).groupBy("category").agg(
        F.percentile(F.col("p") / F.col("q"), F.lit(0.025)).alias("ci_low"), F.percentile(F.col("p") / F.col("q"), F.lit(0.975)).alias("ci_high"))
    lift = promo_lift(ratios, min_events)
    out = lift.join(ci, "category", "left")
    keep = F.col("lift").isNotNull()
    return out.select("category", "promo_events", "non_promo_events", "lift", F.when(keep, F.col("ci_low")).alias("ci_low"),
                      F.when(keep, F.col("ci_high")).alias("ci_high"))


def campaign_values(lines: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Most frequent values of a campaign column; the first 20 are the report."""
    value = F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("(blank)"))
    g = lines.groupBy(value.alias("value")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("net_units").alias("net_units"), F.sum("net_revenue").alias("net_revenue"),
        F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"))
    return g.orderBy(F.desc("row_count"), "value").limit(k)
