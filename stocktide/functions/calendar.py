"""Retail calendar: weeks, campaign windows, holidays, pay days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.text import MONTH_NAMES, month_number, strip_accents

# Published campaign windows, both ends included.
KNOWN_BF_WINDOWS = {
    2022: ("2022-11-09", "2022-11-20"),
    2023: ("2023-11-06", "2023-11-19"),
    2024: ("2024-11-04", "2024-11-24"),
    2025: ("2025-11-03", "2025-11-23"),
}
# Event -> (demand multiplier, days before, days after).
EVENTS = {
    "orthodox_easter": (1.40, 7, 2),
    "christmas": (1.60, 14, 7),
    "black_friday": (1.35, 3, 3),
    "womens_day": (1.25, 5, 1),
    "national_day": (1.20, 3, 1),
    "new_year": (1.15, 3, 2),
    "labour_day": (1.05, 1, 1),
    "easter_monday": (1.20, 0, 1),
    "rusalii": (1.10, 1, 1),
}
# Holidays with a fixed date (name, month, day, event or none).
FIXED_HOLIDAYS = (
    ("New Year's Day", 1, 1, "new_year"),
    ("New Year (Day 2)", 1, 2, "new_year"),
    ("Unification Day", 1, 24, ""),
    ("Women's Day", 3, 8, "womens_day"),
    ("Labour Day", 5, 1, "labour_day"),
    ("Children's Day", 6, 1, ""),
    ("Assumption of Mary", 8, 15, ""),
    ("St. Andrew's Day", 11, 30, ""),
    ("National Day", 12, 1, "national_day"),
    ("Christmas Day", 12, 25, "christmas"),
    ("Christmas (Day 2)", 12, 26, "christmas"),
)
# Holidays counted from Easter Sunday (name, days, event).
EASTER_HOLIDAYS = (
    ("Good Friday", -2, "orthodox_easter"),
    ("Orthodox Easter", 0, "orthodox_easter"),
    ("Easter Monday", 1, "easter_monday"),
    ("Rusalii (Pentecost Saturday)", 49, "rusalii"),
    ("Rusalii (Pentecost Sunday)", 50, "rusalii"),
)
BUILDING_MONTHS, BUILDING_FACTOR = (4, 5, 6, 7, 8, 9), 1.15
LULL_MONTHS, LULL_FACTOR = (7, 8), 0.80
PAY_DAYS, PAY_REACH, PAY_FACTOR = (10, 25), 2, 1.10


def week_start(d: Column) -> Column:
    """Monday of the week of ``d``."""
    return F.date_trunc("week", d).cast("date")


def week_start_shifted(d: Column) -> Column:
    """Older weekly rule under which a Monday sale falls into the week before."""
    return F.date_sub(F.next_day(F.date_sub(d, 1), "MON"), 7)


def last_friday_of_november(year: Column) -> Column:
    return F.next_day(F.make_date(year, F.lit(11), F.lit(23)), "FRI")


def _known(year: Column, side: int, fallback: Column) -> Column:
    c = fallback
    for y, w in KNOWN_BF_WINDOWS.items():
        c = F.when(year == y, F.lit(w[side]).cast("date")).otherwise(c)
    return c


def bf_window_signal(year: Column) -> tuple[Column, Column]:
    """First and last day; unknown years: last Friday of November -4 .. +2."""
    f = last_friday_of_november(year)
    return _known(year, 0, F.date_sub(f, 4)), _known(year, 1, F.date_add(f, 2))


def bf_window_feature(year: Column) -> tuple[Column, Column]:
    """First and last day; unknown years: 3 to 23 November."""
    return (
        _known(year, 0, F.make_date(year, F.lit(11), F.lit(3))),
        _known(year, 1, F.make_date(year, F.lit(11), F.lit(23))),
    )


def parse_campaign_window(text: Column, sale_year: Column) -> tuple[Column, Column]:
    """'[03-23 NOIEMBRIE]' -> (start, end) in the smallest year named, else the sale year."""
    pattern = r"\[(\d{1,2})\s*-\s*(\d{1,2})\s+([^\]]+)\]"
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    year = F.coalesce(F.array_min(years), sale_year)
    word = F.regexp_extract(strip_accents(F.regexp_extract(text, pattern, 3)), "([A-Z]+)", 1)
    month = month_number(word)
    iso = [
        F.format_string("%04d-%02d-%02d", year, month, F.regexp_extract(text, pattern, g).try_cast("int"))
        for g in (1, 2)
    ]
    ok = (month > 0) & F.regexp_like(text, F.lit(pattern))
    start, end = (F.when(ok, F.try_to_date(i, "yyyy-MM-dd")) for i in iso)
    whole = start.isNotNull() & end.isNotNull()
    return F.when(whole, start), F.when(whole, end)


def overlap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Days shared by [s1, e1) and [s2, e2)."""
    return F.greatest(F.lit(0), F.datediff(F.least(e1, e2), F.greatest(s1, s2)))


def target_calendar(t: Column) -> dict[str, Column]:
    """Calendar features of a 28-day target that starts on ``t``."""
    s, last = bf_window_feature(F.year(t))
    e, h = F.date_add(last, 1), F.date_add(t, 28)
    pre, post = F.date_sub(s, 28), F.date_add(e, 28)
    d = {
        "target_month": F.month(t),
        "target_quarter": F.quarter(t),
        "target_weekofyear": F.weekofyear(t),
        "target_is_q4": (F.quarter(t) == 4),
        "target_is_black_friday_month": (F.month(t) == 11),
        "target_is_bf_window": (t >= s) & (t < e),
        "target_is_pre_bf_4w": (t >= pre) & (t < s),
        "target_is_post_bf_4w": (t >= e) & (t < post),
        "target_days_from_bf_start": F.datediff(t, s),
        "target_days_from_bf_end": F.datediff(t, last),
        "horizon_bf_overlap_days": overlap_days(t, h, s, e),
        "horizon_pre_bf_overlap_days": overlap_days(t, h, pre, s),
        "horizon_post_bf_overlap_days": overlap_days(t, h, e, post),
    }
    return {k: v.cast("double") for k, v in d.items()}


def non_bf_calendar_weeks(t: Column, weeks: int) -> Column:
    """How many of the ``weeks`` weeks before ``t`` do not touch a campaign window."""
    starts = F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda k: F.date_sub(t, k * 7))

    def outside(w: Column) -> Column:
        s, last = bf_window_feature(F.year(w))
        return (F.date_add(w, 7) <= s) | (w > last)

    return F.size(F.filter(starts, outside)).cast("double")


def previous_months(t: Column, months: int = 6) -> Column:
    """The completed months before ``t``, newest first."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(months)), lambda k: F.add_months(F.trunc(t, "MM"), -k)
    )


def orthodox_easter(year: Column) -> Column:
    """Julian computus moved to the Gregorian calendar."""
    d = (year % 19 * 19 + 15) % 30
    e = (year % 4 * 2 + year % 7 * 4 - d + 34) % 7
    n = d + e + 114
    julian = F.make_date(year, F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))
    shift = F.when(year < 2100, 13).when(year < 2200, 14).otherwise(15)
    return F.date_add(julian, shift.cast("int"))


def holiday_dim(years: DataFrame, year: str = "year") -> DataFrame:
    """17 dated entries for every row of ``years``."""
    y = F.col(year)
    entries = [
        F.struct(F.make_date(y, F.lit(m), F.lit(d)).alias("holiday_date"), F.lit(n).alias("holiday_name"),
                 F.lit(k).alias("event_key"))
        for n, m, d, k in FIXED_HOLIDAYS
    ]
    entries += [
        F.struct(F.date_add(orthodox_easter(y), off).alias("holiday_date"), F.lit(n).alias("holiday_name"),
                 F.lit(k).alias("event_key"))
        for n, off, k in EASTER_HOLIDAYS
    ]
    entries.append(F.struct(last_friday_of_november(y).alias("holiday_date"), F.lit("Black Friday").alias("holiday_name"),
                            F.lit("black_friday").alias("event_key")))
    return years.select(y, F.inline(F.array(*entries)))


def event_attribute(key: Column, which: int) -> Column:
    """Multiplier (0), days before (1) or days after (2) of an event."""
    c = F.lit(1.0) if which == 0 else F.lit(0)
    for k, v in EVENTS.items():
        c = F.when(key == k, F.lit(v[which])).otherwise(c)
    return c


def season_multiplier(d: Column) -> Column:
    m = F.month(d)
    return (F.when(m.isin(*BUILDING_MONTHS), BUILDING_FACTOR).otherwise(1.0)
            * F.when(m.isin(*LULL_MONTHS), LULL_FACTOR).otherwise(1.0))


def is_pay_period(d: Column) -> Column:
    hit = F.lit(False)
    for p in PAY_DAYS:
        hit = hit | (F.abs(F.dayofmonth(d) - p) <= PAY_REACH)
    return hit


def calendar_days(dates: DataFrame, date: str = "date") -> DataFrame:
    """Calendar features for every distinct date of ``dates``.

    The table is one row per calendar day, so it stays small whatever the
    facts hold. Influence windows are unfolded to days and met with an equal
    join, so there is no range join.
    """
    days = dates.select(F.col(date).alias("date")).where(F.col(date).isNotNull()).distinct()
    years = days.select(F.explode(F.sequence(F.year("date") - 1, F.year("date") + 1)).alias("year")).distinct()
    hol = holiday_dim(years)
    k = F.col("event_key")
    reach = hol.where(k != "").select(
        F.explode(F.sequence(
            F.date_sub("holiday_date", event_attribute(k, 1)), F.date_add("holiday_date", event_attribute(k, 2)))).alias("date"),
        event_attribute(k, 0).alias("m"), "holiday_name", "holiday_date",
    )
    best = reach.groupBy("date").agg(
        F.max("m").alias("event_multiplier"),
        F.min_by("holiday_name", F.struct(-F.col("m"), "holiday_date", "holiday_name")).alias("holiday_name"),
    )
    d = F.col("date")
    out = days.join(best, "date", "left").withColumn("event_multiplier", F.coalesce("event_multiplier", F.lit(1.0)))
    pay = is_pay_period(d)
    return out.select(
        "date", (F.col("event_multiplier") > 1).cast("int").alias("is_holiday"), "holiday_name", "event_multiplier",
        F.month(d).isin(*BUILDING_MONTHS).cast("int").alias("is_building_season"),
        F.month(d).isin(*LULL_MONTHS).cast("int").alias("is_summer_lull"),
        pay.cast("int").alias("is_pay_period"),
        season_multiplier(d).alias("season_multiplier"),
        F.when(pay, PAY_FACTOR).otherwise(1.0).alias("pay_multiplier"),
    ).withColumn(
        "combined_multiplier",
        F.round(F.col("event_multiplier") * F.col("season_multiplier") * F.col("pay_multiplier"), 4),
    )


def calendar_weeks(weeks: DataFrame, week: str = "week_start") -> DataFrame:
    """Calendar features per Monday: strongest event of 7 days, season and pay of Thursday."""
    mondays = weeks.select(F.col(week).alias("week_start")).where(F.col(week).isNotNull()).distinct()
    days = mondays.select("week_start", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(F.col("week_start"), i))).alias("date"))
    feat = days.join(calendar_days(days), "date")
    mid = F.datediff("date", "week_start") == 3
    out = feat.groupBy("week_start").agg(
        F.max("event_multiplier").alias("event_multiplier"),
        F.min_by("holiday_name", F.struct(-F.col("event_multiplier"), "date")).alias("holiday_name"),
        F.max(F.when(mid, F.col("season_multiplier"))).alias("season_multiplier"),
        F.max(F.when(mid, F.col("pay_multiplier"))).alias("pay_multiplier"),
        F.max("is_pay_period").alias("is_pay_period"),
    )
    return out.withColumn(
        "combined_multiplier",
        F.round(F.col("event_multiplier") * F.col("season_multiplier") * F.col("pay_multiplier"), 4),
    )


def mondays(first: str, count: int, step_weeks: int = 4) -> list[dt.date]:
    """``count`` target starts, ``step_weeks`` apart; the first must be a Monday."""
    d = dt.date.fromisoformat(first)
    if d.weekday() != 0:
        raise ValueError(f"{first} is not a Monday")
    return [d + dt.timedelta(weeks=step_weeks * i) for i in range(count)]


