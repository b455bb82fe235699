"""Classical forecasts: every method for all keys in one job, results in one long shape.

Each method returns keys, method, forecast_4w/8w, 95 % interval, weeks_of_history
and an error text when it had to fall back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stocktide.functions.calendar import calendar_weeks
from stocktide.functions.numbers import positive
from stocktide.functions.text import once
from stocktide.operators import series as se
from stocktide.operators.series import mean, median, ordinary, sample_std, tail, total

Z95 = 1.959963984540054
ALPHA = 0.15
INTERMITTENT_SHARE = 0.80
RESULT = ("method", "forecast_4w", "forecast_8w", "confidence_low_4w", "confidence_high_4w", "confidence_low_8w",
          "confidence_high_8w", "weeks_of_history", "error")
LAG_WEIGHTS = {1: 0.30, 4: 0.30, 13: 0.20, 26: 0.15, 52: 0.05}
HOLT_GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


def r1(c: Column) -> Column:
    """One decimal, half to even; the inner rounding drops the noise of the order of summing."""
    return F.bround(F.round(c, 6), 1)


def result(df: DataFrame, keys: list[str], method: str, f4: Column, f8: Column, se4: Column, se8: Column, error: Column,
           fallback: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Point, interval and error in the common shape.

    Where ``error`` is set the forecast is ``fallback`` per week (0 if None)
    with the interval from 0 to twice the forecast. The expressions become
    columns first: written out they would be computed for every result.
    """
    c, bad = F.col, F.col("_error").isNotNull()
    df = df.withColumn("_error", error).withColumns({
        **{n: F.when(~bad, e) for n, e in (("_f4", f4), ("_f8", f8), ("_e4", se4), ("_e8", se8))},
        "_fb": F.when(bad, fallback if fallback is not None else F.lit(0.0))})
    f4, f8, se4, se8, fb = c("_f4"), c("_f8"), c("_e4"), c("_e8"), c("_fb")
    pick = lambda good, poor: r1(F.when(bad, poor).otherwise(good))
    return df.select(
        *keys, F.lit(method).alias("method"), pick(f4, fb * 4).alias("forecast_4w"), pick(f8, fb * 8).alias("forecast_8w"),
        pick(positive(f4 - Z95 * se4), F.lit(0.0)).alias("confidence_low_4w"), pick(f4 + Z95 * se4, fb * 4 * 2).alias("confidence_high_4w"),
        pick(positive(f8 - Z95 * se8), F.lit(0.0)).alias("confidence_low_8w"), pick(f8 + Z95 * se8, fb * 8 * 2).alias("confidence_high_8w"),
        F.col("weeks_of_history").cast("int"), c("_error").alias("error"), *[e.alias(n) for n, e in (extra or {}).items()])


def short_history(n: int) -> Column:
    return F.when(F.col("weeks_of_history") < n, F.concat(
        F.lit("Insufficient history: "), F.col("weeks_of_history").cast("string"), F.lit(f" weeks (need {n})")))


def zero_share() -> Column:
    return F.size(F.filter("series", lambda x: x <= 0)) / F.col("weeks_of_history")


def fc_naive_seasonal(folded: DataFrame, keys: list[str]) -> DataFrame:
    """The same weeks 52 weeks earlier; needs 56 weeks."""
    s, n = F.col("series"), F.col("weeks_of_history")
    df = folded.withColumns({k: F.when(n >= 56, F.slice(s, F.greatest(n - 51, F.lit(1)), h)) for k, h in (("_m4", 4), ("_m8", 8))})
    a4, a8 = F.col("_m4"), F.col("_m8")
    return result(df, keys, "naive_seasonal", total(a4), total(a8), sample_std(a4) * F.sqrt(F.lit(4.0)), sample_std(a8) * F.sqrt(F.lit(8.0)),
                  short_history(56), mean(s))


def fc_croston_sba(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Smoothed demand size over smoothed gap for series with more than 80 % zero weeks."""
    df = folded.withColumn("zero_week_pct", zero_share()).where(F.col("zero_week_pct") > INTERMITTENT_SHARE)
    df = df.withColumn("_ev", F.filter(F.transform("series", lambda x, i: F.struct(x.alias("v"), i.alias("i"))), lambda e: e["v"] > 0))
    ev = F.col("_ev")
    start = F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("q"), F.lit(-1).alias("last"))

    def step(a, e):
        gap = (e["i"] - a["last"]).cast("double")
        return F.struct(
            F.when(a["d"].isNull(), e["v"]).otherwise(ALPHA * e["v"] + (1 - ALPHA) * a["d"]).alias("d"),
            F.when(a["q"].isNull(), gap).otherwise(ALPHA * gap + (1 - ALPHA) * a["q"]).alias("q"), e["i"].alias("last"))

    df = df.withColumn("_f", F.aggregate(ev, start, step))
    n_ev = F.size(ev)
    error = F.coalesce(short_history(8), F.when(n_ev < 3, F.concat(F.lit("Too few demand events: "), n_ev.cast("string"), F.lit(" (need 3)"))))
    rate = F.col("_f.d") / F.col("_f.q") * (1 - ALPHA / 2)
    sd = sample_std(F.transform(ev, lambda e: e["v"]))
    err = lambda h: sd * F.sqrt(F.greatest(h / F.col("_f.q"), F.lit(1.0)))
    return result(df, keys, "crostons", rate * 4, rate * 8, err(4.0), err(8.0), error)


def fc_anomaly_adjusted(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the weeks left after promo and outlier weeks are set aside, for series with at most 80 % zero weeks."""
    df = folded.where(zero_share() <= INTERMITTENT_SHARE)
    s, n = F.col("series"), F.col("weeks_of_history")
    # values of the whole series are bound outside the walk over its weeks; a column of one use would be written into it
    whole = F.struct(F.when(mean(s) < 3.0, 3.5).otherwise(2.5).alias("limit"), ordinary(s).alias("ordinary"))

    def marked(x, i, w):
        near = F.slice(s, F.greatest(i - 11, F.lit(1)), F.least(i + 1, F.lit(13)))
        week = lambda promo, outlier: F.struct(x.alias("v"), i.alias("i"), promo.alias("promo"), outlier.alias("outlier"))

        def judged(m):
            dev = F.when((i >= 3) & (m != 0), F.abs(x - m) / m)
            promo = F.coalesce((dev > w["limit"]) & (x > m), F.lit(False))
            return week(promo, F.coalesce(dev > 3.0, F.lit(False)) & ~promo)

        # a zero among values that are not negative is 1 away from their mean, in parts of it
        return F.when(w["ordinary"] & (x <= 0), week(F.lit(False), F.lit(False))).otherwise(
            once(near, lambda a: once(total(a) / F.size(a), judged)))

    df = df.withColumn("_m", once(whole, lambda w: F.transform(s, lambda x, i: marked(x, i, w))))
    df = df.withColumn("_c", F.filter("_m", lambda e: ~e["promo"] & ~e["outlier"]))
    values = lambda a: F.transform(a, lambda e: e["v"])
    clean, recent = values(F.col("_c")), values(F.filter("_c", lambda e: e["i"] >= n - 13))
    df = df.withColumns({"_clean": clean, "_base": median(clean), "_recent": F.when(F.size(recent) >= 4, median(recent))})
    base = F.col("_base")
    growth = F.when(base > 0, F.coalesce("_recent", base) / base).otherwise(1.0)
    error = F.coalesce(short_history(13), F.when(F.size("_clean") < 4, F.concat(
        F.lit("Too many anomalies: only "), F.size("_clean").cast("string"), F.lit(" clean weeks remain"))))
    sd = sample_std(F.col("_clean"))
    count = lambda f: F.size(F.filter("_m", lambda e: e[f]))
    return result(df, keys, "anomaly_adjusted", base * growth * 4, base * growth * 8, sd * F.sqrt(F.lit(4.0)), sd * F.sqrt(F.lit(8.0)), error,
                  mean(s), {"anomalies_detected": count("promo"), "outliers_detected": count("outlier")})


def fc_multi_scale_lag(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted blend of the 1/4/13/26/52-week means; the weights lean on how far the scales agree."""
    df = se.multi_scale_lags(folded)
    trend = F.col("trend_consistency")
    strong, unstable = trend.isin("STRONG_GROWTH", "STRONG_DECLINE"), trend == "UNSTABLE"
    num, den = F.lit(0.0), F.lit(0.0)
    for k, w in LAG_WEIGHTS.items():
        fast, slow = k <= 4, k >= 26
        weight = (F.when(strong, w * (1.5 if fast else 0.5 if slow else 1.0))
                  .when(unstable, w * (0.6 if fast else 1.5)).otherwise(w))
        have = F.col(f"lag_{k}w").isNotNull()
        num = num + F.when(have, F.col(f"lag_{k}w") * weight).otherwise(0.0)
        den = den + F.when(have, weight).otherwise(0.0)
    df = df.withColumns({"_w": num / den, "_sd": sample_std(F.col("series"))})
    w, sd = F.col("_w"), F.col("_sd")
    return result(df, keys, "multi_scale_lag", w * 4, w * 8, sd * F.sqrt(F.lit(4.0)), sd * F.sqrt(F.lit(8.0)), short_history(8), mean(F.col("series")),
                  {"trend_consistency": F.when(F.col("weeks_of_history") < 8, "STABLE").otherwise(trend)})


def fc_calendar_events(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Recent promo-free median x seasonal index x calendar multiplier for each of eight weeks."""
    s, n = F.col("series"), F.col("weeks_of_history")
    df = folded.withColumn("_level", mean(s))

    def stripped(x, i, w):
        lo = F.greatest(i - 5, F.lit(1))
        near = F.slice(s, lo, F.least(i + 7, n) - lo + 1)
        middle = once(near, lambda a: F.when(F.size(a) >= 3, median(a)).otherwise(w["median"]))
        return F.when(w["ordinary"] & (x <= 0), x).otherwise(once(middle, lambda m: F.when((n >= 4) & (x > m * 2.5), m).otherwise(x)))

    whole = F.struct(median(s).alias("median"), ordinary(s).alias("ordinary"))
    df = df.withColumn("_clean", once(whole, lambda w: F.transform(s, lambda x, i: stripped(x, i, w))))
    clean = F.col("_clean")
    df = df.withColumns({
        "_recent": median(tail(clean, F.least(n, F.lit(13)))), "_whole": median(clean), "_mean": mean(clean), "_sd": sample_std(clean),
        "_woy": F.transform(clean, lambda x, i: F.struct(F.weekofyear(F.date_add(F.col("first_week"), i * 7)).alias("k"), x.alias("v")))})
    df = df.withColumn("_base", F.when(F.col("_recent") > 0, F.col("_recent")).otherwise(F.col("_whole")))
    # only weeks of the year that lie ahead are unfolded
    df = df.withColumn("_next", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.weekofyear(F.date_add("last_week", k * 7))))
    df = df.withColumn("_woy", F.filter("_woy", lambda e: F.array_contains("_next", e["k"])))
    ahead = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("week_start", F.date_add("last_week", F.col("step") * 7))
    same = F.filter("_woy", lambda e: e["k"] == F.get("_next", F.col("step") - 1))
    ahead = ahead.withColumn("_same", F.transform(same, lambda e: e["v"]))
    index = F.when((n >= 26) & (F.col("_mean") != 0) & (F.size("_same") > 0), mean(F.col("_same")) / F.col("_mean")).otherwise(1.0)
    ahead = ahead.select(*keys, "weeks_of_history", "_base", "_sd", "_level", "step", "week_start", index.alias("index"))
    # one row per future calendar week
    cal = F.broadcast(calendar_weeks(ahead.select("week_start")).select("week_start", "combined_multiplier", "event_multiplier", "holiday_name"))
    ahead = ahead.join(cal, "week_start")
    value = F.col("_base") * F.col("index") * F.col("combined_multiplier")
    peak = F.when((F.col("event_multiplier") > 1) & (F.col("combined_multiplier") > 1), F.struct("combined_multiplier", -F.col("step"), "holiday_name"))
    g = ahead.groupBy(*keys).agg(
        F.sum(F.when(F.col("step") <= 4, value)).alias("f4"), F.sum(value).alias("f8"), F.first("weeks_of_history").alias("weeks_of_history"),
        F.first("_base").alias("_base"), F.first("_sd").alias("_sd"), F.first("_level").alias("_mean"),
        F.max(peak).alias("_peak"))
    error = F.coalesce(short_history(8), F.when(F.col("_base") <= 0, "Zero or negative base demand after cleaning"))
    sd = F.col("_sd")
    return result(g, keys, "calendar_events", F.col("f4"), F.col("f8"), sd * F.sqrt(F.lit(4.0)), sd * F.sqrt(F.lit(8.0)), error, F.col("_mean"),
                  {"peak_event": F.when(error.isNull(), F.col("_peak.holiday_name"))})


def fc_category_relative(weekly: DataFrame, keys: list[str], value: str = "units") -> DataFrame:
    """Category level x yearly ratio x the key's share of its category in its last four rows."""
    cat = weekly.groupBy("category", "week_start").agg(F.sum(value).alias("total"))
    point = F.struct(F.col("week_start").alias("w"), F.col("total").cast("double").alias("v"))
    level = cat.groupBy("category").agg(F.sort_array(F.collect_list(point)).alias("p")).select(
        "category", F.transform("p", lambda e: e["v"]).alias("a"))
    a, n = F.col("a"), F.size("a")
    back = lambda arr, size, whole: F.when(size >= 56, total(F.slice(arr, F.greatest(size - 55, F.lit(1)), 4)) / 4).otherwise(whole)
    recent = mean(tail(a, F.least(n, F.lit(4))))
    year = back(a, n, mean(tail(a, F.least(n, F.lit(52)))))
    level = level.select("category", n.alias("cat_weeks"), recent.alias("cat_recent"),
                         F.when(year > 0, recent / year).otherwise(1.0).alias("cat_ratio"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("week_start")))
    ranked = weekly.withColumn("_r", rank)
    last = ranked.where(F.col("_r") <= 4).join(cat, ["category", "week_start"])
    share = last.groupBy(*keys).agg(F.sum(value).alias("mine"), F.sum("total").alias("all"))
    own = lambda low, high: F.avg(F.when(F.col("_r").between(low, high), F.col(value)))
    levels = ranked.groupBy(*keys).agg(own(1, 4).alias("own_recent"), F.when(F.count(F.lit(1)) >= 56, own(53, 56)).otherwise(F.avg(value)).alias("own_year"))
    rows = weekly.groupBy(*keys).agg(
        F.max_by("category", "week_start").alias("category"), F.count(F.lit(1)).cast("int").alias("weeks_of_history"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    df = rows.join(share, keys).join(levels, keys).join(level, "category")
    error = F.coalesce(
        F.when(F.col("cat_weeks") < 8, F.concat(F.lit("Category: insufficient history ("), F.col("cat_weeks").cast("string"), F.lit(" weeks, need 8)"))),
        F.when(F.col("weeks_of_history") < 8, F.concat(F.lit("Insufficient SKU history: "), F.col("weeks_of_history").cast("string"), F.lit(" weeks (need 8)"))))
    ratio = F.col("cat_ratio")
    part = F.when(F.col("all") > 0, F.col("mine") / F.col("all")).otherwise(0.0)
    weekly_level = F.col("cat_recent") * ratio * part
    expected = F.col("own_year") * ratio
    against = F.when(expected > 0, F.col("own_recent") / expected).otherwise(1.0)
    told = lambda c, digits: F.when(error.isNotNull(), 0.0).otherwise(F.round(c + 1e-9, digits))
    return result(df, keys, "category_relative", weekly_level * 4, weekly_level * 8, F.col("sd") * F.sqrt(F.lit(4.0)), F.col("sd") * F.sqrt(F.lit(8.0)), error,
                  None, {"category_trend": F.when(error.isNotNull(), "STABLE").when(ratio > 1.03, "GROWING").when(ratio < 0.97, "DECLINING").otherwise("STABLE"),
                         "category_forecast_4w": told(F.col("cat_recent") * ratio * 4, 1), "category_forecast_8w": told(F.col("cat_recent") * ratio * 8, 1),
                         "sku_share_of_category": told(part, 4), "sku_performance_vs_category": told(against, 3), "category_yoy_ratio": told(ratio, 3)})


def holt_fits(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared one-step error, level and trend of each series under its best pair of rates; all series and pairs advance week by week."""
    size = np.array([len(s) for s in series])
    order = np.argsort(-size, kind="stable")  # the series that go on are always the first ones
    values = np.zeros((len(series), int(size.max(initial=1))))
    for row, k in enumerate(order.tolist()):
        values[row, :size[k]] = series[k]
    alpha, beta = (np.array(g) for g in zip(*[(a, b) for a in HOLT_GRID for b in HOLT_GRID]))
    level = np.repeat(values[:, :1], len(alpha), axis=1)
    second = values[:, 1] if values.shape[1] > 1 else values[:, 0]
    trend = np.repeat(np.where(size[order] > 1, second - values[:, 0], 0.0)[:, None], len(alpha), axis=1)
    error = np.zeros_like(level)
    for week in range(1, values.shape[1]):
        n = int(np.searchsorted(-size[order], -week, side="left"))
        forecast, x = level[:n] + trend[:n], values[:n, week:week + 1]
        now = alpha * x + (1 - alpha) * forecast
        trend[:n] = beta * (now - level[:n]) + (1 - beta) * trend[:n]
        level[:n] = now
        error[:n] += (x - forecast) * (x - forecast)
    best = error.argmin(axis=1)
    back = np.argsort(order)
    return tuple(v[np.arange(len(best)), best][back] for v in (error, level, trend))


def _with_holt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        series = [np.asarray(s or [0.0], float) for s in b.column("series").to_pylist()]
        fits = holt_fits(series) if series else (np.empty(0),) * 3
        names = ("holt_error", "holt_level", "holt_trend")
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, fits)], names=[*b.schema.names, *names])


def fc_holt_trend(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Holt linear trend; the two smoothing rates are the grid pair with the least squared one-step error."""
    s = F.col("series")
    schema = StructType([*folded.schema.fields, *[StructField(n, DoubleType()) for n in ("holt_error", "holt_level", "holt_trend")]])
    df = folded.mapInArrow(_with_holt, schema)
    level, t = F.col("holt_level"), F.col("holt_trend")
    ahead = lambda h: F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.lit(0.0), lambda acc, k: acc + positive(level + t * k))
    sd = F.sqrt(F.col("holt_error") / F.greatest(F.size(s) - 1, F.lit(1)))
    return result(df, keys, "holt_trend", ahead(4), ahead(8), sd * F.sqrt(F.lit(4.0)), sd * F.sqrt(F.lit(8.0)), short_history(52), mean(s),
                  {"trend": F.when(t > 0.5, "GROWING").when(t < -0.5, "DECLINING").otherwise("STABLE")})


# ---- combining ----------------------------------------------------------------
def common(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *RESULT)


def bias_correct(results: DataFrame, bias: DataFrame) -> DataFrame:
    """value / (1 + bias), not below 0, for rows without error; ``bias`` (method, bias_capped) has one row per method."""
    out = results.join(F.broadcast(bias.select("method", F.col("bias_capped").alias("_b"))), "method", "left")
    use = F.col("error").isNull() & F.col("_b").isNotNull() & (F.col("_b") != 0) & (F.abs(1 + F.col("_b")) >= 1e-6)
    cols = [c for c in RESULT if c.startswith(("forecast", "confidence"))]
    return out.withColumns({c: F.when(use, positive(F.col(c) / (1 + F.col("_b")))).otherwise(F.col(c)) for c in cols}).drop("_b").select(*results.columns)


def category_method_routing(results: DataFrame, categories: DataFrame, not_allowed: DataFrame) -> DataFrame:
    """Drop (category, method) pairs named in the rule table ``not_allowed``; it has one row per rule."""
    key = [c for c in results.columns if c in categories.columns]
    out = results.join(categories, key, "left")
    return out.join(F.broadcast(not_allowed.select("category", "method")), ["category", "method"], "left_anti").select(*results.columns)


def disagreement(values: Column) -> Column:
    """LOW / MEDIUM / HIGH by the sample variation of the methods."""
    m = mean(values)
    cv = sample_std(values) / F.when(m != 0, m)
    return F.when((F.size(values) < 2) | (m == 0), "LOW").when(cv < 0.15, "LOW").when(cv < 0.30, "MEDIUM").otherwise("HIGH")


def ensemble_combine(results: DataFrame, keys: list[str], aggregation: str = "median", weights: DataFrame | None = None) -> DataFrame:
    """One forecast per key over the methods that succeeded.

    aggregation: median, trimmed_mean (without the lowest and highest; median
    under three), equal_weight or weighted (weighted median; ``weights`` has
    one row per method). A key has at most one row per method.
    """
    if aggregation not in ("median", "trimmed_mean", "equal_weight", "weighted"):
        raise ValueError(f"unknown aggregation {aggregation}")
    df = results.withColumn("weight", F.lit(1.0))
    if aggregation == "weighted":
        if weights is None:
            raise ValueError("weighted needs weights")
        df = results.join(F.broadcast(weights.select("method", "weight")), "method", "left").fillna(0.0, ["weight"])
    ok = F.col("error").isNull()
    pair = lambda c: F.sort_array(F.collect_list(F.when(ok, F.struct(F.col(c).alias("v"), F.col("weight").alias("w")))))
    g = df.groupBy(*keys).agg(
        pair("forecast_4w").alias("p4"), pair("forecast_8w").alias("p8"),
        *[F.coalesce(f(F.when(ok, F.col(c))), F.lit(0.0)).alias(c) for f, c in (
            (F.min, "confidence_low_4w"), (F.max, "confidence_high_4w"), (F.min, "confidence_low_8w"), (F.max, "confidence_high_8w"))],
        F.count(F.when(ok, 1)).alias("methods_succeeded"), F.count(F.when(~ok, 1)).alias("methods_failed"))
    values = lambda p: F.transform(p, lambda e: e["v"])

    def combine(p: Column) -> Column:
        v = values(p)
        if aggregation == "median":
            out = median(v)
        elif aggregation == "trimmed_mean":
            out = F.when(F.size(v) < 3, median(v)).otherwise(mean(F.slice(v, 2, F.greatest(F.size(v) - 2, F.lit(0)))))
        elif aggregation == "equal_weight":
            out = mean(v)
        else:
            out = weighted_median(p)
        return F.coalesce(out, F.lit(0.0))

    return g.select(
        *keys, r1(combine(F.col("p4"))).alias("forecast_4w"), r1(combine(F.col("p8"))).alias("forecast_8w"),
        *[r1(F.col(c)).alias(c) for c in ("confidence_low_4w", "confidence_high_4w", "confidence_low_8w", "confidence_high_8w")],
        "methods_succeeded", "methods_failed", disagreement(values(F.col("p4"))).alias("method_disagreement_4w"),
        disagreement(values(F.col("p8"))).alias("method_disagreement_8w"), F.lit(aggregation).alias("aggregation_method"))


def weighted_median(pairs: Column) -> Column:
    """Value at which the running weight reaches half; halfway to the one before when it starts exactly there."""
    used = F.filter(pairs, lambda e: e["w"] > 0)
    half = F.aggregate(used, F.lit(0.0), lambda s, e: s + e["w"]) / 2
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("c"), none.alias("prev"), none.alias("out"))

    def step(a, e):
        c = a["c"] + e["w"]
        hit = F.when(a["prev"].isNotNull() & (F.abs(a["c"] - half) < 1e-12), (a["prev"] + e["v"]) / 2).otherwise(e["v"])
        return F.struct(c.alias("c"), e["v"].alias("prev"), F.when(a["out"].isNotNull(), a["out"]).when(c >= half, hit).alias("out"))

    return F.when(F.size(used) > 0, F.aggregate(used, start, step)["out"]).otherwise(median(F.transform(pairs, lambda e: e["v"])))


def silent_zero_forecasts(silent: DataFrame, keys: list[str]) -> DataFrame:
    """Silent keys as explicit zero forecasts."""
    zero = [c for c in RESULT if c.startswith(("forecast", "confidence"))]
    return silent.select(*keys, *[F.lit(0.0).alias(c) for c in zero], F.lit(0).cast("long").alias("methods_succeeded"),
                         F.lit(0).cast("long").alias("methods_failed"), F.lit("LOW").alias("method_disagreement_4w"),
                         F.lit("LOW").alias("method_disagreement_8w"), F.lit("silent").alias("aggregation_method"))


def monthly_profiles(weekly: DataFrame, keys: list[str], value: str = "units") -> DataFrame:
    """Monthly multipliers (array of 12, clip 0.20-3.0), their variation and the seasonal flag."""
    per = weekly.groupBy(*keys, F.month("week_start").alias("m")).agg(F.sum(value).alias("s"))
    g = per.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("m", "s"))).alias("by_month"), F.avg("s").alias("avg"), F.count(F.lit(1)).alias("months_observed"))
    usable = (F.col("months_observed") >= 6) & (F.col("avg") != 0)
    share = lambda m: F.coalesce(F.least(F.lit(3.0), F.greatest(F.lit(0.2), F.col("by_month")[m] / F.col("avg"))), F.lit(1.0))
    g = g.withColumn("multipliers", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.when(usable, share(m)).otherwise(1.0)))
    g = g.withColumn("seasonal_cv", F.when(usable, sample_std(F.col("multipliers")) / mean(F.col("multipliers"))).otherwise(0.0))
    return g.select(*keys, "multipliers", "seasonal_cv", "months_observed", (F.col("seasonal_cv") > 0.5).cast("int").alias("is_seasonal"))


def seasonal_dampen(ensemble: DataFrame, weekly: DataFrame, keys: list[str], value: str = "units") -> DataFrame:
    """Multiply the forecasts of seasonal keys by the mean monthly multiplier of the weeks ahead."""
    prof = monthly_profiles(weekly, keys, value).withColumn("_last", weekly.agg(F.max("week_start")).scalar())
    ahead = lambda h: mean(F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.element_at("multipliers", F.month(F.date_add(F.col("_last"), k * 7)))))
    prof = prof.select(*keys, "is_seasonal", "seasonal_cv", ahead(4).alias("_x4"), ahead(8).alias("_x8"))
    out = ensemble.join(prof, keys, "left")
    on = F.coalesce(F.col("is_seasonal") == 1, F.lit(False))
    cols = [c for c in ensemble.columns if c.startswith(("forecast", "confidence"))]
    return out.select(
        *[F.when(on, r1(F.col(c) * F.col("_x4" if c.endswith("4w") else "_x8"))).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
          for c in ensemble.columns],
        on.cast("int").alias("seasonal_dampening_applied"), F.when(on, F.round(F.round("_x4", 6), 3)).alias("seasonal_multiplier_4w"),
        F.when(on, F.round(F.round("_x8", 6), 3)).alias("seasonal_multiplier_8w"))


def all_methods(weekly: DataFrame, keys: list[str], folded: DataFrame) -> DataFrame:
    """Long results of every classical method; ``folded`` should be written once as it is read five times."""
    parts = [fc_naive_seasonal(folded, keys), fc_croston_sba(folded, keys), fc_anomaly_adjusted(folded, keys),
             fc_multi_scale_lag(folded, keys), fc_calendar_events(folded, keys), fc_category_relative(weekly, keys)]
    out = common(parts[0], keys)
    for p in parts[1:]:
        out = out.unionByName(common(p, keys))
    return out


def forecast_by_category(results: DataFrame, categories: DataFrame, keys: list[str]) -> DataFrame:
    return results.join(categories, keys)


def method_comparison(results: DataFrame, method: str) -> DataFrame:
    """One method over all keys: succeeded ones by forecast, then the failed ones."""
    return results.where(F.col("method") == method).withColumn("failed", F.col("error").isNotNull().cast("int"))


def refresh_summary(ensemble: DataFrame) -> DataFrame:
    return ensemble.agg(
        F.count(F.lit(1)).alias("keys_forecast"), F.count(F.when(F.col("methods_succeeded") >= 1, 1)).alias("keys_with_method"),
        F.count(F.when(F.col("methods_succeeded") == 0, 1)).alias("keys_without_method"))


def export_wide(results: DataFrame, ensemble: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """One wide row per key: the ensemble beside each method's forecasts and error."""
    one = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}")
    wide = results.groupBy(*keys).agg(*[one(m, c) for m in methods for c in ("forecast_4w", "forecast_8w", "error")])
    return ensemble.join(wide, keys, "left")
