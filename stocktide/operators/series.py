"""Ordered-series operators. A series is one key's weekly rows, at most one per week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions.text import once


def ordered(keys: list[str], lo: int | None = None, hi: int = 0):
    w = Window.partitionBy(*keys).orderBy("week_start")
    return w if lo is None else w.rowsBetween(lo, hi)


def fold_series(weekly: DataFrame, keys: list[str], value: str = "units") -> DataFrame:
    """One row per key: first and last week and the dense array of weekly values.

    Missing weeks become 0. A series is as long as the calendar it spans, so
    the array is bounded by the weeks in the data however many lines a key has.
    The rows are spread with a fixed partition count: what follows is heavy on
    CPU and light on bytes, so partitions must not be merged by size.
    """
    n = int(weekly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    point = F.struct(F.col("week_start").alias("w"), F.col(value).cast("double").alias("v"))
    g = weekly.repartition(n, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("p"))
    gap = lambda e, i: F.coalesce((F.datediff(F.get("p", i + 1)["w"], e["w"]) / 7).cast("int") - 1, F.lit(0))
    dense = F.flatten(F.transform("p", lambda e, i: F.concat(F.array(e["v"]), F.array_repeat(F.lit(0.0), gap(e, i)))))
    return g.select(
        *keys, F.col("p")[0]["w"].alias("first_week"), F.element_at("p", -1)["w"].alias("last_week"), dense.alias("series"),
    ).withColumn("weeks_of_history", F.size("series"))


def dense_weekly_grid(weekly: DataFrame, keys: list[str], value: str = "units") -> DataFrame:
    """Every Monday between the first and last week of a key, missing weeks 0."""
    f = fold_series(weekly, keys, value)
    return f.select(*keys, "first_week", F.posexplode("series").alias("pos", value)).select(
        *keys, F.date_add("first_week", F.col("pos") * 7).alias("week_start"), value)


def promo_spikes(weekly: DataFrame, keys: list[str], value: str = "units", threshold: float = 2.5, window: int = 13) -> DataFrame:
    """Rows above 2.5 times the trailing 13-row mean, the row itself included."""
    mean = F.avg(value).over(ordered(keys, -(window - 1)))
    return weekly.withColumn("is_promotional_week", (F.col(value) > mean * threshold).cast("int"))


def stockout_runs(weekly: DataFrame, keys: list[str], value: str = "units", min_weeks: int = 2) -> DataFrame:
    """Rows that belong to a run of at least two zero rows."""
    zero = (F.col(value) == 0).cast("int")
    out = weekly.withColumn("_z", zero)
    out = out.withColumn("_run", F.row_number().over(ordered(keys)) - F.row_number().over(
        Window.partitionBy(*keys, "_z").orderBy("week_start")))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_z", "_run"))
    return out.withColumn("is_stockout_week", ((F.col("_z") == 1) & (size >= min_weeks)).cast("int")).drop("_z", "_run")


def lag_features(weekly: DataFrame, keys: list[str], value: str = "units") -> DataFrame:
    """Lags, shifted rolling means, yearly ratio, momentum, age and expanding variation."""
    w, v = ordered(keys), F.col(value)
    out = weekly.withColumns({
        **{f"sales_lag_{k}w": F.lag(v, k).over(w) for k in (1, 2, 4, 13, 26, 52)},
        "rolling_avg_4w": F.avg(v).over(ordered(keys, -4, -1)),
        "rolling_avg_13w": F.avg(v).over(ordered(keys, -13, -1)),
        "_first": F.min("week_start").over(Window.partitionBy(*keys)),
        "_n": F.count(v).over(ordered(keys, Window.unboundedPreceding)),
        "_sd": F.stddev_samp(v).over(ordered(keys, Window.unboundedPreceding)),
        "_mean": F.avg(v).over(ordered(keys, Window.unboundedPreceding)),
    })
    c = F.col
    some = lambda x: F.when(x != 0, x)
    return out.withColumns({
        "yoy_growth_ratio": c("rolling_avg_4w") / some(c("sales_lag_52w")),
        "trend_momentum": (c("rolling_avg_4w") - c("rolling_avg_13w")) / some(c("rolling_avg_13w")),
        "product_age_weeks": (F.datediff("week_start", "_first") / 7).cast("int"),
        "is_mature": (F.datediff("week_start", "_first") > 52 * 7).cast("int"),
        "historical_volatility": F.when(c("_n") >= 4, c("_sd") / some(c("_mean"))),
        "week_of_year": F.weekofyear("week_start"), "month": F.month("week_start"),
    }).drop("_first", "_n", "_sd", "_mean")


def weeks_since_promo(weekly: DataFrame, keys: list[str], promo: str = "is_promotional_week") -> DataFrame:
    """Rows since the last promo row; NULL before the first one."""
    w = ordered(keys)
    out = weekly.withColumn("_rn", F.row_number().over(w))
    last = F.last(F.when(F.col(promo) == 1, F.col("_rn")), ignorenulls=True).over(ordered(keys, Window.unboundedPreceding))
    return out.withColumn("weeks_since_last_promo", F.col("_rn") - last).drop("_rn")


def category_features(weekly: DataFrame, value: str = "units") -> DataFrame:
    """Category lag, 4-to-52-row ratio and the key's share of its category week."""
    cat = weekly.groupBy("category", "week_start").agg(F.sum(value).alias("_total"))
    k = ["category"]
    long = F.when(F.count("_total").over(ordered(k, -52, -1)) >= 4, F.avg("_total").over(ordered(k, -52, -1)))
    cat = cat.select(
        "category", "week_start", "_total", F.lag("_total").over(ordered(k)).alias("category_sales_lag_1w"),
        (F.avg("_total").over(ordered(k, -4, -1)) / F.when(long != 0, long)).alias("category_yoy_ratio"))
    out = weekly.join(cat, ["category", "week_start"], "left")
    return out.withColumn("sku_share_of_category_pct", F.col(value) / F.when(F.col("_total") != 0, F.col("_total"))).drop("_total")


def strip_promo_weeks(grid: DataFrame, keys: list[str], value: str = "units", threshold: float = 2.5) -> DataFrame:
    """Replace rows above 2.5 times the centred 13-row median by that median."""
    near = ordered(keys, -6, 6)
    whole = Window.partitionBy(*keys)
    med = F.when(F.count(value).over(near) >= 3, F.percentile(value, F.lit(0.5)).over(near)).otherwise(
        F.percentile(value, F.lit(0.5)).over(whole))
    long = F.count(F.lit(1)).over(whole) >= 4
    out = grid.withColumn("_med", med).withColumn("_long", long)
    return out.withColumn("clean_units", F.when(F.col("_long") & (F.col(value) > F.col("_med") * threshold), F.col("_med"))
                          .otherwise(F.col(value))).drop("_med", "_long")


def seasonal_index(weekly: DataFrame, keys: list[str], value: str = "units", min_weeks: int = 26) -> DataFrame:
    """Mean of an ISO week over the key's mean for weeks 1-53; neutral 1.0 where history is short, zero or missing."""
    per = weekly.groupBy(*keys, F.weekofyear("week_start").alias("week_of_year")).agg(
        F.sum(value).alias("s"), F.count(F.lit(1)).alias("sample_weeks"))
    g = per.groupBy(*keys).agg(
        F.sum("s").alias("total"), F.sum("sample_weeks").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("week_of_year", F.struct("s", "sample_weeks")))).alias("m"))
    out = g.select(*keys, "total", "n", F.explode(F.sequence(F.lit(1), F.lit(53))).alias("week_of_year"), "m").withColumn(
        "_e", F.col("m")[F.col("week_of_year")])
    ok = (F.col("n") >= min_weeks) & (F.col("total") != 0) & F.col("_e").isNotNull()
    avg = F.col("_e.s") / F.col("_e.sample_weeks")
    return out.select(
        *keys, "week_of_year", F.when(ok, avg / (F.col("total") / F.col("n"))).otherwise(1.0).alias("seasonal_index"),
        F.when(ok, F.col("_e.sample_weeks")).otherwise(0).alias("sample_weeks"),
        F.when(ok, avg).otherwise(0.0).alias("avg_weekly_sales"))


def anomaly_flags(grid: DataFrame, keys: list[str], value: str = "units") -> DataFrame:
    """promo / outlier flags against the trailing 13-row mean (at least four rows)."""
    near, whole = ordered(keys, -12), Window.partitionBy(*keys)
    mean = F.when(F.count(value).over(near) >= 4, F.avg(value).over(near))
    out = grid.withColumns({"_m": F.when(mean != 0, mean), "_t": F.when(F.avg(value).over(whole) < 3.0, 3.5).otherwise(2.5)})
    dev = F.abs(F.col(value) - F.col("_m")) / F.col("_m")
    promo = F.coalesce((dev > F.col("_t")) & (F.col(value) > F.col("_m")), F.lit(False))
    return out.withColumns({
        "is_promo": promo.cast("int"), "is_outlier": (F.coalesce(dev > 3.0, F.lit(False)) & ~promo).cast("int"),
    }).drop("_m", "_t")


def recency_split(weekly: DataFrame, keys: list[str], value: str = "units", weeks: int = 10) -> tuple[DataFrame, DataFrame]:
    """(active rows, silent keys): silent when nothing was sold in the last ten weeks of the data."""
    marked = weekly.withColumn("_last", weekly.agg(F.max("week_start")).scalar())
    g = marked.groupBy(*keys).agg(F.coalesce(F.sum(
        F.when(F.datediff("_last", "week_start") < 7 * weeks, F.col(value))), F.lit(0.0)).alias("_recent"))
    silent = g.where(F.col("_recent") <= 0).select(*keys)
    active = g.where(F.col("_recent") > 0).select(*keys)
    return weekly.join(active, keys, "left_semi"), silent


def multi_scale_lags(folded: DataFrame) -> DataFrame:
    """Mean of the last 1/4/13/26/52 weeks, momentum ratios and trend agreement."""
    n = F.col("weeks_of_history")
    out = folded
    for k in (1, 4, 13, 26, 52):
        out = out.withColumn(f"lag_{k}w", F.when(n >= max(1, k // 2), tail_mean(F.col("series"), F.least(n, F.lit(k)))))
    ratio = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.when(b > 0, a / b).otherwise(1.0))
    c = F.col
    out = out.withColumns({
        "momentum_short": ratio(c("lag_1w"), c("lag_4w")), "momentum_medium": ratio(c("lag_4w"), c("lag_13w")),
        "momentum_long": ratio(c("lag_13w"), c("lag_26w"))})
    r = F.array_compact(F.array("momentum_short", "momentum_medium", "momentum_long"))
    return out.withColumn("trend_consistency", (
        F.when(F.size(r) == 0, "STABLE").when(F.forall(r, lambda x: x > 1.03), "STRONG_GROWTH")
        .when(F.forall(r, lambda x: x < 0.97), "STRONG_DECLINE").when(F.forall(r, lambda x: F.abs(x - 1.0) <= 0.03), "STABLE")
        .otherwise("UNSTABLE")))


# ---- array helpers ----------------------------------------------------------
def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def ordinary(a: Column) -> Column:
    """Whether no value is negative, NaN or so large that sums overflow: then no value up to 0 lies above any mean or median of them."""
    return (F.array_min(a) >= 0) & (F.array_max(a) < 1e300)


def sample_std(a: Column) -> Column:
    """Sample standard deviation of an array in one pass, 0 for fewer than two values."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(s, x):
        m = s["m"] + (x - s["m"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), m.alias("m"), (s["q"] + (x - s["m"]) * (x - m)).alias("q"))

    sd = F.aggregate(a, zero, step, lambda s: F.sqrt(s["q"] / (s["n"] - 1)))
    return F.when(F.size(a) > 1, sd).otherwise(0.0)


def median(a: Column) -> Column:
    at = lambda s, k: F.get(s, F.floor(k / 2).cast("int"))
    return once(F.sort_array(a), lambda s: F.when(F.size(s) > 0, (at(s, F.size(s) - 1) + at(s, F.size(s))) / 2))


def tail(a: Column, k: Column) -> Column:
    return F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k)


def tail_mean(a: Column, k: Column) -> Column:
    return total(tail(a, k)) / k
