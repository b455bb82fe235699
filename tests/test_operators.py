import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stocktide.operators import clean as cl
from stocktide.operators import decide as de
from stocktide.operators import features as ft
from stocktide.operators import forecast as fc
from stocktide.operators import hierarchy as hi
from stocktide.operators import labels as lab
from stocktide.operators import promo as pr
from stocktide.operators import score as sc
from stocktide.operators import series as se
from stocktide.operators.blend import policy_lift
from stocktide.operators.ordering import global_running

MON = dt.date(2024, 1, 1)
week = lambda i: MON + dt.timedelta(weeks=i)


def test_global_running_matches_a_plain_sort(spark):
    random.seed(1)
    rows = [("ab"[i % 2], f"s{i}", float(random.choice([5, 5, 5, 9, i]))) for i in range(500)]
    df = spark.createDataFrame(rows, "p string, k string, v double")
    got = {(r["p"], r["k"]): (r["row_rank"], r["running_total"], r["grand_total"])
           for r in global_running(df, [F.col("v").desc(), F.col("k")], "v", ["p"]).collect()}
    for p in "ab":
        run, mine = 0.0, sorted((r for r in rows if r[0] == p), key=lambda r: (-r[2], r[1]))
        for i, r in enumerate(mine, 1):
            run += r[2]
            assert got[(p, r[1])] == (i, pytest.approx(run), pytest.approx(sum(x[2] for x in mine)))


@pytest.mark.parametrize("sale,campaign,bf,disc,source,timing", [
    ("2025-11-10", None, "BF 2025 [03-23 NOIEMBRIE]", None, "campaign_bf_raw", 1),
    ("2025-12-10", None, "BF 2025 [03-23 NOIEMBRIE]", None, "campaign_bf_outside_timing_window", 0),
    ("2025-11-10", None, "BF special", None, "campaign_bf_raw_calendar_window", 1),
    ("2025-06-10", None, "Black_Friday", None, "campaign_bf_without_timing_evidence", 0),
    ("2025-11-10", "BF 2025", None, None, "inferred_current_year_campaign_and_calendar", 1),
    ("2025-11-10", "BF 2022", None, 0.2, "inferred_calendar_discount", 1),
    ("2025-11-10", None, None, 0.05, "inferred_calendar_window", 1),
    ("2025-06-10", "BF 2025", None, None, "campaign_label_without_timing_evidence", 0),
    ("2025-06-10", "BF 2022", None, None, "unknown", 0),
    ("2025-06-10", "FABRO x", None, None, "unknown", 0)])
def test_campaign_signal_branches(spark, sale, campaign, bf, disc, source, timing):
    df = spark.createDataFrame([(dt.date.fromisoformat(sale), campaign, bf, disc)],
                               "sale_date date, campaign_raw string, campaign_bf_raw string, discount_pct double")
    r = cl.campaign_signals(df).first()
    assert (r["bf_signal_source"], r["is_bf_timing"]) == (source, timing)
    assert r["is_product_program"] == int(bool(campaign and "FABRO" in campaign))


def test_hierarchy_precedence(spark):
    df = spark.createDataFrame([
        (1, "#null", "017 MOBILIER DE CASA - MIC MOBILIER", None, None, None, None),
        (2, None, None, None, None, "ONLINE", "Saltea ortopedica 160x200"),
        (3, "Ceva", None, None, "SANITARE BAIE", "Gradina", None),
        (4, None, None, None, None, None, None)],
        "i int, category_raw string, class_raw string, subclass_raw string, group_raw string, raion_raw string, product_name string")
    r = {x["i"]: x for x in hi.hierarchy_columns(df).collect()}
    assert (r[1]["category_norm"], r[1]["category_source"], r[1]["category_signal_status"]) == ("MOBILIER DE CASA", "class_raw", "observed")
    assert (r[2]["category_norm"], r[2]["category_signal_status"], r[2]["product_family_v2"]) == ("SALTELE SI SOMIERE", "inferred", "SALTELE SI SOMIERE")
    assert (r[3]["category_norm"], r[3]["category_source"], r[3]["product_family_v2"]) == ("MOBILIER BAIE SI SANITARE", "group_raw", "SANITARE")
    assert (r[4]["category_norm"], r[4]["product_family_source"]) == ("NECUNOSCUT", "unknown")


def test_regime_metrics_against_brute_force(spark):
    random.seed(3)
    rows = [(f"k{k}", week(i), float(random.randint(-3, 9)), 1.0) for k in range(6) for i in range(110) if random.random() < 0.1 * (k + 1)]
    df = spark.createDataFrame(rows, "sku_id string, week_start date, net double, net_revenue double").withColumn("pos_units", F.greatest("net", F.lit(0.0)))
    cut = week(107)
    got = {r["sku_id"]: r for r in lab.history_metrics(df, [cut]).collect()}
    for k in {r[0] for r in rows}:
        mine = {r[1]: max(r[2], 0.0) for r in rows if r[0] == k and r[1] <= cut}
        arr = [mine.get(cut - dt.timedelta(weeks=51 - i), 0.0) for i in range(52)]
        act = [w for w, u in mine.items() if u > 0 and w >= cut - dt.timedelta(weeks=103)]
        by = [sum(mine[w] for w in act if w.month == m) for m in range(1, 13)]
        rec = sum(len({w.year for w in act if w.month == m}) >= 2 for m in range(1, 13))
        g = got[k]
        assert g["active_weeks_52"] == sum(x > 0 for x in arr)
        assert g["active_4w_windows_52"] == sum(sum(arr[i:i + 4]) > 0 for i in range(49))
        assert g["active_months_104"] == sum(x > 0 for x in by)
        assert g["active_years_104"] == len({w.year for w in act})
        assert g["recurring_active_months_104"] == rec
        assert g["first_seen_week"] == min(mine)


def folded(spark, values, keys=("a",)):
    rows = [(k, week(i), float(v)) for k in keys for i, v in enumerate(values)]
    return se.fold_series(spark.createDataFrame(rows, "sku_id string, week_start date, units double"), ["sku_id"])


def test_fold_fills_gaps(spark):
    df = spark.createDataFrame([("a", week(0), 1.0), ("a", week(3), 2.0)], "sku_id string, week_start date, units double")
    assert se.fold_series(df, ["sku_id"]).first()["series"] == [1.0, 0.0, 0.0, 2.0]


def test_croston_against_loop(spark):
    values = [0] * 60
    for i, v in ((3, 4), (17, 2), (30, 6), (55, 1)):
        values[i] = v
    r = fc.fc_croston_sba(folded(spark, values), ["sku_id"]).first()
    d, q, last = None, None, -1
    for i, v in enumerate(values):
        if v > 0:
            gap = i - last
            d, q, last = (v, gap, i) if d is None else (0.15 * v + 0.85 * d, 0.15 * gap + 0.85 * q, i)
    assert r["forecast_4w"] == round(d / q * 0.925 * 4, 1)
    assert fc.fc_croston_sba(folded(spark, [1] * 30), ["sku_id"]).count() == 0


def test_naive_seasonal_and_fallback(spark):
    values = list(range(60))
    r = fc.fc_naive_seasonal(folded(spark, values), ["sku_id"]).first()
    assert (r["forecast_4w"], r["error"]) == (float(sum(values[8:12])), None)
    r = fc.fc_naive_seasonal(folded(spark, [2] * 10), ["sku_id"]).first()
    assert r["forecast_4w"] == 8.0 and r["error"].startswith("Insufficient history: 10")


def test_holt_follows_a_line(spark):
    r = fc.fc_holt_trend(folded(spark, [10 + i for i in range(60)]), ["sku_id"]).first()
    assert r["trend"] == "GROWING" and r["forecast_4w"] == pytest.approx(70 + 71 + 72 + 73, abs=0.2)


@pytest.mark.parametrize("pairs,want", [
    ([(1.0, 1.0), (2.0, 1.0)], 1.0), ([(1.0, 0.5), (2.0, 0.25), (9.0, 0.25)], 1.0), ([(1.0, 0.2), (2.0, 0.2), (9.0, 0.6)], 9.0),
    ([(1.0, 0.0), (5.0, 0.0)], 3.0), ([(4.0, 2.0)], 4.0)])
def test_weighted_median(spark, pairs, want):
    df = spark.createDataFrame([(pairs,)], "p array<struct<v:double,w:double>>")
    assert df.select(fc.weighted_median(F.col("p"))).first()[0] == want


def test_ensemble_stays_inside_its_methods(spark):
    rows = [("a", m, v, v, 0.0, v, 0.0, v, 9, e) for m, v, e in (("x", 1.0, None), ("y", 9.0, None), ("z", 4.0, None), ("bad", 99.0, "no"))]
    df = spark.createDataFrame(rows, "sku_id string, method string, forecast_4w double, forecast_8w double, confidence_low_4w double, confidence_high_4w double, "
                                     "confidence_low_8w double, confidence_high_8w double, weeks_of_history int, error string")
    for how, want in (("median", 4.0), ("trimmed_mean", 4.0), ("equal_weight", 4.7)):
        r = fc.ensemble_combine(df, ["sku_id"], how).first()
        assert (r["forecast_4w"], r["methods_succeeded"], r["methods_failed"], r["confidence_high_4w"]) == (want, 3, 1, 9.0)
    with pytest.raises(ValueError):
        fc.ensemble_combine(df, ["sku_id"], "best")


@pytest.mark.parametrize("delivery,days,want", [("2024-01-01", 31, (1, 1, 1)), ("2024-01-01", 30, (0, 0, 0)), ("2024-01-20", 90, (1, 79, 0)), (None, 90, (0, None, 0)), ("2024-01-16", 29, (1, 14, 1))])
def test_return_window(spark, delivery, days, want):
    d = F.lit(delivery).cast("date")
    assert tuple(spark.range(1).select(*de.return_window(d, F.lit(days), dt.date(2024, 1, 31))).first()) == want


def test_sudden_stop_needs_the_last_sale_anchor(spark):
    rows = [("a", "s", week(i), 3.0, 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "sku_id string, store_id string, sale_date date, units_sold double, units_returned double")
    asof = week(12) + dt.timedelta(days=70)
    assert de.trajectories(df, asof).first()["trajectory"] == "LIFECYCLE_DECLINE"
    assert de.trajectories(df, asof, "last_sale").first()["trajectory"] == "SUDDEN_STOP"


def test_decision_validation(spark):
    df = spark.createDataFrame([("a", " Approve", "dead_stock", None), ("b", "override", "DEAD_STOCK", None), ("c", "skip", "SUPPLIER_RED", None), ("d", "hold", "DEAD_STOCK", None)],
                               "sku_id string, action string, queue_type string, override_qty double")
    ok, bad = de.split_decisions(df)
    assert [r["sku_id"] for r in ok.collect()] == ["a"]
    assert {r["sku_id"]: r["reject_reason"] for r in bad.collect()} == {"b": "override_without_qty", "c": "bad_queue_type", "d": "bad_action"}


def test_policy_lift_needs_a_rank_limit():
    for limit in (None, 5000):
        with pytest.raises(ValueError):
            policy_lift(F.lit(1.0), "pre", limit)


@pytest.mark.parametrize("text,start,end,pct", [
    ("Campanie covoare 20%, 20.03-02.04.2024", "2024-03-20", "2024-04-02", 20.0), ("18.12 - 06.01.2025 covor", "2024-12-18", "2025-01-06", None),
    ("Covoare 6-26.09.2023 15 %", "2023-09-06", "2023-09-26", 15.0), ("Fidelizare", None, None, None)])
def test_promo_text(spark, text, start, end, pct):
    r = pr.promo_text_fields(spark.createDataFrame([("DISCOUNT011", text)], "item_code string, description string")).first()
    iso = lambda d: d and d.isoformat()
    assert (iso(r["start_date"]), iso(r["end_date"]), r["discount_percent"]) == (start, end, pct)


def test_dedup_keeps_the_first_row(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first"), ("m", 5, "only")], "key string, n int, v string")
    assert sorted((r["key"], r["v"]) for r in cl.dedup_transactions(df, ["key"], ["n"]).collect()) == [("k", "first"), ("m", "only")]


def test_features_do_not_see_the_target(spark):
    cols = ["net_revenue", "gross_units", "returned_units", "num_transactions", "bf_transaction_count", "online_transaction_count", "outlet_transaction_count",
            "num_stores_selling", "num_hyperstores_selling", "num_smaller_stores_selling", "avg_discount_pct", "max_discount_pct"]
    rows = [("a", week(i), float(i % 5)) for i in range(70)]
    df = spark.createDataFrame(rows, "sku_id string, week_start date, pos_units double").withColumns({c: F.col("pos_units") / 10 for c in cols})
    t = week(60)
    whole = ft.window_features(df, [t]).first()
    assert whole == ft.window_features(df.where(F.col("week_start") < F.lit(t)), [t]).first()
    assert whole["pos_units_4w"] == sum(i % 5 for i in range(56, 60))
    n = sc.naive_wide(df, [t]).first()
    assert (n["last4"], n["seasonal52"]) == (sum(i % 5 for i in range(56, 60)), sum(i % 5 for i in range(8, 12)))


def test_population_filter_rejects_unknown(spark):
    with pytest.raises(ValueError):
        ft.population_filter(spark.range(1), "some")


MASK_ROW = {"primary_route": "available_regular", "calendar_route_context": "normal_calendar", "campaign_txn_13w": 0.0, "bf_txn_13w": 0.0,
            "store_or_supplier_available_before_target": 1.0, "combined_stock_observed_prev_month": 1.0, "active_weeks_52": 30.0, "avg_units_per_4w_52": 3.0}


@pytest.mark.parametrize("change,names", [
    ({}, {"regular", "guarded_regular", "supplier_available", "demand_regular"}),
    ({"campaign_txn_13w": 1.0}, {"regular", "supplier_available", "demand_regular", "campaign"}),
    ({"bf_txn_13w": 2.0}, {"regular", "supplier_available", "demand_regular", "campaign", "bf_calendar"}),
    ({"calendar_route_context": "pre_bf_window"}, {"bf_calendar"}),
    ({"primary_route": "bf_campaign_sensitive"}, {"campaign", "demand_regular"}),
    ({"primary_route": "stock_constrained", "combined_stock_observed_prev_month": None, "avg_units_per_4w_52": None}, {"stock_constrained"}),
])
def test_route_masks(spark, change, names):
    from stocktide.operators.routes import route_masks
    row = MASK_ROW | change
    schema = ", ".join(f"{k} {'string' if isinstance(MASK_ROW[k], str) else 'double'}" for k in row)
    got = spark.createDataFrame([tuple(row.values())], schema).select(*[m.alias(n) for n, m in route_masks().items()]).first().asDict()
    assert {n for n, v in got.items() if v} == names


def test_targets_without_a_scored_row_keep_their_predictions(spark):
    from stocktide.operators import blend
    days = [dt.date(2024, 1, 1) + dt.timedelta(28 * k) for k in range(6)]
    schema = "target_start date, sku_id string, product_family_v2 string, category_norm string, actual_units double, last4 double, roll13_mean double, seasonal52 double"
    train = spark.createDataFrame([(d, "a", "f", "c", 1.0, 2.0, 3.0, 4.0) for d in days], schema)
    labels = train.drop("actual_units")
    got = blend.empirical_blend(labels, train, days).collect()
    assert sorted(r.target_start for r in got) == days[4:]
    assert all(abs(r.pred_units_4w - 4.0) < 1e-9 for r in got)  # the first grid point is all seasonal
    none = blend.empirical_blend(labels, train.limit(0), days).collect()
    assert len(none) == 2 and all(abs(r.pred_units_4w - 3.0) < 1e-9 for r in none)
    rows = train.withColumn("p", F.lit(5.0))
    tuned = blend.postprocess_tune(rows, days, "p")
    assert blend.postprocess(rows, tuned.limit(0), "p").where("tuned_pred = 5.0").count() == 6


def test_error_tags(spark):
    from stocktide.operators.audit import error_attribution
    base = dict(pred_units=10.0, naive_pred=10.0, actual_units=10.0, aa_pred=10.0, tree_pred=10.0, other_preds=[10.0], zero_share=0.1,
                last_10w_units=5.0, monthly_cv=0.1, target_multiplier=1.0)
    cases = [({}, "within_tolerance"), ({"last_10w_units": 0.0}, "silent_phantom"), ({"aa_pred": 0.4, "zero_share": 0.9}, "aa_collapse"),
             ({"tree_pred": 21.0}, "lgbm_drag"), ({"monthly_cv": 0.6, "target_multiplier": 0.5, "naive_pred": 6.0}, "seasonal_extrapolation"),
             ({"pred_units": 15.0, "naive_pred": 11.0}, "naive_would_have_won"), ({"pred_units": 15.0, "naive_pred": 30.0}, "residual"),
             ({"actual_units": 0.0}, "residual"), ({"pred_units": 12.0, "naive_pred": 30.0}, "within_tolerance")]
    schema = ", ".join(f"{k} {'array<double>' if k == 'other_preds' else 'double'}" for k in base) + ", want string"
    rows = spark.createDataFrame([(*(base | c).values(), w) for c, w in cases], schema)
    assert [(r.want, r.primary_tag) for r in error_attribution(rows).collect() if r.want != r.primary_tag] == []
