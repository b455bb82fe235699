"""Bootstrap on counts, Holt filter over batches, shared history blocks, decisions of a day."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from stocktide.operators import decide as de
from stocktide.operators import forecast as fc
from stocktide.operators import promo as pr


def test_bootstrap_on_counts_gives_the_interval_of_a_plain_bootstrap(spark):
    rng = random.Random(3)
    rows = [("c", int(k % 3 == 0), round(rng.choice([0.5, 1.0, 1.5, 2.0, 3.0]) * (1.4 if k % 3 == 0 else 1.0), 2)) for k in range(400)]
    df = spark.createDataFrame([(f"s{k}", dt.date(2001, 1, 1), *r) for k, r in enumerate(rows)], "sku_id string, week_start date, category string, promo_flag int, ratio double")
    got = pr.promo_lift_ci(df, samples=600).first()
    on, off = (np.array([r for _, f, r in rows if f == flag]) for flag in (1, 0))
    g = np.random.default_rng(1)
    lifts = [g.choice(on, len(on)).mean() / g.choice(off, len(off)).mean() for _ in range(4000)]
    low, high = np.quantile(lifts, [0.025, 0.975])
    assert abs(got.ci_low - low) < 0.15 * (high - low) and abs(got.ci_high - high) < 0.15 * (high - low)
    assert got.ci_low < got.lift < got.ci_high
    assert pr.promo_lift_ci(df.limit(0)).count() == 0


def test_poisson_limits_have_the_mean():
    for mean in pr.DRAWS:
        limits = np.array([0.0, *pr.poisson_limits(mean)])
        assert abs((np.diff(limits) * np.arange(len(limits) - 1)).sum() - mean) < 1e-9 and abs(limits[-1] - 1) < 1e-12


def test_holt_of_a_batch_equals_single_loops():
    rng, series = np.random.default_rng(4), []
    for n in (1, 2, 3, 7, 30, 30, 90, 1):
        series.append(rng.gamma(2, 3, n))
    error, level, trend = fc.holt_fits(series)
    for k, s in enumerate(series):
        best = None
        for a in fc.HOLT_GRID:
            for b in fc.HOLT_GRID:
                lv, tr, e = s[0], (s[1] - s[0] if len(s) > 1 else 0.0), 0.0
                for x in s[1:]:
                    f = lv + tr
                    new = a * x + (1 - a) * f
                    tr, lv, e = b * (new - lv) + (1 - b) * tr, new, e + (x - f) * (x - f)
                if best is None or e < best[0]:
                    best = (e, lv, tr)
        assert np.allclose([error[k], level[k], trend[k]], best)


def test_decisions_of_a_day_and_the_last_ones(spark):
    at = [dt.datetime(2001, 5, d, 12) for d in (1, 1, 2, 3)] + [None]
    rows = [(f"i{k}", f"s{k}", "DEAD_STOCK" if k % 2 else "STOCKOUT_RISK", "approve" if k else "skip", None, 10.0 * k, t) for k, t in enumerate(at)]
    d = spark.createDataFrame(rows, "id string, sku_id string, queue_type string, action string, override_qty double, financial_impact double, decided_at timestamp")
    day = {r.scope: r for r in de.decisions_summary(d, dt.date(2001, 5, 1)).collect()}
    assert day["ALL"].total == 2 and day["ALL"].impact == 10.0 and day["STOCKOUT_RISK"].skip_count == 1
    assert [r.id for r in de.recent_decisions(d, k=3).collect()] == ["i3", "i2", "i1"]
    assert [r.id for r in de.recent_decisions(d, k=9).collect()][-1] == "i4"
    assert de.decisions_summary(d.where(F.lit(False))).count() == 0
