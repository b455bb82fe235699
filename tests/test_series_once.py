"""Forecasts over folded series look at the neighbourhood of a week once, and judge odd values by the plain rules."""

import datetime as dt

from stocktide.operators import forecast as fc

ODD = {
    "zeros": [0.0] * 30 + [5.0, 0.0, 40.0, -0.0, 3.0] * 4, "dense": [float(3 + i * 7 % 5) for i in range(60)],
    "spike": [4.0, 5.0, 4.0, 6.0, 90.0, 4.0, 0.0] * 9, "negative": [2.0, -1.0, -30.0, 4.0, 0.0, -2.0, 25.0, 1.0] * 6, "short": [1.0, 0.0, 9.0],
}


def folded(spark):
    first = dt.date(2000, 1, 3)
    rows = [(k, first, first + dt.timedelta(7 * (len(v) - 1)), v, len(v)) for k, v in ODD.items()]
    return spark.createDataFrame(rows, "sku_id string, first_week date, last_week date, series array<double>, weeks_of_history int")


def judged(s):
    limit, promo, outlier = (3.5 if sum(s) / len(s) < 3 else 2.5), 0, 0
    for i, x in enumerate(s):
        near = s[max(i - 12, 0):i + 1]
        m = sum(near) / len(near)
        dev = abs(x - m) / m if i >= 3 and m != 0 else 0.0
        p = dev > limit and x > m
        promo, outlier = promo + p, outlier + (dev > 3 and not p)
    return promo, outlier


def middle(a):
    a = sorted(a)
    return (a[(len(a) - 1) // 2] + a[len(a) // 2]) / 2


def test_anomalies_are_those_of_the_plain_rule(spark):
    found = {r.sku_id: (r.anomalies_detected, r.outliers_detected) for r in fc.fc_anomaly_adjusted(folded(spark), ["sku_id"]).collect()}
    assert found == {k: judged(v) for k, v in ODD.items() if sum(x <= 0 for x in v) / len(v) <= fc.INTERMITTENT_SHARE}


def test_calendar_base_is_that_of_the_plain_rule(spark):
    rows = {r.sku_id: r for r in fc.fc_calendar_events(folded(spark), ["sku_id"]).collect()}
    for k, s in ODD.items():
        clean = []
        for i, x in enumerate(s):
            near = s[max(i - 6, 0):i + 7]
            m = middle(near) if len(near) >= 3 else middle(s)
            clean.append(m if len(s) >= 4 and x > m * 2.5 else x)
        base = middle(clean[-13:]) if middle(clean[-13:]) > 0 else middle(clean)
        zero = "Zero or negative base demand after cleaning" if base <= 0 else None
        assert rows[k].error == ("Insufficient history: 3 weeks (need 8)" if len(s) < 8 else zero)


def test_a_neighbourhood_is_taken_once(spark):
    """Before, every use of a neighbourhood's mean or median took, summed and sorted it anew."""
    for method in (fc.fc_anomaly_adjusted, fc.fc_calendar_events):
        plan = method(folded(spark), ["sku_id"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("slice(series") == 1
