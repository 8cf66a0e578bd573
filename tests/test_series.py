"""Forecasters against slow, direct definitions, and the honesty rules."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import forecasters as f
from tidemark.operators import series as ts


def history(n=40, m=12, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + 2 * t + 20 * np.sin(2 * np.pi * t / m) + rng.normal(0, 4, n)


def weights(n, span):
    w = [np.exp(-span + span * i / (n - 1)) if n > 1 else np.exp(-span) for i in range(n)]
    return [x / sum(w) for x in w]


def wmean(xs, span=1.5):
    return sum(a * b for a, b in zip(xs, weights(len(xs), span)))


def rail(p, y):
    r = sum(y[-6:]) / len(y[-6:])
    return min(max(p, 0.5 * r), 1.5 * r) if r > 0 else p


def same(y, m):
    return [y[i] for i in range(len(y)) if i % m == len(y) % m]


def slow_yoy(y, m):
    s = same(y, m)
    g = [y[i] / y[i - m] for i in range(max(m, len(y) - 6), len(y)) if y[i - m] > 0]
    own = wmean([b / a if a > 0 else 1.0 for a, b in zip(s, s[1:])])
    return s[-1] * min(max(0.45 * own + 0.55 * wmean(g), 0.75), 1.30)


def slow_mom(y, m):
    g = [y[i] / y[i - 1] for i in range(len(y)) if i % m == len(y) % m and i >= 1 and y[i - 1] > 0]
    return y[-1] * min(max(wmean(g), 0.65), 1.35)


def slow_theta(y, m):
    level, trend = y[0], 0.0
    for x in y[1:]:
        new = 0.15 * x + 0.85 * (level + trend)
        trend, level = 0.1 * (new - level) + 0.9 * trend, new
    p = (level + 0.8 * trend) * min(max(wmean(same(y, m), 1.0) / np.mean(y[-18:]), 0.85), 1.15)
    r = np.mean(y[-6:])
    if p > 1.3 * r or p < 0.7 * r:
        p = 0.6 * p + 0.4 * r
    return rail(p, y)


def slow_reversion(y, m):
    p = (0.6 * np.mean(y) + 0.4 * np.mean(y[-6:])) * min(max(wmean(same(y, m), 0.8) / np.mean(y), 0.8), 1.2)
    return rail(p, y)


def slow_damped(y, m):
    level, trend = y[0], y[1] - y[0]
    for x in y[1:]:
        new = 0.2 * x + 0.8 * (level + 0.85 * trend)
        trend, level = 0.1 * (new - level) + 0.9 * 0.85 * trend, new
    return rail((level + 0.85 * trend) * min(max(wmean(same(y, m), 0.5) / np.mean(y[-2 * m:]), 0.85), 1.15), y)


def slow_decay(y, m):
    s = same(y, m)
    g = [b / a for a, b in zip(s, s[1:])]
    if len(g) >= 3:
        lo, hi = max(0.5, np.percentile(g, 5)), min(2.0, np.percentile(g, 95))
        g = [x for x in g if lo <= x <= hi]
    else:
        g = [x for x in g if 0.5 < x < 2.0]
    return rail(s[-1] * (wmean(g) if g else 1.0), y)


def slow_slope(y, m):
    s = same(y, m)
    line = np.polyval(np.polyfit(range(len(s)), s, 1), len(s))
    return rail(0.6 * line + 0.4 * wmean(s, 0.5), y)


def slow_annual(y, m):
    k = sum(y[-m:]) / sum(y[-2 * m:-m])
    return rail(same(y, m)[-1] * min(max(k, 0.8), 1.25), y)


def ahead(spark, method, y, horizon, m):
    row = spark.createDataFrame([([float(v) for v in y],)], "y array<double>")
    return np.array(row.select(method(F.col("y"), horizon, m).alias("p")).first().p, float)


SLOW = {"yoy": slow_yoy, "mom": slow_mom, "theta": slow_theta, "mean_reversion": slow_reversion, "damped_trend": slow_damped,
        "cycle_decay": slow_decay, "cycle_slope": slow_slope, "annual_factor": slow_annual}


@pytest.mark.parametrize("name", SLOW)
@pytest.mark.parametrize("n, m", [(26, 12), (40, 12), (61, 12), (23, 4), (50, 7)])
def test_chained_methods(spark, name, n, m):
    path = list(history(n, m, n))
    want = []
    for _ in range(4):
        p = float(SLOW[name](path, m))
        want.append(p)
        path.append(p)
    assert np.allclose(ahead(spark, f.METHODS[name], history(n, m, n), 4, m), want)


@pytest.mark.parametrize("n, m", [(30, 12), (61, 12), (23, 4)])
def test_holt_winters_grid(spark, n, m):
    y, best = history(n, m, 3), None
    for a in f.ALPHAS:
        for b in f.BETAS:
            for g in f.GAMMAS:
                level, trend, s, sse = np.mean(y[:m]), (np.mean(y[m:2 * m]) - np.mean(y[:m])) / m, list(y[:m] - np.mean(y[:m])), 0.0
                for i in range(m, n):
                    sse += (y[i] - level - trend - s[i - m]) ** 2
                    new = a * (y[i] - s[i - m]) + (1 - a) * (level + trend)
                    trend, level = b * (new - level) + (1 - b) * trend, new
                    s.append(g * (y[i] - level) + (1 - g) * s[i - m])
                if best is None or sse < best[0]:
                    best = (sse, [level + trend * (h + 1) + s[len(s) - m + h % m] for h in range(5)])
    assert np.allclose(ahead(spark, f.holt_winters, y, 5, m), best[1])


def test_seasonal_trend_recovers_its_own_model(spark):
    t = np.arange(60)
    y = 5 + 0.7 * t + np.tile([1.0, -2.0, 3.0, 0.5], 15)
    next_t = np.arange(60, 66)
    assert np.allclose(ahead(spark, f.seasonal_trend, y, 6, 4), 5 + 0.7 * next_t + np.array([1.0, -2.0, 3.0, 0.5])[next_t % 4])
    assert np.allclose(ahead(spark, f.seasonal_trend, y[:7], 3, 4), ahead(spark, f.drift, y[:7], 3, 4))
    noisy, m = history(70, 4, 5), 4
    first = max(0, 70 - 8 * m)
    t = np.arange(first, 75)
    design = np.hstack([t[:, None] - first, np.eye(m)[t % m]])
    fit, *_ = np.linalg.lstsq(design[: 70 - first], noisy[first:], rcond=None)
    assert np.allclose(ahead(spark, f.seasonal_trend, noisy, 5, m), design[70 - first :] @ fit)


def test_short_histories_fall_back(spark):
    y = np.array([3.0, 4.0, 5.0])
    for name, fn in f.METHODS.items():
        for m in (1, 12):
            out = ahead(spark, fn, y, 3, m)
            assert out.shape == (3,) and np.isfinite(out).all(), name
    assert list(ahead(spark, f.seasonal_naive, y, 2, 12)) == [5.0, 5.0]


def test_cuts():
    assert ts.cuts_for(48, 3, 12, 4) == [42, 43, 44, 45]
    assert ts.cuts_for(26, 3, 12, 6) == []


def frame(spark, values, segment="a", start=date(2020, 1, 1)):
    rows = [(segment, date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "segment string, period date, value double")


def test_empty_periods_are_zero(spark):
    df = spark.createDataFrame([(date(2024, 1, 9), 5.0), (date(2024, 3, 2), 7.0), (None, 1.0)], "d date, v double")
    assert [(str(r.period), r.value) for r in ts.series(df, "d", "v").orderBy("period").collect()] == [("2024-01-01", 5.0), ("2024-02-01", 0.0), ("2024-03-01", 7.0)]
    week = ts.series(df, "d", "v", "weekly").orderBy("period").first()
    assert str(week.period) == "2024-01-14"  # the Sunday that ends the week


def test_no_method_sees_the_future(spark):
    seen = []

    def spy(y, horizon, m):
        seen.append(len(y))
        return np.full(horizon, float(len(y)))

    rows = ts.run_methods(frame(spark, history(48)), custom={"spy": spy}, origins=4).collect()
    assert all(r.predicted == r.cut for r in rows)
    assert {r.cut for r in rows if r.kind == "backtest"} == {42, 43, 44, 45}


def test_a_broken_method_is_recorded(spark):
    def broken(y, horizon, m):
        raise RuntimeError("no")

    p = ts.Projection(frame(spark, history(60)), methods={"naive": f.naive, "seasonal_naive": f.seasonal_naive}, custom={"broken": broken})
    assert {r.method for r in p.errors().collect()} == {"broken"}
    assert p.forecast().count() == 3


def test_perfect_cycle_cannot_be_beaten(spark):
    p = ts.Projection(frame(spark, [10.0, 20.0, 30.0, 15.0] * 12), cycle=4)
    best = p.choice.first()
    assert best.error == pytest.approx(0) and not best.beats_reference


def test_blend_uses_earlier_cuts_only(spark):
    rows = [("a", mth, cut, 1, cut, None, 10.0, 10.0 + e) for mth, errs in (("x", (1, 4, 2)), ("y", (3, 1, 5))) for cut, e in zip((1, 2, 3), errs)]
    trials = spark.createDataFrame(rows, "segment string, method string, cut bigint, step bigint, position bigint, period date, actual double, predicted double")
    got = {r.cut: r.predicted for r in ts.ensemble_trials(trials).collect()}
    assert set(got) == {2, 3}
    assert got[2] == pytest.approx(10 + (4 / 1 + 1 / 3) / (1 / 1 + 1 / 3))
    assert got[3] == pytest.approx(10 + (2 / 2.5 + 5 / 2) / (1 / 2.5 + 1 / 2))


def test_metrics_with_zero_actuals(spark):
    rows = [("a", "x", 1, 1, 1, None, 0.0, 0.0), ("a", "x", 1, 2, 2, None, 10.0, 12.0)]
    trials = spark.createDataFrame(rows, "segment string, method string, cut bigint, step bigint, position bigint, period date, actual double, predicted double")
    m = ts.trial_metrics(trials).first()
    assert m.mae == 1.0 and m.mape is None and m.smape == pytest.approx(100 * (2 / 11) / 2)


def test_bands_pull_the_forecast_down_when_it_runs_high(spark):
    bands = spark.createDataFrame([("a", "x", 1, 0.05, 0.25)], "segment string, method string, step bigint, low_error double, high_error double")
    future = spark.createDataFrame([("a", "x", 1, 100.0)], "segment string, method string, step bigint, predicted double")
    r = ts.apply_bands(future, bands).first()
    assert (r.low, r.high) == (pytest.approx(80), pytest.approx(100 / 1.05))


def test_projection_reaches_the_calendar(spark):
    s = ts.segment_series(
        frame(spark, history(40)).union(frame(spark, history(10), "short")).withColumn("other", F.lit("n/a")), "period", "value", ["segment", "other"])
    assert {r.segment for r in ts.omitted_segments(s).collect()} == {"short"}
    out = ts.Projection(ts.long_enough(s)).table()
    ahead = out.where("kind = 'projection'").orderBy("segment", "step").collect()
    assert [(r.segment, r.date_key, r.days) for r in ahead] == [(g, k, d) for g in ("TOTAL", "a") for k, d in ((20230501, 30), (20230601, 60), (20230701, 90))]
    assert all(r.low is None or r.low <= r.high for r in ahead)
