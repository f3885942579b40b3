import datetime as dt

import numpy as np
import pytest

from wardflow.plans import trend

START = dt.date(2022, 1, 3)


def series(spark, values):
    return spark.createDataFrame([(START + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "date_key date, v double")


def days(spark, first, last):
    return spark.createDataFrame([(START + dt.timedelta(days=i),) for i in range(first, last)], "date_key date")


def predicted(model, frame):
    rows = sorted(model.predict(frame).collect(), key=lambda r: r["date_key"])
    return np.array([(r["yhat"], r["yhat_lower"], r["yhat_upper"]) for r in rows]).T


def broken_line(n, at, rng, noise=1.0):
    """Rises by 0.05 a day up to day `at`, then falls by 0.1; a weekly wave and noise on top."""
    i = np.arange(n)
    return 100 + 0.05 * i - 0.15 * np.maximum(i - at, 0) + 5 * (i % 7 == 2) + rng.normal(0, noise, n)


def test_one_known_break_is_found(spark):
    n, at = 700, 280
    model = trend.fit_baseline(series(spark, broken_line(n, at, np.random.default_rng(0))), "v", yearly=False)
    places = trend.HISTORY * np.arange(1, trend.CHANGEPOINTS + 1) / (trend.CHANGEPOINTS + 1) * (n - 1)
    strong = np.abs(model.changes)
    near = np.abs(places - at) < 60
    assert strong[near].sum() > 0.9 * strong.sum()  # elsewhere the prior holds changes down
    middle, _, _ = predicted(model, days(spark, n, n + 30))
    i = np.arange(n, n + 30)
    assert np.allclose(middle, 100 + 0.05 * i - 0.15 * (i - at) + 5 * (i % 7 == 2), atol=1.5)


def test_a_straight_line_has_no_changes(spark):
    rng = np.random.default_rng(1)
    model = trend.fit_baseline(series(spark, 50 + 0.02 * np.arange(500) + rng.normal(0, 1, 500)), "v", yearly=False)
    assert np.abs(model.changes).sum() < 0.1 * 0.02 * 500 + 0.5


def test_bands_widen_and_cover(spark):
    inside = total = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        values = broken_line(430, 150, rng, 2.0)
        model = trend.fit_baseline(series(spark, values[:400]), "v", yearly=False)
        middle, low, high = predicted(model, days(spark, 400, 490))
        width = high - low
        assert width[0] < width[30] < width[89] and np.all(np.diff(width[::7]) > 0)
        inside += int(((values[400:] >= low[:30]) & (values[400:] <= high[:30])).sum())
        total += 30
        assert np.all((low < middle) & (middle < high))
    assert 0.7 <= inside / total <= 0.95


def test_yearly_season_and_log_target(spark):
    i = np.arange(800)
    season = np.sin(2 * np.pi * ((i + 2) % 365.25) / 365.25)
    values = 80 * np.exp(0.1 * season)
    model = trend.fit_baseline(series(spark, values), "v", multiplicative=True)
    middle, low, _ = predicted(model, days(spark, 800, 860))
    want = 80 * np.exp(0.1 * np.sin(2 * np.pi * ((np.arange(800, 860) + 2) % 365.25) / 365.25))
    assert np.allclose(middle, want, rtol=0.02) and (low > 0).all()


def test_constant_and_single_day(spark):
    model = trend.fit_baseline(series(spark, [7.0] * 40), "v")
    middle, low, high = predicted(model, days(spark, 40, 45))
    assert np.allclose(middle, 7, atol=0.01) and (high - low < 0.2).all()
    one = trend.fit_baseline(series(spark, [3.0]), "v")
    assert predicted(one, days(spark, 0, 1))[0] == pytest.approx([3.0], abs=0.1)
    with pytest.raises(trend.TooLittleHistory):
        trend.fit_baseline(series(spark, []), "v")


def test_unknown_days_are_left_out(spark):
    frame = spark.createDataFrame(
        [(START + dt.timedelta(days=i), None if i % 3 else 10.0 + i) for i in range(90)], "date_key date, v double"
    )
    middle, *_ = predicted(trend.fit_baseline(frame, "v", yearly=False), days(spark, 88, 90))
    assert np.allclose(middle, [98, 99], atol=1.5)


def test_solve_is_ridge_regression():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(300, 3)), np.ones(300)])
    y = x @ [2.0, -1.0, 0.0, 5.0] + rng.normal(0, 0.1, 300)
    whole = np.column_stack([x, y])
    beta, covariance, noise = trend.solve(whole.T @ whole, 300, np.zeros(4, bool), np.full(4, np.inf))
    assert np.allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0]) and noise == pytest.approx(0.01, rel=0.2)
    assert np.allclose(covariance, noise * np.linalg.inv(x.T @ x))
