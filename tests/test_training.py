import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardflow import schemas
from wardflow.plans import backtest, training, trend

from .util import by_key, rows


def make_fact(spark, days):
    rng = np.random.default_rng(42)
    dates = pd.date_range(dt.date(2025, 1, 1), periods=days, freq="D")
    n = days * 2
    pdf = pd.DataFrame(
        {
            "date_key": dates.repeat(2).date,
            "hospital_id": ["H1", "H2"] * days,
            "specialty_id": ["SP_GEN"] * n,
            "bed_occupancy_pct": np.clip(rng.normal(85, 7, n), 50, 100),
            "median_wait_days": np.clip(rng.normal(20, 5, n), 5, 60),
            "ae_attendances": rng.integers(80, 400, n),
            "referrals": rng.integers(0, 60, n),
            "vacancy_rate": np.clip(rng.normal(7, 3, n), 0, 25),
            "flu_index": rng.normal(5, 2, n),
            "covid_index": rng.normal(3, 1, n),
            "avg_temp_c": rng.normal(10, 5, n),
        }
    )
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def fact(spark):
    return make_fact(spark, 150)


def newest(df):
    return df.agg(F.max("date_key")).first()[0]


def test_holidays():
    assert trend.easter(2025) == dt.date(2025, 4, 20) and trend.easter(2024) == dt.date(2024, 3, 31)
    days = trend.holidays(2025, 2025)
    assert set(map(str, days)) == {
        "2025-01-01", "2025-04-18", "2025-04-21", "2025-05-05", "2025-05-26", "2025-08-25", "2025-12-25", "2025-12-26"
    }


def test_baseline_follows_trend_and_weekday(spark):
    start = dt.date(2024, 1, 1)
    data = [(start + dt.timedelta(days=i), 100 + 0.1 * i + 20 * ((i % 7) == 5)) for i in range(200)]
    daily = spark.createDataFrame(data, "date_key date, v double")
    model = trend.fit_baseline(daily, "v", yearly=False)
    future = spark.createDataFrame([(start + dt.timedelta(days=i),) for i in range(200, 214)], "date_key date")
    got = by_key(model.predict(future), "date_key")
    for i in range(200, 214):
        want = 100 + 0.1 * i + 20 * ((i % 7) == 5)
        r = got[start + dt.timedelta(days=i)]
        assert r["yhat"] == pytest.approx(want, abs=2.5) and r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"]


def test_multiplicative_baseline_is_positive(spark):
    start = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([(start + dt.timedelta(days=i), 1.0 + i % 7) for i in range(60)], "date_key date, v double")
    model = trend.fit_baseline(daily, "v", multiplicative=True)
    got = model.predict(daily.select("date_key"))
    assert got.filter("yhat_lower <= 0 OR yhat_upper < yhat").count() == 0


def test_occupancy_forecast(fact):
    fc = training.occupancy_forecast(fact, 30, trees=3)
    got = fc.collect()
    assert sum(r.date_key > newest(fact) for r in got) == 30
    assert {"yhat", "yhat_lower", "yhat_upper"} <= set(fc.columns)
    assert all(40 < r.yhat < 130 for r in got)


def test_attendance_forecast_marks_the_future(fact):
    fc = training.attendance_forecast(fact, 30)
    assert fc.filter("is_future").count() == 30 and fc.filter("NOT is_future").count() == 150
    assert fc.filter(F.col("is_future") != (F.col("date_key") > F.lit(newest(fact)))).count() == 0


def test_waiting_times(fact):
    model = training.WaitingTimes((7, 14), trees=3).fit(fact)
    out = model.predict(fact, 7)
    assert out.count() == 300 and "pred_7d" in out.columns
    assert out.filter(F.col("target_date") != F.date_add("date_key", 7)).count() == 0
    with pytest.raises(KeyError):
        model.predict(fact, 30)


@pytest.fixture(scope="module")
def staff(spark):
    data = [(f"T{i}", role, 100 + 10 * i, 5 * i, 2.0 * i) for i in range(8) for role in ("Medical", "Nursing")]
    return spark.createDataFrame(
        data, "trust_code string, role string, staff_count long, vacancies long, vacancy_rate double"
    )


def test_workforce_models(staff):
    dated = staff.withColumn("date_key", F.lit("2025-06-01").cast("date"))
    model = training.WorkforceModels(trees=5).fit(dated)
    shortage = {(r.trust_code, r.role): r.shortage_proba for r in model.shortage(dated).collect()}
    assert len(shortage) == 16 and all(0 <= p <= 1 for p in shortage.values())
    assert shortage["T7", "Nursing"] > 0.5 > shortage["T0", "Nursing"]
    demand = {(r.trust_code, r.role): r.demand_fte for r in model.demand(dated).collect()}
    assert demand["T7", "Medical"] > demand["T0", "Medical"]


def test_residual_signal_is_learned(spark):
    """Occupancy with a jump on high flu: the booster adds what the trend can't see."""
    rng = np.random.default_rng(5)
    days, flu = 220, rng.choice([1.0, 9.0], 220)
    pdf = pd.DataFrame({
        "date_key": pd.date_range("2025-01-01", periods=days).date, "hospital_id": "H1", "specialty_id": "S",
        "bed_occupancy_pct": 70 + 10 * (flu > 5) + rng.normal(0, 0.5, days), "flu_index": flu, "covid_index": 3.0, "avg_temp_c": 9.0,
    })
    daily = spark.createDataFrame(pdf)
    x, names = training._occupancy_features(training.national_daily(daily, "bed_occupancy_pct", "mean"), "bed_occupancy_pct")
    baseline = trend.fit_baseline(daily.select("date_key", "bed_occupancy_pct"), "bed_occupancy_pct", multiplicative=True)
    x = x.join(baseline.predict(daily.select("date_key")), "date_key").withColumn("residual", F.col("bed_occupancy_pct") - F.col("yhat"))
    table = training.vectors(x.dropna(), names, "residual", "flu_index")
    model = training.gbt(training.GBTRegressor, "residual", 30).fit(table)
    by_flu = {r.flu_index: r.p for r in model.transform(table).groupBy("flu_index").agg(F.avg("prediction").alias("p")).collect()}
    assert by_flu[9.0] - by_flu[1.0] > 7


def test_waiting_times_follow_a_planted_rule(spark):
    """The wait in 7 rows is twice the referrals of today."""
    rng = np.random.default_rng(6)
    referrals = rng.integers(1, 40, (4, 160))
    waits = np.concatenate([np.full((4, 7), 20), 2 * referrals[:, :-7]], axis=1)
    dates = pd.date_range("2025-01-01", periods=160).date
    rows_ = [(dates[i], f"H{k}", "S", float(waits[k, i]), int(referrals[k, i]), 5.0) for k in range(4) for i in range(160)]
    fact = spark.createDataFrame(rows_, "date_key date, hospital_id string, specialty_id string, median_wait_days double, referrals long, vacancy_rate double")
    model = training.WaitingTimes((7, 14), trees=40).fit(fact)
    got = model.predict(fact, 7).join(fact, ["date_key", "hospital_id", "specialty_id"]).filter("date_key > '2025-02-15'")
    # the referrals of a day are their seven-day mean less the days before, so the rule is there to be found
    assert got.agg(F.corr("pred_7d", F.col("referrals") * 2)).first()[0] > 0.6


def test_vectors_are_stored_in_few_partitions(spark, monkeypatch):
    df = spark.range(5000).selectExpr("CAST(id AS double) AS a", "CAST(id % 7 AS double) AS b", "id AS y").repartition(9)
    table = training.vectors(df, ["a", "b"], "y")
    assert table.rdd.getNumPartitions() == 1 and table.count() == 5000 and table.columns == ["features", "y"]
    monkeypatch.setattr(training, "VECTOR_BYTES", 2000)
    assert training.vectors(df, ["a", "b"], "y").rdd.getNumPartitions() > 1


def test_naive_backtest(spark):
    start = dt.date(2025, 1, 1)
    data = [(start + dt.timedelta(days=i), "H", "S", 50.0 + i % 7, 10 + i % 7 + (i > 69), 20.0 + i) for i in range(100)]
    fact = spark.createDataFrame(data, "date_key date, hospital_id string, specialty_id string, bed_occupancy_pct double, ae_attendances long, median_wait_days double")
    got = by_key(backtest.naive_backtest(fact, "2025-06-01"), "target")
    score = lambda target: tuple(got[target][c] for c in ("mae", "accuracy", "n_eval"))
    assert score("Capacity pressure") == (0.0, 100.0, 30)
    assert score("A&E demand")[::2] == (1.0, 30) and score("Waiting time")[::2] == (30.0, 30)


def test_backtest(fact):
    metrics, series = backtest.backtest(fact, "2025-06-01", trees=3)
    got = by_key(metrics, "target")
    assert set(got) == {"Capacity pressure", "A&E demand", "Waiting time"}
    assert [f.name for f in metrics.schema] == schemas.MODEL_METRICS.names
    for r in got.values():
        assert r["holdout_days"] == 30 and r["n_eval"] > 0 and 0 <= r["accuracy"] <= 100
    assert got["Capacity pressure"]["n_eval"] == 30 == series.count()
    assert got["Waiting time"]["n_eval"] == 60


def test_models_with_too_little_history_are_reported(spark, caplog):
    metrics, series = backtest.backtest(make_fact(spark, 40), "2025-06-01", trees=2)
    got = {r.target: (r.n_eval, r.mae) for r in metrics.collect()}
    assert got["Capacity pressure"] == (0, None) == got["Waiting time"] and got["A&E demand"][0] == 30
    assert series.count() == 0 and series.schema == schemas.FORECAST_ACTUAL
    assert "skipped" in caplog.text


def test_other_failures_are_raised(fact):
    with pytest.raises(Exception, match="median_wait_days"):
        backtest.backtest(fact.drop("median_wait_days"), "2025-06-01", trees=2)


def test_train_all(spark, fact, staff):
    hospitals = spark.createDataFrame(
        [(f"H{i}", "", f"T{i}", "", "LON", "Acute", 1) for i in range(8)], schemas.DIM_HOSPITAL
    )
    out = training.train_all(fact, staff, hospitals, "2025-06-01", trees=2, horizons=(7,))
    assert out.schema == schemas.FORECAST
    n = {r.target: r["count"] for r in out.groupBy("target").count().collect()}
    assert n == {"bed_occupancy": 90, "ae_demand": 240, "waiting_time": 300, "workforce_demand": 16}
    ids = [r.forecast_id for r in out.select("forecast_id").collect()]
    assert sorted(ids) == list(range(1, 647))
    assert out.filter("target = 'workforce_demand' AND (role IS NULL OR hospital_id IS NULL)").count() == 0


def test_registered_queries_use_the_production_trees(monkeypatch):
    from types import SimpleNamespace

    from checks import queries

    class Called(Exception):
        pass

    def recorded(*args, **kwargs):
        raise Called(kwargs.get("trees"))

    monkeypatch.setattr(queries, "_daily_fact", lambda d: None)
    monkeypatch.setattr(queries.training, "train_all", recorded)
    monkeypatch.setattr(queries.backtest, "backtest", recorded)
    for name in ("occupancy_rows", "waiting_rows", "workforce_rows"):
        monkeypatch.setattr(queries.training, name, recorded)
    builds = (queries.trained_forecasts, queries.gbt_backtest, queries.occupancy_forecasts, queries.waiting_forecasts,
              queries.workforce_forecasts)
    for build in builds:
        with pytest.raises(Called) as called:
            build(SimpleNamespace(workforce=lambda: None, hospitals=lambda: None))
        assert called.value.args == (None,)


def test_vectors_spread_a_pass_over_all_cores(spark):
    """A stored table of one row group is parted evenly by its bytes; a small one stays whole."""
    noise = [F.rand(i).alias(f"x{i}") for i in range(16)]
    made = spark.range(0, 60_000, 1, 1).select("id", *noise)
    wide = training.vectors(made, [f"x{i}" for i in range(16)], "id")
    held = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == wide.rdd.getNumPartitions() >= 3 and max(held) <= 1.1 * min(held)
    assert sum(held) == wide.select("id").distinct().count() == 60_000
    assert training.vectors(made.limit(100), ["x0"], "id").rdd.getNumPartitions() == 1
