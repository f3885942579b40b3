import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.functions import calendar, codes, numbers, scoring, text

from .util import column, day, rows


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (5.0,), (99.0,)], "x double")
    assert column(df.select(numbers.clip(F.col("x"), 0, 10).alias("y")), "y") == [None, 0.0, 5.0, 10.0]
    assert column(df.select(numbers.clip(F.col("x"), None, 10).alias("y")), "y") == [None, -1.0, 5.0, 10.0]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, n int")
    assert rows(numbers.nan_to_null(df)) == [(None, 1), (2.0, 2)]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 0), (1, 8), (None, 2)], "a int, b int")
    out = df.select(numbers.ratio(F.col("a"), F.col("b")).alias("r"), numbers.percent(F.col("a"), F.col("b")).alias("p"))
    got = [(r.r, None if r.p is None else float(r.p)) for r in out.collect()]
    assert got == [(None, None), (0.125, 12.5), (None, None)]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (None,)], "x double")
    assert column(df.select(numbers.half_even_long(F.col("x")).alias("y")), "y") == [0, 2, 2, 0]


def test_rounding(spark):
    values = [9.35, 156.25, 12.25, 0.05, 0.15, 2.675, 139478.05, -1.25, -0.35, 1e9 + 0.25, 0.0, 99.95, 1234.5678]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    got = df.select(
        numbers.round_exact(x, 1).alias("r1"), numbers.round_exact(x, 2).alias("r2"), numbers.one_decimal(x).alias("t"),
        numbers.round_even(x, 2).alias("e"), numbers.no_decimal(x).alias("n"),
    ).collect()
    assert [r.r1 for r in got] == [round(v, 1) for v in values]
    assert [r.r2 for r in got] == [round(v, 2) for v in values]
    assert [r.t for r in got] == [f"{v:.1f}" for v in values]
    assert [r.e for r in got] == list(np.round(values, 2))
    assert [r.n for r in got] == [f"{v:.0f}".replace("-0", "0") for v in values]
    up = df.filter("x = 156.25").select(numbers.round_exact(x, 1, ties_up=True), numbers.round_scaled(x, 1)).first()
    assert tuple(up) == (156.3, 156.3)
    nothing = spark.createDataFrame([(None,)], "x double").select(numbers.round_exact(x, 1), numbers.one_decimal(x))
    assert tuple(nothing.first()) == (None, None)


def test_mean_and_sums(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 4)], "k int, x int")
    out = df.groupBy("k").agg(numbers.mean(F.col("x")).alias("m"), numbers.sum_or_zero(F.col("x")).alias("s"))
    assert rows(out) == [(1, None, 0), (2, 4.0, 4)]


def test_to_number(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "t string")
    assert column(df.select(numbers.to_number(F.col("t")).alias("y")), "y") == [1.5, None, None]


def test_dates(spark):
    df = spark.createDataFrame([("2025-02-28",), ("nonsense",), (None,)], "t string")
    assert column(df.select(calendar.parse_date(F.col("t")).alias("d")), "d") == [day("2025-02-28"), None, None]
    with pytest.raises(Exception):
        df.select(calendar.parse_date_strict(F.col("t"))).collect()


def test_dim_date_is_complete(spark):
    dim = calendar.build_dim_date(spark, "2024-12-30", "2025-03-02")
    assert dim.count() == 63
    first = dim.orderBy("date_key").first()
    assert first.asDict() == {
        "date_key": day("2024-12-30"), "year": 2024, "quarter": 4, "month": 12, "month_name": "December",
        "week": 1, "day_of_week": 1, "day_name": "Monday", "is_weekend": False, "season": "Winter",
        "flu_season_flag": True,
    }


def test_seasons(spark):
    df = spark.createDataFrame([(dt.date(2025, m, 1),) for m in range(1, 13)], "d date")
    got = column(df.select(calendar.season(F.col("d")).alias("s")), "s")
    assert got == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"]
    flu = column(df.select(calendar.is_flu_season(F.col("d")).alias("s")), "s")
    assert [i + 1 for i, f in enumerate(flu) if f] == [1, 2, 3, 10, 11, 12]


def test_day_and_minute(spark):
    df = spark.createDataFrame([("2025-01-01T10:11:12.5+00:00",)], "t string")
    got = df.select(
        calendar.minute(F.col("t")).alias("m"), calendar.day(F.col("t").cast("timestamp")).alias("d"),
        calendar.year_month(F.lit("2025-07-31").cast("date")).alias("ym"),
        calendar.period_month(F.lit("2025-07-31")).alias("p"),
    ).first()
    assert got.m == dt.datetime(2025, 1, 1, 10, 11) and got.d == dt.datetime(2025, 1, 1)
    assert (got.ym, got.p) == ("2025-07", "2025-07")


def test_future_curves(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1),), (dt.date(2025, 7, 1),), (dt.date(2025, 12, 1),)], "d date")
    got = df.select(
        calendar.seasonal_index(F.col("d"), 1, 5.0, 2.0).alias("flu"),
        calendar.seasonal_temperature(F.col("d")).alias("t"),
    ).collect()
    assert [round(r.flu, 6) for r in got] == [7.0, 2.0, round(2 + 5 * (1 - 1 / 6), 6)]
    assert [round(r.t, 6) for r in got] == [10.0, 20.0, round(10 + 10 * (1 - 5 / 6), 6)]


def test_trust_code(spark):
    values = [" rxh ", "r-1k.", "ab", "abcdef", None, "r1k5!", ""]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert column(df.select(codes.trust_code(F.col("c")).alias("y")), "y") == [
        "RXH", "R1K", None, None, None, "R1K5", None
    ]


def test_regions(spark):
    values = ["LS1 4AP", "E1 1AA", "B15 2GW", "ZZ9", None, "123", "sw1a", "M13"]
    df = spark.createDataFrame([(v,) for v in values], "p string")
    assert column(df.select(codes.region_for_postcode(F.col("p")).alias("y")), "y") == [
        "YOR", "LON", "MDL", "MDL", "MDL", "MDL", "LON", "NW"
    ]
    labels = spark.createDataFrame([("East",), ("Wales",), ("North West",), (None,)], "l string")
    assert column(labels.select(codes.region_for_label(F.col("l")).alias("y")), "y") == ["EST", "Wales", "NW", None]


def test_organisation_texts(spark):
    df = spark.createDataFrame([("KING'S COLLEGE-SIDE NHS TRUST",), ("Mental Health and ambulance",), ("X AMBULANCE",),
                                ("community wellbeing",), ("Y COMMUNITY",)], "n string")
    got = df.select(codes.organisation_name(F.col("n")).alias("n"), codes.organisation_type(F.col("n")).alias("t"))
    assert [r.n for r in got.collect()][0] == "King'S College-Side NHS Trust"
    assert column(got, "t") == ["Acute", "Mental Health", "Ambulance", "Mental Health", "Community"]


def test_sites_and_beds(spark):
    df = spark.createDataFrame([("RXH", 0)], "c string, i int")
    got = df.select(
        codes.site_id(F.col("c"), F.col("i")).alias("id"), codes.site_name(F.col("c"), F.col("i")).alias("n"),
        codes.modelled_beds(F.col("c")).alias("b"), codes.short_name(F.lit("Leeds NHS Trust – Site 1")).alias("s"),
    ).first()
    assert (got.id, got.n, got.s) == ("H_RXH_00", "RXH – Site 1", "Leeds")
    assert 300 <= got.b <= 1500 and got.b % 50 == 0


def test_relative_class(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, 0.0, 0.5, 0.99, 1.0, 3.0, float("nan"), None)], "s double")
    assert column(df.select(scoring.relative_class(F.col("s")).alias("y")), "y") == [
        "Green", "Amber", "Amber", "Amber", "Red", "Red", "Red", "Red"
    ]


def test_absolute_class(spark):
    data = [(96.0, 5.0), (93.0, 5.0), (85.0, 5.0), (80.0, 16.0), (80.0, 12.0), (None, None), (None, 15.0)]
    df = spark.createDataFrame(data, "o double, v double")
    assert column(df.select(scoring.absolute_class(F.col("o"), F.col("v")).alias("y")), "y") == [
        "Red", "Amber", "Green", "Red", "Amber", "Green", "Red"
    ]


def test_worse_of_and_bands(spark):
    df = spark.createDataFrame([("Green", "Red"), ("Amber", "Green"), ("Red", "Amber")], "a string, b string")
    assert column(df.select(scoring.worse_of(F.col("a"), F.col("b")).alias("y")), "y") == ["Red", "Amber", "Red"]
    nums = spark.createDataFrame([(12.0,), (8.0,), (7.9,)], "x double")
    assert column(nums.select(scoring.vacancy_band(F.col("x")).alias("y")), "y") == ["Red", "Amber", "Green"]
    acc = spark.createDataFrame([(85.0,), (70.0,), (69.0,)], "x double")
    assert column(acc.select(scoring.accuracy_band(F.col("x")).alias("y")), "y") == ["Green", "Amber", "Red"]


QUESTIONS = {
    "Why are waiting times rising?": "wait",
    "A&E surge last week?": "ae",
    "Staff vacancies in London": "staff",
    "bed occupancy trend": "bed",
    "Which trusts are at risk of overload?": "risk",
    "hello": "risk",
}


def test_intents(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "q string")
    assert column(df.select(text.intent(F.col("q")).alias("y")), "y") == list(QUESTIONS.values())


def test_agent_plan(spark):
    qs = ["forecast beds and nurses, any red flags?", "hello", "doctor rota"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert column(df.select(text.agent_plan(F.col("q")).alias("y")), "y") == [
        ["ForecasterAgent", "RiskAgent"] if "nurse" not in qs[0] else ["ForecasterAgent", "WorkforceAgent", "RiskAgent"],
        ["RiskAgent"], ["WorkforceAgent"],
    ]


def test_query_audit(spark):
    logged = {
        "DROP TABLE foo": "not a select",
        "SELECT 1; SELECT 2": "multiple statements",
        "SELECT 1 FROM v_national_pressure LIMIT 1": None,
        "SELECT 1 FROM v_national_pressure LIMIT 1 ;": None,
        "SELECT * FROM secret_table LIMIT 1": "no allowed table",
        "select 1 from risk_score where x = 'a' and Drop": "forbidden keyword",
        "\n select dropped from Risk_Score": None,
    }
    df = spark.createDataFrame([(q,) for q in logged], "q string")
    assert column(df.select(text.audit_reason(F.col("q")).alias("y")), "y") == list(logged.values())


def test_zscore_without_spread(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (9.0, 1.0, 1.0), (1.0, 1.0, None)], "x double, m double, s double")
    z = scoring.zscore(F.col("x"), F.col("m"), F.col("s"), 3.0)
    assert column(df.select(z.alias("z")), "z") == [0.0, 3.0, 0.0]
    assert not math.isnan(3.0)
