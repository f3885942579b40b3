import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardflow import schemas
from wardflow.plans import silver, star
from wardflow.sources.layers import store

from .util import by_key, day, rows


def test_clean_waiting_list(spark):
    data = [
        (" rxh-", "CARD", "2025-01", 100, 10.0, 1), ("RXH", "CARD", "2025-01", 999, 99.0, 2),
        (None, "CARD", "2025-01", 1, 1.0, 3), ("toolong", "CARD", "2025-01", 1, 1.0, 4),
        ("RXH", "CARD", "2025-02", -5, 400.0, 5), ("RXH", "ENT", "2025-02", 300_000, None, 6),
        ("RXJ", "ENT", "2025-02", None, float("nan"), 7),
    ]
    df = spark.createDataFrame(
        data, "Trust_Code string, specialty string, period string, waiting_list_size long, "
              "median_wait_days double, ingest_order int"
    )
    got = silver.clean_waiting_list(df)
    assert rows(got.select("trust_code", "specialty_id", "period", "waiting_list_size", "median_wait_days")) == [
        ("RXH", "CARD", "2025-01", 100.0, 10.0), ("RXH", "CARD", "2025-02", 0.0, 365.0),
        ("RXH", "ENT", "2025-02", 200000.0, 187.5), ("RXJ", "ENT", "2025-02", None, 187.5),
    ]


def test_clean_activity(spark):
    data = [("r1k", "S", "2025-01-01", i, None, 1.0, 2.0, 3.0, i) for i in (5, 7)]
    data += [("R1K", "S", f"2025-01-{d:02d}", 10, 4, -3.0, 0.5, 2.5, 10 + d) for d in range(2, 6)]
    data += [("R1K", "S", "not a date", 1, 1, 1.0, 1.0, 1.0, 90), ("!", "S", "2025-01-01", 1, 1, 1.0, 1.0, 1.0, 91)]
    df = spark.createDataFrame(
        data, "trust_code string, specialty string, date string, admissions int, discharges int, "
              "bed_occupancy_count double, ae_attendances double, referrals double, ingest_order int"
    )
    got = by_key(silver.clean_activity(df), "date")
    assert len(got) == 5
    first, second = got[day("2025-01-01")], got[day("2025-01-02")]
    assert (first["admissions"], first["discharges"], first["ae_attendances"]) == (5, 0, 2)
    # lower bound 0, rounding half to even
    assert (second["bed_occupancy_count"], second["ae_attendances"], second["referrals"]) == (0, 0, 2)


def test_other_cleaners(spark):
    staff = spark.createDataFrame(
        [("rx1", "Nursing", 60.0, 1), ("RX1", "Nursing", 5.0, 2), ("?", "Nursing", -1.0, 3)],
        "trust_code string, role string, vacancy_rate double, ingest_order int",
    )
    assert rows(silver.clean_workforce(staff)) == [(None, "Nursing", 0.0), ("RX1", "Nursing", 50.0)]
    ill = spark.createDataFrame(
        [("2025-01-01", 70.0, None, 1), ("2025-01-01", 1.0, 1.0, 2), ("bad", 1.0, 1.0, 3)],
        "date string, flu_index double, covid_index double, ingest_order int",
    )
    assert rows(silver.clean_illness(ill)) == [(day("2025-01-01"), 50.0, None)]
    heat = spark.createDataFrame(
        [("2025-01-01", "LON", -40.0, 1), ("2025-01-01", None, 1.0, 2)],
        "date string, region_id string, avg_temp_c double, ingest_order int",
    )
    assert rows(silver.clean_weather(heat)) == [(day("2025-01-01"), "LON", -15.0)]
    dim = spark.createDataFrame([(" H1 ", 1), ("H1", 2)], "hospital_id string, ingest_order int")
    assert rows(silver.clean_dim_hospital(dim)) == [("H1",)]


def test_unknown_feed_is_skipped(spark, caplog):
    df = spark.createDataFrame([("A", 1)], "region_id string, ingest_order int")
    got = silver.clean_all({"dim_region": df, "mystery": df})
    assert list(got) == ["dim_region"] and "mystery" in caplog.text


@pytest.fixture(scope="module")
def frames(spark):
    d = day
    activity = spark.createDataFrame(
        [("T1", "S1", d("2025-01-31"), 1, 2, 90, 4, 5), ("T1", "S1", d("2025-02-01"), 1, 2, 50, 4, 5),
         ("T2", "S1", d("2025-02-01"), 1, 2, 50, 4, 5), ("T9", "S1", d("2025-02-01"), 1, 2, 50, 4, 5)],
        "trust_code string, specialty_id string, date date, admissions long, discharges long, "
        "bed_occupancy_count long, ae_attendances long, referrals long",
    )
    waiting = spark.createDataFrame(
        [("T1", "S1", "2025-01", 10.0, 4.0), ("T1", "S1", "2025-02", 20.0, 6.0), ("T1", "S1", "2025-02-15", 5.0, 7.0)],
        "trust_code string, specialty_id string, period string, waiting_list_size double, median_wait_days double",
    )
    staff = spark.createDataFrame(
        [("T1", "Nursing", 100, 10, 10.0), ("T1", "Medical", 50, None, 20.0), ("T2", "Nursing", 0, 0, 0.0), (None, "x", 1, 1, 1.0)],
        "trust_code string, role string, staff_count long, vacancies long, vacancy_rate double",
    )
    illness = spark.createDataFrame([(d("2025-02-01"), 3.25, 1.0)], "date date, flu_index double, covid_index double")
    weather = spark.createDataFrame(
        [(d("2025-02-01"), "LON", 5.25), (d("2025-02-01"), None, 9.0)], "date date, region_id string, avg_temp_c double"
    )
    hospitals = spark.createDataFrame(
        [("H1", "A NHS Trust – Site 1", "T1", "A", "LON", "Acute", 100), ("H2", "B", "T2", "B", "NW", "Acute", 0)],
        schemas.DIM_HOSPITAL,
    )
    return activity, waiting, staff, illness, weather, hospitals


def test_fact(frames):
    got = [r.asDict() for r in star.build_fact(*frames).orderBy("activity_id").collect()]
    assert list(got[0]) == schemas.FACT.names
    assert [r["activity_id"] for r in got] == [1001, 2001, 3001, 4001]
    by = {(r["hospital_id"], str(r["date_key"])): r for r in got}
    jan, feb = by["H1", "2025-01-31"], by["H1", "2025-02-01"]
    assert (jan["waiting_list_size"], feb["waiting_list_size"]) == (10, 25)
    assert feb["median_wait_days"] == Decimal("6.50")
    assert (jan["bed_occupancy_pct"], feb["vacancy_rate"]) == (Decimal("90.00"), Decimal("6.67"))
    assert (feb["staff_count"], feb["vacancies"], feb["avg_temp_c"]) == (150, 10, Decimal("5.3"))
    assert jan["flu_index"] is None and feb["flu_index"] == Decimal("3.25")
    empty = by["H2", "2025-02-01"]  # no beds, no staff: no percentage
    assert empty["bed_occupancy_pct"] is None and empty["vacancy_rate"] is None and empty["avg_temp_c"] is None
    assert (None, "2025-02-01") in by  # unknown trust stays, the integrity report names it


def test_fact_without_waiting_feed(frames):
    activity, _, *rest = frames
    got = star.build_fact(activity, None, *rest, with_ids=False)
    assert got.filter("waiting_list_size IS NOT NULL OR activity_id IS NOT NULL").count() == 0


def test_unused_joins_are_dropped(frames):
    plan = star.build_fact(*frames).groupBy("date_key").agg(F.sum("admissions"))._jdf.queryExecution().optimizedPlan().toString()
    assert "staff_count" not in plan and "median_wait_days" not in plan and "_before" not in plan


def test_fan_out_is_reported(spark, frames):
    activity, waiting, staff, illness, weather, hospitals = frames
    more = hospitals.unionByName(
        spark.createDataFrame([("H3", "C", "T1", "A", "LON", "Acute", 10)], schemas.DIM_HOSPITAL)
    )
    fact = store(star.build_fact(activity, waiting, staff, illness, weather, more), "fact")
    assert fact.filter("hospital_id IN ('H1', 'H3')").count() == 4
    dates = spark.createDataFrame([(day("2025-01-31"),), (day("2025-02-01"),)], "date_key date")
    spec = spark.createDataFrame([("S1",)], "specialty_id string")
    regions = spark.createDataFrame([("LON",)], "region_id string")
    got = dict(rows(star.integrity_report(fact, dates, more, spec, regions)))
    assert got["trust with several hospitals"] == 1 and got["fact NULL keys"] == 1
    assert got["fact without region"] == 2 and got["fact duplicate grain"] == 0 and got["missing calendar days"] == 0


def test_feature_table_keeps_the_rows(spark):
    start = dt.date(2025, 1, 1)
    data = [(start + dt.timedelta(days=i), h, "S", "LON", 50.0 + i, 10 + i, 3.0 * i) for i in range(9) for h in ("H1", "H2")]
    df = spark.createDataFrame(
        data, "date_key date, hospital_id string, specialty_id string, region_id string, "
              "bed_occupancy_pct double, waiting_list_size long, median_wait_days double"
    )
    out = star.feature_table(df)
    assert out.count() == 18
    last = out.filter("hospital_id = 'H1' AND date_key = '2025-01-09'").first()
    assert (last.bed_occupancy_pct_lag7, last.waiting_list_size_roll7, last.month) == (51.0, 15.0, 1)
    assert last.median_wait_days_regional_z > 0
