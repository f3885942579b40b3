import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow import schemas
from wardflow.functions import codes
from wardflow.operators.snapshots import at_latest
from wardflow.plans import job
from wardflow.sources.tables import land

from .util import rows

START, END = dt.date(2025, 1, 1), dt.date(2025, 5, 1)


def feeds(spark):
    """121 calendar days of activity (the last day excluded) for three trusts and two specialties."""
    h = F.hash("trust_code", "specialty", "date")
    trusts = spark.createDataFrame([("RXA", "LON"), ("RXB", "LON"), ("RXC", "NW")], "trust_code string, region_id string")
    specialties = spark.createDataFrame([("CARD",), ("ENT",)], "specialty string")
    days = spark.range(120).select(F.date_add(F.lit(START), F.col("id").cast("int")).alias("date"))
    grid = trusts.join(specialties, F.lit(True)).join(days, F.lit(True))
    activity = grid.select(
        F.lower("trust_code").alias("trust_code"), "specialty", F.col("date").cast("string").alias("date"),
        (F.pmod(h, 40) + 5).cast("long").alias("admissions"), (F.pmod(h, 30) + 5).cast("long").alias("discharges"),
        (F.pmod(h, 90) + 60).cast("long").alias("bed_occupancy_count"), (F.pmod(h, 70) + 20).cast("long").alias("ae_attendances"),
        F.pmod(h, 25).cast("long").alias("referrals"),
    )
    waiting = grid.select("trust_code", "specialty", F.date_format("date", "yyyy-MM").alias("period")).distinct().withColumns(
        {"waiting_list_size": (F.pmod(F.hash("period", "trust_code"), 500) + 100).cast("long"),
         "median_wait_days": (F.pmod(F.hash("period", "specialty"), 40) + 5).cast("double")}
    )
    staff = trusts.select(
        "trust_code", F.explode(F.array(F.lit("Medical"), F.lit("Nursing"))).alias("role"), F.lit(100).cast("long").alias("staff_count"),
        F.pmod(F.hash("trust_code"), 20).cast("long").alias("vacancies"),
    ).withColumn("vacancy_rate", F.col("vacancies").cast("double"))
    illness = days.select(F.col("date").cast("string").alias("date"), F.lit(3.0).alias("flu_index"), (F.dayofmonth("date") / 10).alias("covid_index"))
    weather = days.join(trusts.select("region_id").distinct(), F.lit(True)).select(
        F.col("date").cast("string").alias("date"), "region_id", F.month("date").cast("double").alias("avg_temp_c")
    )
    hospitals = trusts.select(
        codes.site_id(F.col("trust_code"), F.lit(0)).alias("hospital_id"), F.concat("trust_code", F.lit(" NHS Trust")).alias("hospital_name"),
        "trust_code", F.col("trust_code").alias("trust_name"), "region_id", F.lit("Acute").alias("hospital_type"), F.lit(200).alias("bed_capacity"),
    )
    dim_spec = specialties.select(F.col("specialty").alias("specialty_id"), F.initcap("specialty").alias("specialty_name"),
                                  F.lit("Medicine").alias("category"), F.lit(False).alias("is_emergency"))
    regions = spark.createDataFrame([("LON", "London", None, "England", 9), ("NW", "North West", None, "England", 7)], schemas.DIM_REGION)
    people = spark.createDataFrame([("LON", "London", 9, "England")], schemas.DEMOGRAPHICS)
    return {"activity": activity, "waiting_list": waiting, "workforce": staff, "illness": illness, "weather": weather,
            "demographics": people, "dim_hospital": hospitals, "dim_specialty": dim_spec, "dim_region": regions}


def test_whole_job(spark, tmp_path):
    landing, warehouse = f"{tmp_path}/landing", f"{tmp_path}/warehouse"
    land(feeds(spark), landing, "2025-05-01")
    land({"activity": feeds(spark)["activity"]}, landing, "2025-05-02")  # delivered twice
    tables = job.build_warehouse(job.landed_feeds(spark, landing), warehouse, START, END)
    fact = tables["hospital_activity_fact"]
    assert fact.count() == 3 * 2 * 120 and fact.select("activity_id").distinct().count() == 720
    dates = tables["dim_date"].agg(F.min("date_key"), F.max("date_key"), F.count("*")).first()
    assert tuple(dates) == (START, END, (END - START).days + 1)
    assert tables["hospital_activity_features"].count() == 720
    newest = at_latest(spark.table("hospital_activity_fact"))
    assert newest.count() == 6
    plan = newest._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date_key" in plan and len(list((tmp_path / "warehouse" / "hospital_activity_fact").glob("date_key=*"))) == 120

    tables = job.analyse(tables, warehouse, END, trees=2, horizons=(30,))
    assert tables["risk_score"].count() == 3
    assert tables["ml_forecast"].filter("target = 'bed_occupancy'").count() == 90
    assert spark.table("model_metrics").count() == 3
    assert spark.table("recommendation").schema == schemas.RECOMMENDATION
    for view in ("v_national_pressure", "v_forecast_long", "v_regional_risk_latest", "v_top_risk_trusts"):
        assert spark.table(view).count() > 0
    assert rows(spark.table("v_national_pressure").agg(F.count("*"))) == [(120,)]


def test_date_range():
    today = dt.date(2025, 7, 1)
    assert job.date_range([], today) == (dt.date(2025, 1, 2), today)
    assert job.date_range(["2025-01-01", "2025-02-01"], today) == (dt.date(2025, 1, 1), dt.date(2025, 2, 1))
    assert job.date_range(["2025-01-01"], today) == (dt.date(2025, 1, 1), today)
    with pytest.raises(ValueError):
        job.date_range(["2025-08-01"], today)
