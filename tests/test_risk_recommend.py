import json

import pytest
from pyspark.sql import functions as F

from wardflow import schemas
from wardflow.functions.scoring import severity_rank
from wardflow.plans import recommend, risk, serving, views

from .util import by_key, day, rows

COLUMNS = "hospital_id string, date_key date, bed_occupancy_pct double, waiting_list_size long, vacancy_rate double, ae_attendances long"


def hospitals_on(spark, occ, wl, vac, ae):
    n = len(occ)
    full = [v if isinstance(v, list) else [v] * n for v in (occ, wl, vac, ae)]
    data = [(f"H{i + 1}", day("2025-06-01"), float(full[0][i]), full[1][i], float(full[2][i]), full[3][i]) for i in range(n)]
    return spark.createDataFrame(data, COLUMNS)


def test_worst_hospital_scores_highest(spark):
    out = risk.compute_risk(hospitals_on(spark, [95, 70, 80, 88], [1000, 800, 1100, 1300], [12, 4, 8, 14], [400, 100, 200, 350]))
    got = by_key(out, "hospital_id")
    assert max(got.values(), key=lambda r: r["score"])["hospital_id"] == "H4"
    assert {r["classification"] for r in got.values()} <= {"Green", "Amber", "Red"}
    assert [got[f"H{i}"]["risk_id"] for i in range(1, 5)] == [1, 2, 3, 4]


def test_identical_hospitals_score_zero(spark):
    out = risk.compute_risk(hospitals_on(spark, [80, 80], 1000, 5, 100))
    assert out.count() == 2
    assert rows(out.select("bed_occupancy_z", "waiting_list_z", "vacancy_rate_z", "ae_surge_z", "score").distinct()) == [(0.0,) * 5]


def test_missing_columns_get_defaults(spark):
    df = hospitals_on(spark, [80, 90], 1000, 5, 100).drop("vacancy_rate", "ae_attendances")
    assert risk.compute_risk(df).count() == 2


def test_safety_limit_escalates(spark):
    out = risk.compute_risk(hospitals_on(spark, [96, 88, 89, 90], 1000, 5, 200))
    h1 = by_key(out, "hospital_id")["H1"]
    assert h1["classification_relative"] != "Red"
    assert h1["classification_absolute"] == "Red" and h1["classification"] == "Red"
    assert json.loads(h1["components_json"])["trigger"] == "absolute"


def test_final_is_never_softer(spark):
    out = risk.compute_risk(hospitals_on(spark, [96, 70, 82, 91], [1400, 800, 1000, 1200], [16, 3, 7, 11], [420, 90, 180, 300]))
    rank = {c: severity_rank(F.col(c)).alias(c) for c in ("classification", "classification_relative", "classification_absolute")}
    for r in out.select(*rank.values()).collect():
        assert r.classification >= max(r.classification_relative, r.classification_absolute)


@pytest.fixture(scope="module")
def history(spark):
    """Two hospitals with a past, one without; H2 misses the newest specialty row."""
    data = [
        ("H1", "A", "2025-01-01", 100, 10), ("H1", "A", "2025-02-01", 200, 10), ("H1", "A", "2025-03-10", 300, 10),
        ("H1", "B", "2025-03-10", 50, 30), ("H2", "A", "2025-02-08", 0, 8), ("H2", "A", "2025-03-03", 10, 4),
        ("H2", "A", "2025-03-10", 10, 12), ("H3", "A", "2025-03-10", 7, 1), ("H4", "A", "2025-01-01", 7, 1),
    ]
    return spark.createDataFrame(
        [(h, s, day(d), w, a) for h, s, d, w, a in data],
        "hospital_id string, specialty_id string, date_key date, waiting_list_size long, ae_attendances long",
    )


def test_components(history):
    got = by_key(risk.components(history), "hospital_id")
    assert set(got) == {"H1", "H2", "H3"}  # H4 has no row on the newest date
    assert got["H1"]["waiting_list_growth"] == pytest.approx((0.5 + 0.0) / 2)
    assert got["H1"]["waiting_list_size"] == 350 and got["H1"]["ae_attendances"] == 40
    assert got["H1"]["ae_7d"] == 40 and got["H1"]["ae_baseline_7d"] == 105.0
    assert got["H2"]["ae_7d"] == 16 and got["H2"]["ae_baseline_7d"] == 56.0  # 8 inclusive days
    assert got["H2"]["ae_surge_index"] == pytest.approx(-40 / 56)
    assert got["H2"]["waiting_list_growth"] == 0.0  # zero base counts as no growth


def test_growth_forms(history):
    sql_form = by_key(risk.growth_30d(history), "hospital_id")
    assert sql_form["H1"]["waiting_list_growth_30d"] == pytest.approx(0.25)
    assert sql_form["H2"]["waiting_list_growth_30d"] is None and sql_form["H3"]["waiting_list_growth_30d"] == 0.0
    zero_form = by_key(risk.growth_30d(history, zero_for_null=True), "hospital_id")
    assert zero_form["H2"]["waiting_list_growth_30d"] == 0.0


def test_null_components_stay_valid_json(spark):
    df = hospitals_on(spark, [70, 80, 90], 1000, 5, 100).withColumn(
        "bed_occupancy_pct", F.when(F.col("hospital_id") != "H1", F.col("bed_occupancy_pct"))
    )
    r = by_key(risk.compute_risk(df), "hospital_id")["H1"]
    assert json.loads(r["components_json"])["bed_occupancy_pct"] is None
    assert r["score"] is None and r["classification"] == "Red"


@pytest.fixture(scope="module")
def world(spark):
    fact = spark.createDataFrame(
        [
            ("H1", "S", day("2025-05-01"), 80.0, 100, 12.0, 10), ("H1", "S", day("2025-06-01"), 95.5, 120, 12.0, 30),
            ("H2", "S", day("2025-06-01"), 50.0, 100, 1.0, 10), ("H3", "S", day("2025-06-01"), None, None, None, None),
        ],
        "hospital_id string, specialty_id string, date_key date, bed_occupancy_pct double, "
        "waiting_list_size long, vacancy_rate double, ae_attendances long",
    )
    scored = spark.createDataFrame(
        [
            (1, day("2025-06-01"), "H1", None, "Red", '{"ae_surge_index": 0.5}'),
            (2, day("2025-05-01"), "H1", None, "Green", '{"ae_surge_index": 0.1}'),
            (3, day("2025-06-01"), "H2", None, "Green", '{"ae_surge_index": 9}'),
            (4, day("2025-06-01"), "H3", None, "Amber", '{"ae_surge_index": null}'),
        ],
        schemas.RISK,
    )
    hospitals = spark.createDataFrame(
        [(f"H{i}", f"Place {i} NHS Trust", f"T{i}", "", "LON", "Acute", 1) for i in (1, 2, 3)], schemas.DIM_HOSPITAL
    )
    staff = spark.createDataFrame(
        [("T1", "Nursing", 3.0), ("T1", "Medical", 9.0), ("T1", "Admin", 9.0)], "trust_code string, role string, vacancy_rate double"
    )
    return fact, scored, hospitals, staff


def test_recommendations(world):
    got = recommend.recommendations(*world, "2025-06-02").orderBy("recommendation_id").collect()
    assert [(r.recommendation_id, r.hospital_id, r.severity, r.category) for r in got] == [
        (1, "H1", "High", "Staffing"), (2, "H1", "High", "Capacity"), (3, "H1", "High", "Workload"), (4, "H1", "High", "Pathway"),
    ]
    assert got[0].action.startswith("Trust H1 has a 12.0% vacancy rate.") and "the Admin role." in got[0].action
    assert got[1].action.startswith("Bed occupancy at 95.5% — open 8–12 surge beds")
    assert got[2].action.startswith("Waiting list grew 20.0% in 30 days.")
    assert got[3].action.startswith("A&E attendances 30% above 7-day baseline.")  # mean over all dates
    assert {str(r.date_key) for r in got} == {"2025-06-02"}


def test_rule_inputs_fill_missing_values(world):
    h3 = by_key(recommend.rule_inputs(*world), "hospital_id")["H3"]
    assert (h3["vacancy_rate"], h3["bed_occupancy_pct"], h3["ae_surge_index"], h3["top_role"]) == (0.0, 0.0, 0.0, "Nursing")


def test_recommendation_list_orders(spark):
    recs = spark.createDataFrame(
        [(1, None, "H1", "High", "c", "a", "e"), (2, None, "H9", "Medium", "c", "a", "e")], schemas.RECOMMENDATION
    )
    hospitals = spark.createDataFrame([("H1", "One")], "hospital_id string, hospital_name string")
    assert [(r.severity, r.hospital_name) for r in serving.recommendation_list(recs, hospitals).collect()] == [
        ("Medium", None), ("High", "One")
    ]
    assert [r.severity for r in serving.recommendation_list(recs, hospitals, ranked=True).collect()] == ["High", "Medium"]


def test_views(spark, world):
    fact, scored, hospitals, _ = world
    regions = spark.createDataFrame([("LON", "London", None, "England", None)], schemas.DIM_REGION)
    scored = scored.withColumn("score", F.col("risk_id").cast("decimal(6,3)"))
    fact = fact.withColumns({"admissions": F.lit(1), "discharges": F.lit(2)})
    forecast = spark.createDataFrame([], schemas.FORECAST)
    views.register(
        {"hospital_activity_fact": fact, "risk_score": scored, "ml_forecast": forecast, "dim_hospital": hospitals,
         "dim_region": regions, "dim_specialty": spark.createDataFrame([], schemas.DIM_SPECIALTY)}
    )
    for name in ("v_national_pressure", "v_regional_risk_latest", "v_top_risk_trusts", "v_forecast_long"):
        assert spark.catalog.tableExists(name)
    regional = spark.table("v_regional_risk_latest").first()
    assert (regional.red_count, regional.amber_count, regional.green_count) == (1, 1, 1)
    assert [r.score for r in spark.table("v_top_risk_trusts").collect()] == [4, 3, 1]
    assert serving.red_in_top_list(spark.table("v_top_risk_trusts")).first()[0] == 1
    kpis = serving.kpi_row(spark.table("v_national_pressure"), scored).first()
    assert kpis.asDict() == {
        "latest_date": "2025-06-01", "ae_attendances": 40, "avg_bed_occupancy_pct": 72.8,
        "total_waiting_list": 220, "avg_vacancy_rate": 6.5, "trusts_red": 1,
    }
    assert rows(risk.class_counts(scored)) == [(4, 1, 1, 2)]
    with pytest.raises(ValueError):
        serving.pressure_last_days(fact, 366)


def test_entitlement(spark):
    df = spark.createDataFrame([("LON", 1), ("NW", 2)], "region_id string, n int")
    users = spark.createDataFrame([("a@x", "LON"), ("a@x", "LON"), ("b@x", "NW")], schemas.ENTITLEMENT)
    assert rows(serving.entitled(df, users, "a@x")) == [("LON", 1)]
    assert serving.entitled(df, users, "nobody").count() == 0


def test_validation_listings(spark):
    metrics = spark.createDataFrame([("A", "m", 1.0, 10.0, 90.0, 5, 30, None), ("B", "m", 1.0, 10.0, 60.0, 5, 30, None)], schemas.MODEL_METRICS)
    assert [r.band for r in serving.validation_metrics(metrics).orderBy("target").collect()] == ["Green", "Red"]
    assert serving.model_accuracy(metrics).first()[0] == 75.0
    series = spark.createDataFrame([("A", day("2025-01-02"), 1.0, 2.0), ("A", day("2025-01-01"), 1.0, 2.0)], schemas.FORECAST_ACTUAL)
    assert [str(r.date) for r in serving.validation_series(series).collect()] == ["2025-01-01", "2025-01-02"]
