"""Table schemas. Percentages are wider than they need to be, so that a ratio above 999.99 loads."""

from __future__ import annotations

from pyspark.sql import types as T

STR, DATE, TIME, BOOL = T.StringType(), T.DateType(), T.TimestampType(), T.BooleanType()
INT, LONG, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Landed feeds
WAITING_LIST = _schema(
    trust_code=STR, specialty=STR, period=STR, waiting_list_size=LONG, median_wait_days=DOUBLE,
)
ACTIVITY = _schema(
    trust_code=STR, specialty=STR, date=STR, admissions=LONG, discharges=LONG,
    bed_occupancy_count=LONG, ae_attendances=LONG, referrals=LONG,
)
WORKFORCE = _schema(
    trust_code=STR, role=STR, staff_count=LONG, vacancies=LONG, vacancy_rate=DOUBLE,
)
DEMOGRAPHICS = _schema(
    region_id=STR, region_name=STR, population=LONG, country=STR,
)
ILLNESS = _schema(
    date=STR, flu_index=DOUBLE, covid_index=DOUBLE,
)
WEATHER = _schema(
    date=STR, region_id=STR, avg_temp_c=DOUBLE,
)
ORGANISATIONS = _schema(
    Organisations=T.ArrayType(_schema(OrgId=STR, Name=STR, PostCode=STR))
)
WEATHER_DOCUMENT = _schema(
    region_id=STR,
    daily=_schema(time=T.ArrayType(STR), temperature_2m_mean=T.ArrayType(DOUBLE)),
)

# Star schema
DIM_DATE = _schema(
    date_key=DATE, year=INT, quarter=INT, month=INT, month_name=STR, week=INT, day_of_week=INT,
    day_name=STR, is_weekend=BOOL, season=STR, flu_season_flag=BOOL,
)
DIM_HOSPITAL = _schema(
    hospital_id=STR, hospital_name=STR, trust_code=STR, trust_name=STR, region_id=STR,
    hospital_type=STR, bed_capacity=INT,
)
DIM_SPECIALTY = _schema(
    specialty_id=STR, specialty_name=STR, category=STR, is_emergency=BOOL,
)
DIM_REGION = _schema(
    region_id=STR, region_name=STR, icb_code=STR, country=STR, population=INT,
)
FACT = _schema(
    activity_id=LONG, date_key=DATE, hospital_id=STR, specialty_id=STR, region_id=STR,
    admissions=LONG, discharges=LONG, bed_occupancy_pct=T.DecimalType(9, 2),
    bed_occupancy_count=LONG, waiting_list_size=LONG, median_wait_days=T.DecimalType(10, 2),
    staff_count=LONG, vacancies=LONG, vacancy_rate=T.DecimalType(9, 2), ae_attendances=LONG,
    referrals=LONG, flu_index=T.DecimalType(9, 2), covid_index=T.DecimalType(9, 2),
    avg_temp_c=T.DecimalType(9, 1),
)
#: The fact as it is loaded by days: a row's place within its day instead of the id over all days.
DAY_FACT = T.StructType([*FACT.fields[1:], T.StructField("day_position", LONG)])

# Analytics tables
FORECAST = _schema(
    forecast_id=LONG, date_key=DATE, hospital_id=STR, specialty_id=STR, role=STR, target=STR,
    horizon_days=INT, yhat=T.DecimalType(14, 2), yhat_lower=T.DecimalType(14, 2),
    yhat_upper=T.DecimalType(14, 2), model=STR, is_future=BOOL,
)
RISK = _schema(
    risk_id=LONG, date_key=DATE, hospital_id=STR, score=T.DecimalType(6, 3), classification=STR,
    components_json=STR,
)
RECOMMENDATION = _schema(
    recommendation_id=LONG, date_key=DATE, hospital_id=STR, severity=STR, category=STR,
    action=STR, expected_impact=STR,
)
MODEL_METRICS = _schema(
    target=STR, model=STR, mae=DOUBLE, mape=DOUBLE, accuracy=DOUBLE, n_eval=LONG,
    holdout_days=INT, evaluated_at=TIME,
)
FORECAST_ACTUAL = _schema(
    target=STR, date=DATE, actual=DOUBLE, predicted=DOUBLE,
)
ENTITLEMENT = _schema(
    email=STR, region_id=STR,
)

# Stream
EVENT = _schema(
    event_id=STR, hospital_id=STR, region_id=STR, event_ts=STR, acuity=INT, arrival_mode=STR,
    is_breach_risk=BOOL,
)
MINUTE_COUNTS = _schema(
    minute_ts=TIME, hospital_id=STR, region_id=STR, attendances=LONG, ambulance=LONG,
    high_acuity=LONG, breach_risk=LONG,
)
DEPARTMENT_STATE = _schema(
    minute_ts=TIME, hospital_id=STR, region_id=STR, arrivals=INT, ambulance_arrivals=INT,
    admissions=INT, discharges=INT, occupied_beds=INT, available_beds=INT, beds_total=INT,
    occupancy_pct=DOUBLE, queue_length=INT, ambulances_waiting=INT, breach_risk=INT,
    staff_factor=DOUBLE,
)

FEEDS = {
    "waiting_list": WAITING_LIST,
    "activity": ACTIVITY,
    "workforce": WORKFORCE,
    "demographics": DEMOGRAPHICS,
    "illness": ILLNESS,
    "weather": WEATHER,
    "dim_date": DIM_DATE,
    "dim_hospital": DIM_HOSPITAL,
    "dim_specialty": DIM_SPECIALTY,
    "dim_region": DIM_REGION,
}
