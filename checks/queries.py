"""Registered queries: each runs library operators over the whole driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow import schemas
from wardflow.functions import calendar, codes, scoring
from wardflow.functions.numbers import clip
from wardflow.operators import asof, cleaning, dedup, positions, scores, snapshots, windows
from wardflow.plans import backtest, job, questions, recommend, risk, serving, silver, star, training, views
from wardflow.sources import bucketed, checked, layers, nested, scans, tables
from wardflow.streaming import department, events, live, minute_counts

from .domain import Domain, plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRAIN = ("hospital_id", "specialty_id", "date_key")
RUN_DATE = "2025-06-01"
JOB_WINDOW = (dt.date(1997, 1, 1), dt.date(1997, 6, 30))
Z_COLUMNS = ["bed_occupancy", "waiting_list_growth", "waiting_list_size", "vacancy_rate", "ae_surge_index"]


def query(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Domain(spark, folder))
    return build


# Views and overview -----------------------------------------------------------------------------

@query
def national_pressure(d):
    return plain(views.national_pressure(d.fact()))


@query
def kpi_row(d):
    return plain(serving.kpi_row(views.national_pressure(d.stored_fact), d.stored_risk))


@query
def pressure_last_n(d):
    return plain(serving.pressure_last_days(views.national_pressure(d.fact()), 90))


@query
def regional_risk_latest(d):
    return plain(views.regional_risk_latest(d.stored_risk, d.hospitals(), d.regions()))


@query
def regional_shares(d):
    regional = views.regional_risk_latest(d.stored_risk, d.hospitals(), d.regions())
    return plain(serving.regional_shares(regional))


@query
def top_risk(d):
    return plain(views.top_risk_trusts(d.stored_risk, d.hospitals(), d.regions()))


@query
def intent_risk(d):
    return plain(serving.intent_risk(d.stored_risk, d.hospitals(), d.regions()))


@query
def risk_summary(d):
    top = views.top_risk_trusts(d.stored_risk, d.hospitals(), d.regions())
    return plain(serving.risk_summary(d.stored_risk, top))


@query
def red_in_top_list(d):
    top = views.top_risk_trusts(d.stored_risk, d.hospitals(), d.regions())
    return plain(serving.red_in_top_list(top))


@query
def risk_distribution(d):
    return plain(serving.risk_distribution(d.stored_risk))


@query
def class_share(d):
    return plain(serving.class_share(d.stored_risk))


@query
def risk_class_summary(d):
    return plain(serving.risk_class_summary(d.stored_risk))


@query
def risk_class_counts(d):
    return plain(risk.class_counts(d.stored_risk))


@query
def pressure_measures(d):
    return plain(serving.pressure_measures(views.national_pressure(d.stored_fact)))


@query
def entitlement_filter(d):
    """Customers stand in for users: each may see the region of its nation."""
    users = d.table("customer").join(
        d.table("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"
    ).select(F.col("c_name").alias("email"), F.concat(F.lit("R"), "n_regionkey").alias("region_id"))
    rows = serving.entitled(d.columns("region_id", "date_key", "admissions"), users, "Customer#000000001")
    return plain(rows.groupBy("region_id", "date_key").agg(F.sum("admissions").alias("admissions")))


# Workforce and daily profiles -------------------------------------------------------------------

STAFF = ("date_key", "hospital_id", "staff_count", "vacancies", "vacancy_rate")


@query
def workforce_snapshot(d):
    return plain(serving.workforce_snapshot(d.stored_columns(*STAFF), d.hospitals()))


@query
def workforce_chart(d):
    snapshot = serving.workforce_snapshot(d.stored_columns(*STAFF), d.hospitals())
    return plain(serving.workforce_chart(snapshot))


@query
def vacancy_top5(d):
    return plain(serving.vacancy_pressure(d.stored_columns(*STAFF), d.hospitals()))


@query
def intent_staff(d):
    return plain(serving.intent_staff(d.stored_columns(*STAFF), d.hospitals()))


@query
def intent_wait(d):
    fact = d.stored_columns("date_key", "specialty_id", "median_wait_days")
    return plain(serving.intent_wait(fact, d.specialties()))


@query
def intent_ae(d):
    return plain(serving.intent_ae(d.columns("date_key", "ae_attendances")))


@query
def intent_bed(d):
    return plain(serving.intent_bed(d.columns("date_key", "bed_occupancy_pct")))


@query
def wait_by_specialty(d):
    return plain(serving.wait_by_specialty(d.fact(), d.specialties()))


@query
def daily_profile(d):
    return plain(serving.daily_profile(d.columns("date_key", "ae_attendances", "bed_occupancy_pct")))


# Forecast tables --------------------------------------------------------------------------------

def _long(d):
    return views.forecast_long(d.forecast(), d.hospitals(), d.specialties())


@query
def forecast_long(d):
    return plain(_long(d))


@query
def forecast_listing(d):
    return plain(serving.forecasts(_long(d), target="waiting_time", horizon=60, limit=5000))


@query
def forecast_national_line(d):
    return plain(serving.national_forecast_line(_long(d)))


@query
def recent_forecast_mean(d):
    return plain(serving.recent_forecast_mean(d.forecast()))


@query
def forecast_summary_text(d):
    return plain(questions.forecast_summary(serving.recent_forecast_mean(d.forecast())))


@query
def forecast_inventory(d):
    return plain(serving.forecast_inventory(d.forecast()))


@query
def horizon_comparison(d):
    return plain(serving.horizon_comparison(d.forecast()))


# Star schema ------------------------------------------------------------------------------------

def _raw(df, **renames):
    """Landed form of a cleaned feed: file order column and the landed names."""
    return df.withColumnsRenamed({v: k for k, v in renames.items()}).withColumn("ingest_order", F.lit(1))


@query
def star_fact(d):
    """Landed feeds cleaned, then joined into the numbered fact."""
    first = _raw(d.stored_activity(), specialty="specialty_id")
    again = first.withColumns({"admissions": F.col("admissions") + 1000, "ingest_order": F.lit(2)})
    activity = silver.clean_activity(first.unionByName(again))  # delivered twice, the first stays
    waiting = silver.clean_waiting_list(_raw(d.waiting(), specialty="specialty_id"))
    fact = star.build_fact(
        layers.store(activity, "activity"), waiting, silver.clean_workforce(_raw(d.workforce())),
        silver.clean_illness(_raw(d.illness())), silver.clean_weather(_raw(d.weather())), d.hospitals(),
    )
    return plain(fact)


@query
def month_bridge_join(d):
    daily = d.stored_activity().select("trust_code", "specialty_id", F.col("date").alias("date_key"))
    return plain(star.bridge_months(daily, d.waiting()))


@query
def bucketed_month_bridge(d):
    """The month bridge and rolling means over tables bucketed by trust and specialty: no row moves."""
    keys, name = ["trust_code", "specialty_id"], layers.new_path(d.spark, "t").split("/")[-2]
    daily = d.stored_activity().select(*keys, F.col("date").alias("date_key"), "admissions")
    buckets = bucketed.bucket_count(daily)
    daily = bucketed.save_bucketed(daily, f"daily_{name}", keys, buckets, ["date_key"])
    waiting = bucketed.save_bucketed(d.waiting(), f"waiting_{name}", keys, buckets, ["period"])
    with bucketed.co_located(d.spark):
        bridged = star.bridge_months(daily, waiting)
        out = layers.store(windows.add_rolling_means(bridged, "admissions", keys=keys), "bridged")
    return plain(out, 6)


@query
def observed_checks(d):
    """The fact written with its checks; what they saw, a row each."""
    rules = [
        checked.at_least(1), *checked.never_null("date_key", "hospital_id", "specialty_id"),
        *checked.between("admissions", 0, 10**9), checked.null_share("waiting_list_size", 1.0),
    ]
    path = layers.new_path(d.spark, "checked_fact")
    seen = checked.write_checked(d.fact(), path, rules, RUN_DATE)
    rows = checked.read_checked(d.spark, path, schemas.FACT).agg(F.count(F.lit(1)).cast("double").alias("value"))
    told = d.spark.createDataFrame([(k, float(v)) for k, v in seen.items()], "rule string, value double")
    return plain(told.unionByName(rows.withColumn("rule", F.lit("rows_read_back"))), 9)


@query
def integrity_checks(d):
    fact = d.stored_columns("date_key", "hospital_id", "specialty_id", "region_id")
    return plain(
        star.integrity_report(fact, d.dim_date(), d.hospitals(), d.specialties(), d.regions())
    )


@query
def dim_date(d):
    return plain(d.dim_date())


@query
def position_ids(d):
    """Line numbers of all line items by day, order and line, without one big sort."""
    rows = d.table("lineitem").select(
        F.col("l_shipdate").cast("date").alias("date_key"), "l_orderkey", "l_linenumber",
        "l_partkey", "l_suppkey", "l_extendedprice", F.floor(F.col("l_orderkey") / 100_000).alias("block"),
    )
    leaf = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = positions.with_position(rows, [["date_key"], ["block"], leaf])
    return plain(numbered.select("date_key", "l_orderkey", "l_linenumber", "position"))


@query
def lag_by_position(d):
    """Sign-ups seven customers earlier in key order, as an equi-join on the position."""
    block = F.floor(F.col("c_custkey") / 100_000).alias("block")
    rows = d.table("customer").select("c_nationkey", block, "c_custkey", "c_acctbal")
    numbered = positions.with_position(rows, [["c_nationkey"], ["block"], ["c_custkey"]]).drop("block")
    numbered = layers.store(numbered, "numbered")  # both sides of the self-join read it
    return plain(positions.lag_by_position(numbered, "c_acctbal", 7).drop("c_acctbal"))


@query
def workforce_totals(d):
    return plain(star.workforce_totals(d.workforce()))


@query
def monthly_waiting(d):
    return plain(star.monthly_waiting(d.waiting()))


@query
def bed_capacity(d):
    return plain(star.bed_capacity(d.hospitals()))


# Windows ----------------------------------------------------------------------------------------

def _series(d, *cols):
    return d.columns(*GRAIN, *cols)


@query
def rolling_means(d):
    return plain(windows.add_rolling_means(_series(d, "bed_occupancy_pct"), "bed_occupancy_pct"), 6)


@query
def lag_features(d):
    return plain(windows.add_lag_features(_series(d, "waiting_list_size"), "waiting_list_size"))


@query
def growth_rate(d):
    return plain(windows.add_growth_rate(_series(d, "admissions"), "admissions"))


@query
def feature_table(d):
    return plain(star.feature_table(d.stored_fact).drop("activity_id"), 6)


@query
def lead_target(d):
    return plain(windows.add_lead(_series(d, "admissions"), "admissions", 30))


@query
def ffill_series(d):
    gappy = _series(d, "admissions").withColumn(
        "admissions", F.when(F.col("admissions") > 1, F.col("admissions"))
    )
    return plain(windows.forward_fill(gappy, ["admissions"], default=0))


@query
def waiting_features(d):
    fact = _series(d, "median_wait_days", "referrals", "vacancy_rate")
    return plain(windows.waiting_features(fact)[0], 6)


@query
def workforce_features(d):
    staff = d.workforce().withColumn("date_key", F.lit(RUN_DATE).cast("date"))
    return plain(windows.workforce_features(staff)[0], 6)


@query
def rolling_blocked(d):
    """Rolling means over single events of one type each: few, very long series."""
    at = F.col("ts").cast("timestamp")
    rows = d.table("events").select(
        "event_type", F.to_date(at).alias("day"), F.date_trunc("MINUTE", at).alias("minute"), "event_id", "value"
    )
    out = windows.add_rolling_blocked(
        rows, "value", ["event_type"], [["day"], ["minute"], ["event_id"]], block_rows=20_000
    )
    return plain(out.drop("day", "minute"), 6)


@query
def known_lag(d):
    """Lag of the 30 days after the history, with the last known value beyond it."""
    history = d.columns("date_key", "ae_attendances").groupBy("date_key").agg(F.sum("ae_attendances").alias("ae"))
    history = layers.store(history, "history")
    newest = snapshots.latest(history)
    last = history.agg(F.max_by("ae", "date_key").cast("double")).scalar()
    future = d.spark.range(1, 31).select(F.date_add(newest, F.col("id").cast("int")).alias("date_key"))
    lagged = windows.known_lag(future, history, "ae", 7, last)
    both = lagged.unionByName(history.withColumn("ae", F.col("ae").cast("double")), allowMissingColumns=True)
    rolled = both.withColumn("ae_roll14", windows.known_rolling(both, "ae", 14, last))
    return plain(rolled.filter(F.col("date_key") > newest).drop("ae"), 6)


# Risk and recommendations -----------------------------------------------------------------------

@query
def asof_growth_30d(d):
    return plain(risk.growth_30d(d.stored_columns(*GRAIN, "waiting_list_size")), 9)


@query
def asof_every_row(d):
    """Each row's waiting list 30 days earlier, or the last known before."""
    fact = d.stored_columns(*GRAIN, "waiting_list_size")
    known = fact.filter(F.col("waiting_list_size").isNotNull())
    joined = asof.asof_join(
        fact, known, ["hospital_id", "specialty_id"], "date_key", ["waiting_list_size"], at=F.date_sub("date_key", 30)
    )
    return plain(joined)


@query
def asof_snapshot(d):
    fact = d.stored_columns(*GRAIN, "waiting_list_size")
    cutoff = F.date_sub(snapshots.latest(fact), 30)
    return plain(
        snapshots.as_of(fact, ["hospital_id", "specialty_id"], "waiting_list_size", "date_key", cutoff)
    )


@query
def ae_surge(d):
    rows = risk.components(d.stored_columns(*GRAIN, "ae_attendances"))
    return plain(rows.select("hospital_id", "ae_7d", "ae_baseline_7d", "ae_surge_index"), 9)


@query
def peer_zscore(d):
    rows = scores.peer_zscores(risk.components(d.stored_fact), Z_COLUMNS)
    return plain(rows.select("hospital_id", *[f"{c}_z" for c in Z_COLUMNS]), 6)


@query
def regional_zscore(d):
    fact = d.stored_columns(*GRAIN, "region_id", "bed_occupancy_pct")
    return plain(scores.regional_zscores(fact, ["bed_occupancy_pct"]), 6)


@query
def risk_score(d):
    rows = risk.compute_risk(d.stored_fact)
    return plain(
        rows.select(
            "risk_id", "date_key", "hospital_id", "score", "classification_relative",
            "classification_absolute", "classification",
            F.get_json_object("components_json", "$.trigger").alias("trigger"),
        ),
        3,
    )


@query
def json_metric_mean(d):
    return plain(recommend.json_metric_mean(d.stored_risk), 6)


@query
def hospital_means(d):
    cols = ("date_key", "hospital_id", "bed_occupancy_pct", "vacancy_rate", "ae_attendances")
    return plain(recommend.hospital_means(d.stored_columns(*cols)))


@query
def top_roles(d):
    return plain(recommend.top_roles(d.workforce()))


@query
def rules_hits(d):
    inputs = recommend.rule_inputs(d.stored_fact, d.stored_risk, d.hospitals(), d.workforce())
    hits = recommend.rule_hits(inputs)
    return plain(hits.select("hospital_id", "severity", "category", "top_role", "vacancy_rate", "ae_surge_index"), 6)


@query
def recommendations(d):
    recs = recommend.recommendations(
        d.stored_fact, d.stored_risk, d.hospitals(), d.workforce(), RUN_DATE
    )
    return plain(serving.recommendation_list(recs, d.hospitals()))


@query
def recommendations_ranked(d):
    recs = recommend.recommendations(
        d.stored_fact, d.stored_risk, d.hospitals(), d.workforce(), RUN_DATE
    )
    return plain(serving.recommendation_list(recs, d.hospitals(), ranked=True).select(
        "recommendation_id", "severity", "hospital_name"
    ))


# Cleaning ---------------------------------------------------------------------------------------

@query
def clean_code(d):
    dirty = F.concat(F.lit(" "), F.lower("s_name"), F.lit("-"))
    short = F.concat(F.lit(" t-"), (F.col("s_suppkey") % 2000).cast("string"), F.lit("."))
    return plain(
        d.table("supplier").select(
            "s_suppkey", codes.trust_code(dirty).alias("long_code"), codes.trust_code(short).alias("code"),
            codes.trust_code(F.nullif(F.concat(F.lit("rx"), "s_nationkey"), F.lit("rx7"))).alias("nation_code"),
        )
    )


@query
def clip_fixed(d):
    rows = d.table("lineitem").select(
        "l_orderkey", "l_partkey", F.nullif("l_linenumber", F.lit(7)).cast("double").alias("line"), "l_quantity"
    )
    return plain(cleaning.clip_columns(rows, {"line": (2, 5), "l_quantity": (5, 45)}))


@query
def clip_quantile(d):
    rows = d.table("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    both = cleaning.clip_to_quantiles(rows, ["l_extendedprice"])
    return plain(cleaning.clip_to_quantiles(both, ["l_quantity"], lo=0), 6)


@query
def impute_median(d):
    rows = d.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")
    )
    return plain(cleaning.impute_median(rows, "price"), 6)


@query
def dedup_keep_first(d):
    """Line items re-delivered with another price: the first delivery of each part per order wins."""
    first = d.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice",
        F.struct("l_linenumber", "l_suppkey", "l_extendedprice").alias("ingest_order"),
    )
    again = first.withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice") + 1,
            "ingest_order": F.struct(
                (F.col("ingest_order.l_linenumber") + 100).alias("l_linenumber"),
                F.col("ingest_order.l_suppkey").alias("l_suppkey"),
                F.col("ingest_order.l_extendedprice").alias("l_extendedprice"),
            ),
        }
    )
    rows = dedup.keep_first(first.unionByName(again), ["l_orderkey", "l_partkey"], ["ingest_order"])
    return plain(rows.drop("ingest_order"))


@query
def latest_per_key(d):
    orders = d.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    rows = dedup.keep_latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return plain(rows.drop("o_orderdate"))


@query
def clean_waiting_list(d):
    dirty = d.waiting().select(
        F.concat(F.lit(" "), F.lower("trust_code"), F.lit("-")).alias("Trust_Code "),
        F.col("specialty_id").alias("specialty"), "period", "waiting_list_size",
        F.when(F.col("waiting_list_size") % 5 != 0, F.col("median_wait_days")).alias("median_wait_days"),
        F.lit(1).alias("ingest_order"),
    )
    again = dirty.withColumns({"waiting_list_size": F.lit(-1).cast("long"), "ingest_order": F.lit(2)})
    return plain(silver.clean_waiting_list(dirty.unionByName(again)), 6)


@query
def clean_activity(d):
    return plain(silver.clean_activity(_dirty_activity(d.activity())))


def _dirty_activity(activity):
    """Landed activity in which about one grain in a hundred, fixed by its key, has no valid date."""
    key = F.dayofmonth("date") + F.month("date") * 31 + F.substring("trust_code", 2, 9).cast("int") * 7
    text = F.when(key % 101 == 0, "n/a").otherwise(F.col("date").cast("string"))
    return _raw(activity, specialty="specialty_id").withColumn("date", text)


@query
def clean_activity_counts(d):
    """Rows kept and dropped by cleaning, which add up to all rows, and the line items behind them."""
    activity = d.stored_activity()
    dirty = layers.store(_dirty_activity(activity), "dirty")
    kept = silver.clean_activity(dirty).agg(F.count(F.lit(1)).alias("kept"))
    dropped = dirty.agg(
        F.count_if(F.col("date") == "n/a").alias("dropped"), F.sum("admissions").alias("line_items"),
        F.count(F.lit(1)).alias("all_rows"),
    )
    return plain(dropped.withColumn("kept", kept.scalar()))


@query
def union_by_name(d):
    a = d.table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = d.table("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return plain(dedup.union_all([a, b]))


@query
def season_flags(d):
    day = F.col("o_orderdate").cast("date")
    rows = d.table("orders").select("o_orderkey", day.alias("date_key"))
    out = calendar.add_seasonal(rows).withColumns(
        {
            "season": calendar.season(F.col("date_key")),
            "flu_season": calendar.is_flu_season(F.col("date_key")),
            "year_month": calendar.year_month(F.col("date_key")),
        }
    )
    return plain(out)


@query
def minute_floor(d):
    rows = d.table("events").select("event_id", calendar.minute(F.col("ts")).alias("minute_ts"))
    return plain(rows.groupBy("minute_ts").agg(F.count("event_id").alias("n")))


# Files ------------------------------------------------------------------------------------------

@query
def landed_workforce(d):
    """The workforce feed landed on two days, the second delivery altered; the first one wins."""
    folder = layers.new_path(d.spark, "landing")
    feed = d.workforce()
    tables.land({"workforce": feed}, folder, "2025-06-01")
    tables.land({"workforce": feed.withColumn("vacancies", F.col("vacancies") + 1)}, folder, "2025-06-02")
    return plain(silver.clean_workforce(scans.read_landed(d.spark, f"{folder}/workforce", schemas.WORKFORCE)))


@query
def exported_csv(d):
    """National pressure exported as CSV and read back."""
    folder = layers.new_path(d.spark, "export")
    pressure = views.national_pressure(d.columns("date_key", "ae_attendances", "admissions", "discharges",
                                                 "bed_occupancy_pct", "waiting_list_size", "vacancy_rate"))
    tables.export_csv({"v_national_pressure": pressure, "v_top_risk_trusts": None}, folder)
    return plain(scans.read_csv(d.spark, f"{folder}/v_national_pressure", pressure.schema))


@query
def partitioned_tree(d):
    """Customers written partitioned by segment, found again by a recursive scan."""
    folder = layers.new_path(d.spark, "tree")
    tables.write_parquet(d.table("customer"), folder, ["c_mktsegment"])
    plain_cols = d.table("customer").drop("c_mktsegment").schema
    rows = scans.read_tree(d.spark, folder, plain_cols)
    segment = F.regexp_extract("source_file", "c_mktsegment=([A-Z]+)", 1)
    return plain(rows.select("c_custkey", "c_name", "c_acctbal", segment.alias("segment")))


@query
def json_records(d):
    return plain(cleaning.json_records(d.table("orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("o_custkey"),
    )))


# Codes and nested documents ---------------------------------------------------------------------

@query
def postcode_region(d):
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("ls", "E", "zz", "Sw", "B1", "w", "")]), (F.col("c_custkey") % 7 + 1).cast("int")
    )
    postcode = F.concat(prefix, F.col("c_nationkey").cast("string"), F.lit(" 4AB"))
    label = F.element_at(F.array(F.lit("London"), F.lit("East"), F.lit("Wales")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return plain(
        d.table("customer").select(
            "c_custkey", codes.region_for_postcode(postcode).alias("region_id"),
            codes.region_for_postcode(F.substring("c_mktsegment", 1, 2)).alias("segment_region"),
            codes.region_for_label(label).alias("label_region"),
        )
    )


@query
def organisation_flatten(d):
    """Register pages built from suppliers as JSON, parsed and flattened again."""
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("GENERAL HOSPITAL", "MENTAL HEALTH", "COMMUNITY", "AMBULANCE")]),
        (F.col("s_suppkey") % 4 + 1).cast("int"),
    )
    def org(suffix):
        return F.struct(
            F.concat(F.lit("R"), F.col("s_suppkey").cast("string"), F.lit(suffix)).alias("OrgId"),
            F.concat(F.upper("s_name"), F.lit(" "), kind, F.lit(f" {suffix} NHS TRUST")).alias("Name"),
            F.concat(F.lit("ls"), F.col("s_nationkey").cast("string")).alias("PostCode"),
        )
    pages = d.table("supplier").select(
        F.col("s_suppkey").alias("page"), F.to_json(F.struct(F.array(org("A"), org("B")).alias("Organisations"))).alias("document")
    )
    parsed = nested.parse(pages, "document", schemas.ORGANISATIONS)
    return plain(nested.flatten_organisations(parsed, order=["page"]).drop("page", "pos"))


@query
def weather_flatten(d):
    """Monthly weather documents with parallel arrays (at most 31 days each), flattened again."""
    daily = d.weather().withColumn("month", F.date_format("date", "yyyy-MM"))
    days = F.sort_array(
        F.collect_list(
            F.struct(
                F.col("date").cast("string").alias("time"),
                F.when(F.dayofmonth("date") != 13, F.round("avg_temp_c", 6)).alias("temp"),
            )
        )
    )
    documents = daily.groupBy("region_id", "month").agg(days.alias("days")).select(
        F.to_json(
            F.struct(
                "region_id",
                F.struct(
                    F.col("days.time").alias("time"), F.col("days.temp").alias("temperature_2m_mean")
                ).alias("daily"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("document")
    )
    parsed = nested.parse(documents, "document", schemas.WEATHER_DOCUMENT)
    flat = nested.flatten_weather(parsed)
    newest = layers.store(flat, "weather").agg(F.max("date")).scalar()  # taken as today, so five days are cut
    return plain(nested.within_source_lag(flat, newest, today=newest))


# Streams ----------------------------------------------------------------------------------------

SLICES = 8
#: Bytes of the events that go into one file of messages.
FILE_BYTES = 1 << 20
CLOSING_DAY = dt.date(2024, 1, 11)


def _stream_run(d):
    """Run the event messages to their end, one delivery per batch, and keep the log going.

    The messages land in eight deliveries that overlap in time, with broken messages among them. After
    the run one batch is delivered again, and the log is compacted twice, the folded folders gone.
    A delivery is one file, or several of equal size if it is large, so that all cores work on a batch.
    Returns the folders of the count log, the raw archive and the dead letters.
    """
    spark = d.spark
    landed, table, archive, dead = (
        layers.new_path(spark, n) for n in ("landed", "minute_counts", "raw_archive", "dead")
    )
    messages = events.encode(d.attendances()).unionByName(_broken(d))
    files = layers.input_bytes(d.table("events")) // (SLICES * FILE_BYTES) + 1
    part = F.pmod(F.xxhash64("key", "value"), F.lit(SLICES * files)).cast("int")
    messages.withColumn("part", part).repartitionById(SLICES * files, "part").drop("part").write.parquet(landed)
    stream = events.replay(spark, landed, schema="key string, value string", files_per_batch=files)
    q = minute_counts.start_counts(
        stream, table, layers.new_path(spark, "stream_checkpoint"), archive, dead=dead
    )
    minute_counts.run_bounded(q)
    again = spark.read.schema(schemas.EVENT).parquet(f"{archive}/batch_id=3")
    minute_counts.minute_counts(again).write.mode("overwrite").parquet(f"{table}/batch_id=3")
    for upto in (2, 5):
        minute_counts.compact(spark, table, upto)
        minute_counts.drop_folded(spark, table)
    return table, archive, dead


def _broken(d):
    """One malformed message per hundred events or so."""
    return d.table("events").filter(F.col("value") > 95).select(
        F.lit("H0").alias("key"), F.substring("props", 1, 3).alias("value")
    )


@query
def stream_minute_agg(d):
    return plain(minute_counts.read_counts(d.spark, _stream_run(d)[0]))


@query
def stream_dead_letters(d):
    """Messages the stream could not read, by their text."""
    dead = d.spark.read.schema("key string, value string, batch_id long").parquet(_stream_run(d)[2])
    return plain(dead.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")))


@query
def batch_minute_agg(d):
    return plain(minute_counts.minute_counts(d.attendances()))


@query
def stream_watermark_windows(d):
    """The same counts from the state store, with a watermark longer than the data."""
    raw = events.replay(d.spark, d.folder, "events.parquet", schema=d.table("events").schema)
    table = layers.new_path(d.spark, "windows")
    q = minute_counts.start_windows(
        d.attendances(raw), table, layers.new_path(d.spark, "stream_checkpoint"), "365 days"
    )
    minute_counts.run_bounded(q)
    return plain(minute_counts.read_windows(d.spark, table))


@query
def event_messages(d):
    """Events as keyed JSON messages and back, with one malformed message per hundred events."""
    sent = events.encode(d.attendances())
    good, dead = events.decode(sent.unionByName(_broken(d)))
    return plain(
        good.groupBy("hospital_id", "arrival_mode").agg(F.count(F.lit(1)).alias("n")).unionByName(
            dead.groupBy(F.lit("dead").alias("hospital_id"), F.lit("none").alias("arrival_mode")).agg(
                F.count(F.lit(1)).alias("n")
            )
        )
    )


@query
def stream_trailing_window(d):
    counts = minute_counts.minute_counts(d.attendances())
    return plain(minute_counts.trailing_series(layers.store(counts, "counts"), 1440))


@query
def stream_totals(d):
    counts = layers.store(minute_counts.minute_counts(d.attendances()), "counts")
    return plain(minute_counts.totals(minute_counts.trailing_series(counts, 1440)))


@query
def stream_run_summary(d):
    return plain(minute_counts.run_summary(minute_counts.minute_counts(d.attendances())))


@query
def no_loss_check(d):
    """The stream's count table against the archive of the same run."""
    from wardflow.operators.quality import reconcile

    table, archive, _ = _stream_run(d)
    raw = d.spark.read.schema(schemas.EVENT).parquet(archive)
    return plain(reconcile(minute_counts.read_counts(d.spark, table), raw, "attendances"))


@query
def dept_state(d):
    return plain(department.national_series(d.department()))


def _live(d, work, schema, key):
    """Department rows delivered in eight files by time, half of one again, read one file per batch."""
    landed = layers.new_path(d.spark, "landed_states")
    rows = layers.store(d.department(), "states")
    low, high = rows.agg(F.unix_seconds(F.min("minute_ts")), F.unix_seconds(F.max("minute_ts"))).first()
    part = F.floor((F.unix_seconds("minute_ts") - low) * SLICES / (high - low + 1))
    for k in range(SLICES):
        again = (part == k - 1) & (F.col("hospital_id") < "H4")
        rows.filter((part == k) | again).coalesce(1).write.mode("append").parquet(landed)
    stream = events.replay(d.spark, landed, schema=rows.schema, files_per_batch=1)
    table = layers.new_path(d.spark, "live")
    # a file may repeat the one before it, so a minute stays open for two files
    q = live.start_live(work(stream, 2 * (high - low) // SLICES // 60 + 2), table, layers.new_path(d.spark, "live_checkpoint"))
    minute_counts.run_bounded(q)
    return live.read_live(d.spark, table, schema, key)


@query
def live_national(d):
    """The national minutes as the stateful stream leaves them."""
    series = _live(d, lambda s, open_: live.national_minutes(s, open_), live.MINUTE, "minute_ts")
    return plain(series.withColumn("occupancy_pct", F.round("occupancy_pct", 1)).drop("hospitals", "is_closed"))


@query
def live_newest(d):
    """The newest row of each hospital as the stateful stream leaves it."""
    return plain(_live(d, lambda s, open_: live.newest_states(s, 180, open_), live.NEWEST, "hospital_id").drop("is_live"))


@query
def closed_days(d):
    """Counts of a log whose early days close after the fifth of eight batches; what came later is counted apart."""
    table, spark = layers.new_path(d.spark, "closing"), d.spark
    sent = layers.store(d.attendances(), "sent")
    for k in range(SLICES):
        part = sent.filter(F.col("event_id").cast("long") % SLICES == k)
        minute_counts.minute_counts(part).write.parquet(f"{table}/batch_id={k}")
        if k == 4:
            minute_counts.compact(spark, table, 2)
            minute_counts.compact(spark, table, k, closed_before=CLOSING_DAY)
            minute_counts.drop_folded(spark, table)
    minute_counts.compact(spark, table, 6)
    kept, late = minute_counts.read_counts(spark, table), minute_counts.late_counts(spark, table)
    return plain(kept.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))))


@query
def dept_latest(d):
    return plain(department.newest_state(department.national_series(d.department())))


@query
def pressure_metrics(d):
    series = layers.store(department.national_series(d.department()), "series")
    return plain(questions.pressure_summary(department.pressure_metrics(series)))


@query
def live_measures(d):
    return plain(serving.live_measures(layers.store(d.department(), "department")))


# Statistics, questions, models ------------------------------------------------------------------

METRICS = ["bed_occupancy_pct", "waiting_list_size", "median_wait_days", "vacancy_rate",
           "ae_attendances", "flu_index", "covid_index", "avg_temp_c"]


@query
def corr_matrix(d):
    return plain(scores.correlations(d.fact(), METRICS))


@query
def describe(d):
    cols = ["admissions", "bed_occupancy_pct", "waiting_list_size", "median_wait_days", "vacancy_rate",
            "ae_attendances"]
    return plain(scores.describe(d.stored_columns(*cols), cols), 6)


def _paired(d):
    """Orders as forecast (total price) against actual (sum of the lines)."""
    actual = d.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("actual")
    )
    return d.table("orders").join(actual, "o_orderkey", "left").select(
        F.col("o_orderpriority").alias("target"), "actual", F.col("o_totalprice").alias("predicted")
    )


@query
def mape_scores(d):
    return plain(scores.error_scores(_paired(d), ["target"]))


@query
def validation_metrics(d):
    metrics = scores.error_scores(_paired(d), ["target"]).withColumns(
        {"model": F.lit("orders"), "holdout_days": F.lit(30)}
    )
    return plain(serving.validation_metrics(metrics))


@query
def model_accuracy(d):
    return plain(serving.model_accuracy(scores.error_scores(_paired(d), ["target"])), 6)


@query
def mean_errors(d):
    return plain(scores.mean_errors(_paired(d).dropna()), 6)


@query
def trend_weekday_baseline(d):
    daily = d.columns("date_key", "ae_attendances").groupBy("date_key").agg(F.sum("ae_attendances").cast("double").alias("ae"))
    return plain(scores.trend_and_weekday(layers.store(daily, "daily"), "date_key", "ae"), 4)


@query
def intent_routing(d):
    rows = d.table("conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return plain(questions.route(rows).drop("question"))


@query
def sql_audit(d):
    """Query texts of several shapes built from events, and all conversation texts."""
    u = F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit(" SELECT score FROM risk_score WHERE id = "), u, F.lit(";")))
        .when(kind == "error", F.concat(F.lit("DROP TABLE t"), u))
        .when(kind == "purchase", F.concat(F.lit("SELECT "), u, F.lit("; SELECT 2")))
        .when(kind == "signup", F.concat(F.lit("select * from secret_"), u, F.lit(" limit 1")))
        .otherwise(F.concat(F.lit("select 1 from Dim_Region where update = "), u))
    )
    logged = d.table("events").select(F.col("event_id").alias("id"), text.alias("sql"))
    spoken = d.table("conversations").select(
        (-F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.col("text").alias("sql")
    )
    return plain(questions.audit(logged.unionByName(spoken)).drop("sql"))


@query
def verdict_bands(d):
    """Scoring expressions over part sizes and prices."""
    x = F.col("p_size").cast("double")
    score = (x - 25) / 10
    relative, absolute = scoring.relative_class(score), scoring.absolute_class(x + 50, x / 2)
    return plain(
        d.table("part").select(
            "p_partkey", relative.alias("relative"), absolute.alias("absolute"),
            scoring.worse_of(relative, absolute).alias("final"),
            scoring.score_band(score).alias("band"), scoring.vacancy_band(x / 2).alias("vacancy"),
            scoring.accuracy_band(x + 50).alias("accuracy"), scoring.shortage_label(x / 2).alias("short"),
            clip(score, -1.0, 1.0).alias("clipped"),
        )
    )


def _daily_fact(d):
    return d.stored_columns(
        *GRAIN, "bed_occupancy_pct", "median_wait_days", "ae_attendances", "referrals", "vacancy_rate",
        "flu_index", "covid_index", "avg_temp_c",
    )


@query
def training_days(d):
    """The national daily series with the lags, means and calendar columns a model is fitted on."""
    daily = layers.store(training.national_daily(_daily_fact(d), "bed_occupancy_pct", "mean"), "daily")
    x, names = training._occupancy_features(daily, "bed_occupancy_pct")
    kept = [n for n in names if n not in training.EXOGENOUS]
    return plain(x.select("date_key", "bed_occupancy_pct", *kept), 6)


@query
def trained_forecasts(d):
    """All four model jobs with the production ensembles: what the forecast table holds per target and horizon."""
    out = training.train_all(_daily_fact(d), d.workforce(), d.hospitals(), RUN_DATE)
    return plain(
        out.groupBy("target", "model", "horizon_days", "is_future").agg(
            F.count(F.lit(1)).alias("n"), F.min("date_key").alias("first_day"), F.max("date_key").alias("last_day"),
            F.count_distinct("hospital_id").alias("hospitals"), F.count_distinct("role").alias("roles"),
            F.count_if(F.col("yhat").isNull()).alias("unknown"),
            F.count_if((F.col("yhat") >= 0) & (F.col("yhat_lower") > F.col("yhat_upper"))).alias("crossed_bands"),
        )
    )


@query
def occupancy_forecasts(d):
    return plain(training.occupancy_rows(_daily_fact(d)), 6)


@query
def attendance_forecasts(d):
    return plain(training.attendance_rows(_daily_fact(d)), 6)


@query
def waiting_forecasts(d):
    return plain(training.waiting_rows(_daily_fact(d)), 6)


@query
def workforce_forecasts(d):
    return plain(training.workforce_rows(d.workforce(), d.hospitals(), RUN_DATE), 6)


@query
def gbt_backtest(d):
    """Scores of the models on the last 30 days, next to those of naive forecasts."""
    fact = _daily_fact(d)
    metrics, _ = backtest.backtest(fact, RUN_DATE)
    return plain(metrics.unionByName(backtest.naive_backtest(fact, RUN_DATE)).drop("evaluated_at"))


@query
def naive_backtest(d):
    return plain(backtest.naive_backtest(_daily_fact(d), RUN_DATE).drop("evaluated_at"))


# Landing to warehouse ---------------------------------------------------------------------------

def _landed(d):
    """Feeds landed whole, read back."""
    activity = d.stored_activity().withColumnRenamed("specialty_id", "specialty")
    feeds = {
        "activity": activity.withColumn("date", F.col("date").cast("string")),
        "waiting_list": d.waiting().withColumnRenamed("specialty_id", "specialty"),
        "workforce": d.workforce(), "illness": d.illness().withColumn("date", F.col("date").cast("string")),
        "weather": d.weather().withColumn("date", F.col("date").cast("string")),
        "demographics": d.regions().select("region_id", "region_name", F.lit(1).cast("long").alias("population"), "country"),
        "dim_hospital": d.hospitals(), "dim_specialty": d.specialties(), "dim_region": d.regions(),
    }
    landing = layers.new_path(d.spark, "landing")
    tables.land(feeds, landing, "2025-05-01")
    return job.landed_feeds(d.spark, landing)


def _landed_job(d):
    """The batch job from landed feeds that reach far beyond its window of half a year."""
    return job.build_warehouse(_landed(d), layers.new_path(d.spark, "warehouse"), *JOB_WINDOW)


@query
def job_fact(d):
    return plain(_landed_job(d)["hospital_activity_fact"])


@query
def job_increments(d):
    """The fact loaded in two runs that overlap, the first of them run again."""
    feeds, warehouse = _landed(d), layers.new_path(d.spark, "warehouse")
    known, (first, last) = silver.profile(feeds), JOB_WINDOW
    early, late = (first, dt.date(1997, 4, 15)), (dt.date(1997, 3, 20), last)
    for run, days in (("2025-05-01", early), ("2025-05-02", late), ("2025-05-01", early)):
        job.load_increment(feeds, warehouse, *days, run, known)
    return plain(job.incremental_fact(d.spark, warehouse))


@query
def waiting_list_files(d):
    """The waiting list delivered half as CSV, half as JSON lines, read as one feed and cleaned."""
    rows = layers.store(d.waiting().withColumnRenamed("specialty_id", "specialty"), "waiting")
    parts, early = [], F.col("period") < "1998"
    for fmt, some in (("csv", rows.filter(early)), ("json", rows.filter(~early))):
        folder = layers.new_path(d.spark, fmt)
        some.write.format(fmt).option("header", True).save(folder)
        parts.append(scans.read_feed_files(d.spark, folder, schemas.WAITING_LIST, fmt))
    return plain(silver.clean_waiting_list(dedup.union_all(parts)), 6)


@query
def clean_dimension(d):
    """Padded ids, delivered twice: trimmed, the first row stays."""
    first = d.table("supplier").select(
        F.concat(F.lit(" S"), "s_suppkey", F.lit(" ")).alias("hospital_id"), F.col("s_name").alias("hospital_name"),
        F.lit(1).alias("ingest_order"),
    )
    again = first.withColumns({"hospital_name": F.lit("later"), "ingest_order": F.lit(2)})
    return plain(silver.clean_dim_hospital(first.unionByName(again)))


@query
def clean_demographics(d):
    regions = d.regions().select("region_id", F.col("region_name").alias(" Region_Name"), F.lit(1).alias("ingest_order"))
    again = regions.withColumns({" Region_Name": F.lit("later"), "ingest_order": F.lit(2)})
    return plain(silver.clean_demographics(regions.unionByName(again)))


@query
def json_documents(d):
    """One JSON document per nation, each a file of its own, with its suppliers as a list."""
    folder = layers.new_path(d.spark, "documents")
    rows = d.table("supplier").groupBy("s_nationkey").agg(
        F.sort_array(F.collect_list("s_suppkey")).alias("suppliers"), F.count(F.lit(1)).alias("n")
    )
    value = F.to_json(F.struct(F.col("s_nationkey").alias("nation"), "suppliers", "n"))
    rows.select("s_nationkey", value.alias("value")).write.partitionBy("s_nationkey").text(folder)
    schema = T.StructType.fromDDL("nation long, suppliers array<long>, n long")
    back = scans.read_json_documents(d.spark, folder, schema)
    return plain(back.select("nation", "n", F.array_join("suppliers", "-").alias("suppliers")))


@query
def listed_files(d):
    """Parquet files found below a folder, by the partition their path names."""
    folder = layers.new_path(d.spark, "listed")
    d.table("customer").write.partitionBy("c_mktsegment").parquet(folder)
    found = scans.list_parquet_files(d.spark, folder)
    segment = F.regexp_extract("path", "c_mktsegment=([^/]+)", 1)
    return plain(found.filter("length > 0").select(segment.alias("segment")).distinct())


@query
def typed_fallback(d):
    """Frames of a declared schema; what no frame has stays NULL."""
    schema = T.StructType.fromDDL("c_name string, c_acctbal double, note string")
    some = dedup.union_or_empty(d.spark, [d.table("customer").select("c_name", "c_acctbal")], schema)
    none = dedup.union_or_empty(d.spark, [], schema)
    return plain(some.unionByName(none))


@query
def archived_events(d):
    """The append-only archive of the event stream."""
    raw = events.replay(d.spark, d.folder, "events.parquet", schema=d.table("events").schema)
    archive = layers.new_path(d.spark, "archive")
    q = minute_counts.archive_events(d.attendances(raw), archive, layers.new_path(d.spark, "stream_checkpoint"))
    minute_counts.run_bounded(q)
    stored = d.spark.read.schema(schemas.EVENT).parquet(archive)
    return plain(stored.groupBy("hospital_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events")))


@query
def events_by_day(d):
    return plain(d.table("events").groupBy(calendar.day(F.col("ts").cast("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n")))


@query
def answered_question(d):
    """A question routed to its intent and answered by that intent's rows."""
    def wait():
        return serving.intent_wait(d.stored_columns("date_key", "specialty_id", "median_wait_days"), d.specialties())

    views = {"wait": wait, "ae": lambda: serving.intent_ae(d.fact()), "bed": lambda: serving.intent_bed(d.fact()),
             "staff": lambda: serving.intent_staff(d.fact(), d.hospitals()),
             "risk": lambda: serving.intent_risk(d.stored_risk, d.hospitals(), d.regions())}
    return plain(questions.answer(d.spark, "Why are waiting times rising?", views))
