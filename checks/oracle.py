"""DuckDB SQL for the registered queries, written on the driver tables only."""

from __future__ import annotations

# Activity rows whose date the query leaves readable: a fixed property of the key.
VALID_DATE = "(day(date) + month(date) * 31 + CAST(substr(trust_code, 2) AS INT) * 7) % 101 <> 0"

# Named sub-queries; each oracle pulls in the ones it mentions and what those mention.
PARTS: dict[str, str] = {
    "places": """
        SELECT l.*, s_nationkey, p_type FROM lineitem l
        JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "activity": """
        SELECT 'T' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS trust_code, p_type AS specialty_id,
               CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS BIGINT) AS admissions,
               CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS discharges,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bed_occupancy_count,
               CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS ae_attendances,
               CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS referrals
        FROM places GROUP BY ALL""",
    "waiting": """
        SELECT 'T' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS trust_code, p_type AS specialty_id,
               strftime(l_shipdate, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS waiting_list_size,
               CAST(sum(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS DOUBLE)
                 / count(*) AS median_wait_days
        FROM places JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "workforce": """
        SELECT 'T' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS trust_code,
               (['Admin', 'Medical', 'Nursing', 'Therapy'])[CAST(s_suppkey % 4 + 1 AS INT)] AS role,
               count(*) * 100 AS staff_count, 30 * count(*) FILTER (WHERE s_acctbal < 3000) AS vacancies,
               round_even((30 * count(*) FILTER (WHERE s_acctbal < 3000))::DOUBLE / (count(*) * 100)::DOUBLE * 100 * 100, 0) / 100
                 AS vacancy_rate
        FROM supplier GROUP BY ALL""",
    "illness": """
        SELECT CAST(o_orderdate AS DATE) AS date,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 10000 AS flu_index,
               CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS covid_index
        FROM orders GROUP BY 1""",
    "weather": """
        SELECT CAST(o_orderdate AS DATE) AS date, 'R' || n_regionkey AS region_id,
               CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 500 AS avg_temp_c
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "hospitals": """
        SELECT 'H_T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '_00' AS hospital_id,
               n_name || ' NHS Trust – Site 1' AS hospital_name,
               'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS trust_code,
               'R' || n_regionkey AS region_id, 8 * count(s_suppkey) AS bed_capacity
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""",
    "specialties": """
        SELECT DISTINCT p_type AS specialty_id,
               'Specialty ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS specialty_name
        FROM part""",
    "regions": "SELECT 'R' || r_regionkey AS region_id, r_name AS region_name FROM region",
    "staff": """
        SELECT trust_code, CAST(sum(staff_count) AS BIGINT) AS staff_count,
               CAST(sum(vacancies) AS BIGINT) AS vacancies,
               CAST(round_even(sum(vacancies)::DOUBLE / nullif(sum(staff_count), 0)::DOUBLE * 100 * 100, 0) / 100 AS DECIMAL(9,2))
                 AS vacancy_rate
        FROM workforce GROUP BY 1""",
    "fact": """
        SELECT a.date AS date_key, h.hospital_id, a.specialty_id, h.region_id, admissions, discharges,
               CAST(round_even(bed_occupancy_count::DOUBLE / nullif(h.bed_capacity, 0)::DOUBLE * 100 * 100, 0) / 100 AS DECIMAL(9,2))
                 AS bed_occupancy_pct,
               bed_occupancy_count, w.waiting_list_size,
               CAST(round(w.median_wait_days, 2) AS DECIMAL(10,2)) AS median_wait_days,
               s.staff_count, s.vacancies, s.vacancy_rate, ae_attendances, referrals,
               CAST(round(i.flu_index, 2) AS DECIMAL(9,2)) AS flu_index,
               CAST(i.covid_index AS DECIMAL(9,2)) AS covid_index,
               CAST(round(t.avg_temp_c, 1) AS DECIMAL(9,1)) AS avg_temp_c
        FROM activity a LEFT JOIN hospitals h USING (trust_code)
        LEFT JOIN staff s USING (trust_code)
        LEFT JOIN waiting w ON w.trust_code = a.trust_code AND w.specialty_id = a.specialty_id
                           AND w.period = strftime(a.date, '%Y-%m')
        LEFT JOIN illness i ON i.date = a.date
        LEFT JOIN weather t ON t.date = a.date AND t.region_id = h.region_id""",
    "pressure": """
        SELECT date_key, CAST(sum(ae_attendances) AS BIGINT) AS ae_attendances,
               CAST(sum(admissions) AS BIGINT) AS admissions, CAST(sum(discharges) AS BIGINT) AS discharges,
               CAST(sum(bed_occupancy_pct) AS DOUBLE) / count(bed_occupancy_pct) AS avg_bed_occupancy_pct,
               CAST(sum(waiting_list_size) AS BIGINT) AS total_waiting_list,
               CAST(sum(vacancy_rate) AS DOUBLE) / count(vacancy_rate) AS avg_vacancy_rate
        FROM fact GROUP BY 1""",
    "newest": "SELECT max(date_key) AS d FROM fact",
    "series_past": """
        SELECT hospital_id, specialty_id, waiting_list_size AS wl_past FROM (
          SELECT *, row_number() OVER (PARTITION BY hospital_id, specialty_id ORDER BY date_key DESC) AS rn
          FROM fact WHERE date_key <= (SELECT d FROM newest) - 30) WHERE rn = 1""",
    "series_now": """
        SELECT f.*, p.wl_past,
               (waiting_list_size - coalesce(wl_past, waiting_list_size))::DOUBLE
                 / nullif(coalesce(wl_past, waiting_list_size), 0) AS growth
        FROM fact f LEFT JOIN series_past p USING (hospital_id, specialty_id)
        WHERE date_key = (SELECT d FROM newest)""",
    "surge": """
        SELECT hospital_id, CAST(sum(ae_attendances) FILTER (WHERE date_key >= (SELECT d FROM newest) - 7) AS BIGINT) AS ae_7d,
               CAST(sum(ae_attendances) AS DOUBLE) / count(*) * 7 AS ae_baseline_7d
        FROM fact GROUP BY 1""",
    "parts": """
        SELECT n.hospital_id, avg(CAST(bed_occupancy_pct AS DOUBLE)) AS bed_occupancy,
               avg(CASE WHEN coalesce(wl_past, waiting_list_size) IS NULL THEN 0
                        ELSE coalesce(growth, 0) END) AS waiting_list_growth,
               CAST(coalesce(sum(waiting_list_size), 0) AS DOUBLE) AS waiting_list_size,
               avg(CAST(vacancy_rate AS DOUBLE)) AS vacancy_rate, any_value(ae_7d) AS ae_7d,
               any_value(ae_baseline_7d) AS ae_baseline_7d,
               coalesce((any_value(ae_7d) - any_value(ae_baseline_7d)) / nullif(any_value(ae_baseline_7d), 0), 0)
                 AS ae_surge_index
        FROM series_now n JOIN surge USING (hospital_id) GROUP BY 1""",
    "z": """
        SELECT *, {zs} FROM parts""".format(
        zs=", ".join(
            f"CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 0 ELSE greatest(-3.0, least(3.0, "
            f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())) END AS {c}_z"
            for c in ("bed_occupancy", "waiting_list_growth", "waiting_list_size", "vacancy_rate", "ae_surge_index")
        )
    ),
    "scored": """
        SELECT *, round_even((0.30 * bed_occupancy_z + 0.30 * (waiting_list_growth_z + waiting_list_size_z)
                        + 0.25 * vacancy_rate_z + 0.15 * ae_surge_index_z) * 1000, 0) / 1000 AS score FROM z""",
    "verdicts": """
        SELECT *, CASE WHEN score < 0 THEN 0 WHEN score < 1 THEN 1 ELSE 2 END AS rel,
               CASE WHEN bed_occupancy >= 95 OR vacancy_rate >= 15 THEN 2
                    WHEN bed_occupancy >= 92 OR vacancy_rate >= 12 THEN 1 ELSE 0 END AS abs_
        FROM scored""",
    "risk": """
        SELECT row_number() OVER (ORDER BY hospital_id) AS risk_id, (SELECT d FROM newest) AS date_key,
               hospital_id, score, (['Green', 'Amber', 'Red'])[greatest(rel, abs_) + 1] AS classification,
               (['Green', 'Amber', 'Red'])[rel + 1] AS classification_relative,
               (['Green', 'Amber', 'Red'])[abs_ + 1] AS classification_absolute,
               CASE WHEN abs_ > rel THEN 'absolute' ELSE 'peer-relative' END AS trigger,
               ae_surge_index
        FROM verdicts""",
    "named_risk": """
        SELECT risk.*, hospital_name, h.region_id, region_name FROM risk
        JOIN hospitals h USING (hospital_id) JOIN regions USING (region_id)""",
    "top_list": "SELECT * FROM named_risk ORDER BY score DESC, hospital_id LIMIT 10",
    "regional": """
        SELECT region_id, region_name, date_key,
               count(*) FILTER (WHERE classification = 'Red') AS red_count,
               count(*) FILTER (WHERE classification = 'Amber') AS amber_count,
               count(*) FILTER (WHERE classification = 'Green') AS green_count,
               CAST(sum(CAST(score AS DECIMAL(9,3))) AS DOUBLE) / count(score) AS avg_score
        FROM named_risk GROUP BY 1, 2, 3""",
    "hospital_now": """
        SELECT hospital_id, CAST(sum(bed_occupancy_pct) AS DOUBLE) / count(bed_occupancy_pct) AS bed_occupancy_pct,
               CAST(sum(vacancy_rate) AS DOUBLE) / count(vacancy_rate) AS vacancy_rate,
               CAST(sum(ae_attendances) AS DOUBLE) / count(ae_attendances) AS ae_attendances
        FROM fact WHERE date_key = (SELECT d FROM newest) GROUP BY 1""",
    "growths": "SELECT hospital_id, avg(growth) AS waiting_list_growth_30d FROM series_now GROUP BY 1",
    "roles": """
        SELECT trust_code, role AS top_role FROM (SELECT *, row_number() OVER (
          PARTITION BY trust_code ORDER BY vacancy_rate DESC, role) AS rn FROM workforce) WHERE rn = 1""",
    "inputs": """
        SELECT r.hospital_id, CASE WHEN classification = 'Red' THEN 'High' ELSE 'Medium' END AS severity,
               coalesce(m.vacancy_rate, 0) AS vacancy_rate, coalesce(m.bed_occupancy_pct, 0) AS occ,
               coalesce(waiting_list_growth_30d, 0) AS growth, coalesce(ae_surge_index, 0) AS ae_surge_index,
               coalesce(top_role, 'Nursing') AS top_role, hospital_name
        FROM risk r LEFT JOIN hospital_now m USING (hospital_id) LEFT JOIN growths USING (hospital_id)
        LEFT JOIN hospitals h USING (hospital_id) LEFT JOIN roles ON roles.trust_code = h.trust_code
        WHERE classification <> 'Green'""",
    "hits": """
        SELECT *, 0 AS rank, 'Staffing' AS category FROM inputs WHERE vacancy_rate > 9
        UNION ALL SELECT *, 1, 'Capacity' FROM inputs WHERE occ > 92
        UNION ALL SELECT *, 2, 'Workload' FROM inputs WHERE growth > 0.08
        UNION ALL SELECT *, 3, 'Pathway' FROM inputs WHERE ae_surge_index > 0.2""",
    "forecast": """
        SELECT o_orderkey AS forecast_id, CAST(o_orderdate AS DATE) AS date_key, target,
               CASE WHEN target IN ('waiting_time', 'workforce_demand') THEN
                 'H_T' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') || '_00' END AS hospital_id,
               CASE WHEN target = 'waiting_time' THEN (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])
                 [CAST(o_orderkey % 6 + 1 AS INT)] END AS specialty_id,
               CAST((o_orderkey % 3 + 1) * 30 AS BIGINT) AS horizon_days,
               CAST(o_totalprice AS DECIMAL(14,2)) AS yhat,
               CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) - 10 END AS yhat_lower,
               CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) + 10 END AS yhat_upper,
               CASE WHEN target = 'ae_demand' THEN 'trend' ELSE 'gbt' END AS model
        FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'ae_demand' WHEN '2-HIGH' THEN 'bed_occupancy'
              WHEN '4-NOT SPECIFIED' THEN 'workforce_demand' ELSE 'waiting_time' END AS target FROM orders)""",
    "long": """
        SELECT date_key, hospital_name, specialty_name, target, horizon_days, CAST(yhat AS DOUBLE) AS yhat,
               CAST(yhat_lower AS DOUBLE) AS yhat_lower, CAST(yhat_upper AS DOUBLE) AS yhat_upper, model,
               yhat AS y, yhat_lower AS yl, yhat_upper AS yu
        FROM forecast LEFT JOIN hospitals USING (hospital_id) LEFT JOIN specialties USING (specialty_id)""",
    "recent": """
        SELECT target, horizon_days, CAST(sum(yhat) AS DOUBLE) / count(yhat) AS yhat FROM forecast
        WHERE date_key >= (SELECT max(date_key) FROM forecast) - 7 GROUP BY 1, 2""",
    "sent": """
        SELECT event_id, 'H' || (user_id % 8) AS hospital_id, 'R' || (user_id % 8 % 3) AS region_id, ts,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type, value, user_id FROM events""",
    "minutes": """
        SELECT date_trunc('minute', ts) AS minute_ts, hospital_id, min(region_id) AS region_id,
               count(*) AS attendances, count(*) FILTER (WHERE event_type = 'purchase') AS ambulance,
               count(*) FILTER (WHERE k < 40) AS high_acuity, count(*) FILTER (WHERE value > 50) AS breach_risk
        FROM sent GROUP BY 1, 2""",
    "trail_minutes": """
        SELECT minute_ts, CAST(sum(attendances) AS BIGINT) AS attendances, CAST(sum(ambulance) AS BIGINT) AS ambulance,
               CAST(sum(breach_risk) AS BIGINT) AS breach_risk
        FROM minutes WHERE minute_ts >= (SELECT max(minute_ts) FROM minutes) - INTERVAL 1440 MINUTE GROUP BY 1""",
    "dept": """
        SELECT date_trunc('minute', ts) AS minute_ts, hospital_id, count(*) AS arrivals,
               count(*) FILTER (WHERE event_type = 'click') AS admissions,
               count(*) FILTER (WHERE event_type = 'view') AS discharges,
               CAST(sum(k) AS BIGINT) AS available_beds,
               count(*) FILTER (WHERE event_type = 'error') AS queue_length,
               count(*) FILTER (WHERE event_type = 'purchase') AS ambulances_waiting,
               CAST(sum(k) % 41 + 60 AS DOUBLE) AS occupancy_pct,
               count(*) FILTER (WHERE value > 50) AS breach_risk
        FROM sent GROUP BY 1, 2""",
    "dept_minutes": """
        SELECT minute_ts, {sums}, round(avg(occupancy_pct), 1) AS occupancy_pct FROM dept GROUP BY 1""".format(
        sums=", ".join(
            f"CAST(sum({c}) AS BIGINT) AS {c}"
            for c in ("arrivals", "admissions", "discharges", "available_beds", "queue_length",
                      "ambulances_waiting", "breach_risk")
        )
    ),
    "paired": """
        SELECT o_orderpriority AS target, o_totalprice AS predicted,
               (SELECT 1) AS one, a.actual
        FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS actual
                               FROM lineitem GROUP BY 1) a ON l_orderkey = o_orderkey""",
    "daily_ae": "SELECT date_key, CAST(sum(ae_attendances) AS DOUBLE) AS ae FROM fact GROUP BY 1",
}

FACT_OUT = """date_key, hospital_id, specialty_id, region_id, admissions, discharges,
    CAST(bed_occupancy_pct AS DOUBLE) AS bed_occupancy_pct, bed_occupancy_count, waiting_list_size,
    CAST(median_wait_days AS DOUBLE) AS median_wait_days, staff_count, vacancies,
    CAST(vacancy_rate AS DOUBLE) AS vacancy_rate, ae_attendances, referrals,
    CAST(flu_index AS DOUBLE) AS flu_index, CAST(covid_index AS DOUBLE) AS covid_index,
    CAST(avg_temp_c AS DOUBLE) AS avg_temp_c"""
SERIES = "PARTITION BY hospital_id, specialty_id ORDER BY date_key"


def rolls(c: str, windows=(7, 14, 30), over: str = SERIES, digits: int = 6) -> str:
    return ", ".join(
        f"round(avg(CAST({c} AS DOUBLE)) OVER ({over} ROWS {n - 1} PRECEDING), {digits}) AS {c}_roll{n}"
        for n in windows
    )


def lags(c: str, ns=(1, 7, 14, 30), over: str = SERIES, cast: str | None = None) -> str:
    x = f"CAST({c} AS {cast})" if cast else c
    return ", ".join(f"lag({x}, {n}) OVER ({over}) AS {c}_lag{n}" for n in ns)


def growths(c: str, ns=(7, 30), digits: int | None = None) -> str:
    def one(n):
        before = f"lag({c}, {n}) OVER ({SERIES})"
        g = f"CAST({c} - {before} AS DOUBLE) / nullif(CAST({before} AS DOUBLE), 0)"
        return f"{g if digits is None else f'round({g}, {digits})'} AS {c}_growth{n}d"

    return ", ".join(one(n) for n in ns)


CALENDAR = """CAST(month(date_key) AS BIGINT) AS month, CAST(isodow(date_key) - 1 AS BIGINT) AS day_of_week,
    isodow(date_key) >= 6 AS is_weekend, CAST(weekofyear(date_key) AS BIGINT) AS weekofyear"""
SEASON = """CASE WHEN month(date_key) IN (12, 1, 2) THEN 'Winter' WHEN month(date_key) IN (3, 4, 5) THEN 'Spring'
    WHEN month(date_key) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"""
FLU = "month(date_key) IN (10, 11, 12, 1, 2, 3)"


def regional_z(c: str) -> str:
    return (
        f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER (PARTITION BY region_id)) / "
        f"nullif(stddev_samp(CAST({c} AS DOUBLE)) OVER (PARTITION BY region_id), 0), 6) AS {c}_regional_z"
    )


def code(x: str) -> str:
    cleaned = f"regexp_replace(upper(trim({x})), '[^A-Z0-9]', '', 'g')"
    return f"CASE WHEN regexp_matches({cleaned}, '^[A-Z0-9]{{3,5}}$') THEN {cleaned} END"


def exact(x: str, digits: int) -> str:
    """Correctly rounded: the formatter works on the exact binary value."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def exact_up(x: str) -> str:
    """Two digits, correctly rounded, exact ties (multiples of 1/8) up."""
    return f"CASE WHEN ({x}) * 8 = floor(({x}) * 8) THEN floor(({x}) * 100 + 0.5) / 100 ELSE {exact(x, 2)} END"


def rounded(total: str, digits: int) -> str:
    return f"round(CAST({total} AS DOUBLE) / count(*), {digits})"


CORR = ["bed_occupancy_pct", "waiting_list_size", "median_wait_days", "vacancy_rate", "ae_attendances",
        "flu_index", "covid_index", "avg_temp_c"]
DESCRIBED = ["admissions", "bed_occupancy_pct", "waiting_list_size", "median_wait_days", "vacancy_rate",
             "ae_attendances"]


def describe(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    q = ", ".join(f"round(quantile_cont({x}, {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return (
        f"SELECT '{c}' AS metric, count({c}) AS count, round(avg({x}), 6) AS mean, "
        f"round(stddev_samp({x}), 6) AS std, min({x}) AS min, {q}, max({x}) AS max FROM fact"
    )


CHECKS = [
    ("fact is empty", "SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM fact"),
    ("fact NULL keys", "SELECT count(*) FROM fact WHERE hospital_id IS NULL OR region_id IS NULL"),
    ("fact duplicate grain", "SELECT count(*) FROM (SELECT 1 FROM fact GROUP BY date_key, hospital_id, "
                             "specialty_id HAVING count(*) > 1)"),
    ("fact without date", "SELECT 0"),
    ("fact without hospital", "SELECT count(*) FROM fact WHERE hospital_id NOT IN (SELECT hospital_id FROM hospitals)"),
    ("fact without specialty", "SELECT count(*) FROM fact WHERE specialty_id NOT IN (SELECT p_type FROM part)"),
    ("fact without region", "SELECT count(*) FROM fact WHERE region_id NOT IN (SELECT region_id FROM regions)"),
    ("duplicate hospital", "SELECT count(*) - count(DISTINCT hospital_id) FROM hospitals"),
    ("trust with several hospitals", "SELECT count(*) - count(DISTINCT trust_code) FROM hospitals"),
    ("missing calendar days", "SELECT 0"),
]

ACTIVITY_CLEAN_COUNTS = ("admissions", "discharges", "bed_occupancy_count", "ae_attendances", "referrals")


def clipped_activity(source: str) -> str:
    cols = ", ".join(
        f"CAST(round_even(greatest(0, least({c}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.999) FROM {source}))), 0)"
        f" AS BIGINT) AS {c}"
        for c in ACTIVITY_CLEAN_COUNTS
    )
    return f"SELECT trust_code, specialty_id, date, {cols} FROM {source}"


SQL: dict[str, str] = {
    "national_pressure": "SELECT * FROM pressure",
    "kpi_row": f"""SELECT CAST(date_key AS VARCHAR) AS latest_date, ae_attendances,
        {exact('avg_bed_occupancy_pct', 1)} AS avg_bed_occupancy_pct, total_waiting_list,
        {exact('avg_vacancy_rate', 1)} AS avg_vacancy_rate,
        (SELECT count(*) FROM risk WHERE classification = 'Red') AS trusts_red
        FROM (SELECT date_key, ae_attendances, avg_bed_occupancy_pct, coalesce(total_waiting_list, 0) AS total_waiting_list,
              avg_vacancy_rate FROM pressure ORDER BY date_key DESC LIMIT 1)""",
    "pressure_last_n": "SELECT * FROM (SELECT * FROM pressure ORDER BY date_key DESC LIMIT 90) ORDER BY date_key",
    "regional_risk_latest": "SELECT * FROM regional",
    "regional_shares": """SELECT region_id, region_name, avg_score,
        CASE WHEN avg_score >= 1 THEN 'Red' WHEN avg_score >= 0 THEN 'Amber' ELSE 'Green' END AS band,
        CAST(red_count AS DOUBLE) / (red_count + amber_count + green_count) * 100.0 AS red_pct,
        CAST(amber_count AS DOUBLE) / (red_count + amber_count + green_count) * 100.0 AS amber_pct,
        CAST(green_count AS DOUBLE) / (red_count + amber_count + green_count) * 100.0 AS green_pct FROM regional""",
    "top_risk": "SELECT hospital_name, region_name, classification, score, date_key FROM top_list",
    "intent_risk": "SELECT hospital_name, region_name, score, classification FROM top_list",
    "risk_summary": """SELECT hospital_name, region_name, classification, score, date_key,
        (SELECT count(*) FROM risk WHERE classification = 'Red') AS n_red
        FROM top_list ORDER BY score DESC, hospital_name LIMIT 3""",
    "red_in_top_list": "SELECT count(*) FILTER (WHERE classification = 'Red') AS trusts_in_red FROM top_list",
    "risk_distribution": "SELECT classification, count(*) AS n FROM risk GROUP BY 1",
    "class_share": """SELECT c AS classification, (SELECT count(*) FROM risk WHERE classification = c) AS n,
        CAST(floor(100.0 * (SELECT count(*) FROM risk WHERE classification = c) / (SELECT count(*) FROM risk) + 0.5) AS BIGINT)
          AS share_pct FROM (VALUES ('Red'), ('Amber'), ('Green')) v(c)""",
    "risk_class_summary": """SELECT classification, count(*) AS n,
        round(CAST(sum(CAST(score AS DECIMAL(9,3))) AS DOUBLE) / count(*), 3) AS avg_score FROM risk GROUP BY 1""",
    "risk_class_counts": """SELECT count(*) AS rows, count(*) FILTER (WHERE classification = 'Red') AS red,
        count(*) FILTER (WHERE classification = 'Amber') AS amber,
        count(*) FILTER (WHERE classification = 'Green') AS green FROM risk""",
    "pressure_measures": """SELECT avg_bed_occupancy_pct AS capacity_pressure_pct, total_waiting_list, ae_attendances
        FROM pressure WHERE date_key = (SELECT d FROM newest)""",
    "entitlement_filter": """SELECT region_id, date_key, CAST(sum(admissions) AS BIGINT) AS admissions FROM fact
        WHERE region_id IN (SELECT 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
                            WHERE c_name = 'Customer#000000001') GROUP BY 1, 2""",
    "workforce_snapshot": """SELECT hospital_name, h.region_id, max(staff_count) AS staff_count,
        max(vacancies) AS vacancies, CAST(max(vacancy_rate) AS DOUBLE) AS vacancy_rate
        FROM fact JOIN hospitals h USING (hospital_id) WHERE date_key = (SELECT d FROM newest) GROUP BY 1, 2""",
    "workforce_chart": """SELECT *, regexp_replace(hospital_name, ' NHS.*$', '') AS short,
        CASE WHEN vacancy_rate >= 12 THEN 'Red' WHEN vacancy_rate >= 8 THEN 'Amber' ELSE 'Green' END AS band
        FROM (SELECT hospital_name, h.region_id, max(staff_count) AS staff_count, max(vacancies) AS vacancies,
              CAST(max(vacancy_rate) AS DOUBLE) AS vacancy_rate
              FROM fact JOIN hospitals h USING (hospital_id) WHERE date_key = (SELECT d FROM newest) GROUP BY 1, 2)
        ORDER BY vacancy_rate DESC, hospital_name LIMIT 12""",
    "vacancy_top5": """SELECT hospital_name, CAST(sum(vacancy_rate) AS DOUBLE) / count(vacancy_rate) AS vacancy_rate,
        CAST(sum(vacancies) AS BIGINT) AS vacancies, CAST(sum(staff_count) AS BIGINT) AS staff_count
        FROM fact JOIN hospitals USING (hospital_id) WHERE date_key = (SELECT d FROM newest)
        GROUP BY 1 ORDER BY vacancy_rate DESC, hospital_name LIMIT 5""",
    "intent_staff": """SELECT hospital_name, CAST(sum(vacancy_rate) AS DOUBLE) / count(vacancy_rate) AS vacancy_rate,
        CAST(sum(vacancies) AS BIGINT) AS vacancies
        FROM fact JOIN hospitals USING (hospital_id) WHERE date_key = (SELECT d FROM newest)
        GROUP BY 1 ORDER BY vacancy_rate DESC, hospital_name LIMIT 10""",
    "intent_wait": """SELECT specialty_name, CAST(sum(median_wait_days) AS DOUBLE) / count(median_wait_days) AS median_wait_days
        FROM fact JOIN specialties USING (specialty_id) WHERE date_key = (SELECT d FROM newest)
        GROUP BY 1 ORDER BY median_wait_days DESC NULLS LAST, specialty_name LIMIT 10""",
    "intent_ae": """SELECT date_key, CAST(sum(ae_attendances) AS BIGINT) AS ae_attendances FROM fact
        GROUP BY 1 ORDER BY 1 DESC LIMIT 60""",
    "intent_bed": """SELECT date_key, CAST(sum(bed_occupancy_pct) AS DOUBLE) / count(bed_occupancy_pct) AS bed_occupancy_pct
        FROM fact GROUP BY 1 ORDER BY 1 DESC LIMIT 60""",
    "wait_by_specialty": """SELECT specialty_name, CAST(sum(median_wait_days) AS DOUBLE) / count(median_wait_days) AS avg_wait,
        CAST(sum(waiting_list_size) AS BIGINT) AS list FROM fact JOIN specialties USING (specialty_id) GROUP BY 1""",
    "daily_profile": """SELECT date_key, CAST(sum(ae_attendances) AS BIGINT) AS ae,
        CAST(sum(bed_occupancy_pct) AS DOUBLE) / count(bed_occupancy_pct) AS occ FROM fact GROUP BY 1""",
    "forecast_long": "SELECT * EXCLUDE (y, yl, yu) FROM long",
    "forecast_listing": """SELECT * EXCLUDE (y, yl, yu) FROM long WHERE target = 'waiting_time' AND horizon_days = 60
        ORDER BY date_key, target, horizon_days, hospital_name NULLS FIRST, specialty_name NULLS FIRST, yhat LIMIT 5000""",
    "forecast_national_line": f"""SELECT date_key, {exact_up('CAST(sum(coalesce(y, 0)) AS DOUBLE) / count(*)')} AS yhat,
        {exact_up('CAST(sum(coalesce(yl, 0)) AS DOUBLE) / count(*)')} AS yhat_lower,
        {exact_up('CAST(sum(coalesce(yu, 0)) AS DOUBLE) / count(*)')} AS yhat_upper FROM long GROUP BY 1""",
    "recent_forecast_mean": "SELECT * FROM recent",
    "forecast_summary_text": """SELECT string_agg(target || ' @ horizon ' || horizon_days || 'd ≈ '
        || printf('%.1f', yhat), chr(10) ORDER BY target, horizon_days) AS summary FROM recent""",
    "forecast_inventory": f"""SELECT target, horizon_days, model, count(*) AS n,
        {rounded('sum(yhat)', 2)} AS avg_yhat FROM forecast GROUP BY 1, 2, 3""",
    "horizon_comparison": f"""SELECT horizon_days, {rounded('sum(yhat)', 1)} AS mean_pred_wait_days
        FROM forecast WHERE target = 'waiting_time' GROUP BY 1""",
    "month_bridge_join": """SELECT a.trust_code, a.specialty_id, a.date AS date_key, w.waiting_list_size, w.median_wait_days
        FROM activity a LEFT JOIN waiting w ON w.trust_code = a.trust_code AND w.specialty_id = a.specialty_id
        AND w.period = strftime(a.date, '%Y-%m')""",
    "integrity_checks": " UNION ALL ".join(
        f"SELECT '{name}' AS check, CAST(({sql}) AS BIGINT) AS violations" for name, sql in CHECKS
    ),
    "dim_date": f"""SELECT date_key, CAST(year(date_key) AS BIGINT) AS year, CAST(quarter(date_key) AS BIGINT) AS quarter,
        CAST(month(date_key) AS BIGINT) AS month, monthname(date_key) AS month_name,
        CAST(weekofyear(date_key) AS BIGINT) AS week, CAST(isodow(date_key) AS BIGINT) AS day_of_week,
        dayname(date_key) AS day_name, isodow(date_key) >= 6 AS is_weekend, {SEASON} AS season, {FLU} AS flu_season_flag
        FROM (SELECT CAST(unnest(generate_series(min(l_shipdate)::TIMESTAMP, max(l_shipdate)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE)
              AS date_key FROM lineitem)""",
    "position_ids": """SELECT CAST(l_shipdate AS DATE) AS date_key, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        row_number() OVER (ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_partkey, l_suppkey,
                           l_extendedprice) AS position FROM lineitem""",
    "lag_by_position": """SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey,
        row_number() OVER (ORDER BY c_nationkey, c_custkey) AS position,
        lag(c_acctbal, 7) OVER (ORDER BY c_nationkey, c_custkey) AS c_acctbal_lag7 FROM customer""",
    "rolling_means": f"""SELECT hospital_id, specialty_id, date_key, CAST(bed_occupancy_pct AS DOUBLE) AS bed_occupancy_pct,
        {rolls('bed_occupancy_pct')} FROM fact""",
    "lag_features": f"""SELECT hospital_id, specialty_id, date_key, waiting_list_size, {lags('waiting_list_size')} FROM fact""",
    "growth_rate": f"SELECT hospital_id, specialty_id, date_key, admissions, {growths('admissions')} FROM fact",
    "feature_table": f"""SELECT {FACT_OUT}, {CALENDAR}, {rolls('bed_occupancy_pct')},
        {lags('bed_occupancy_pct', cast='DOUBLE')}, {growths('bed_occupancy_pct', digits=6)},
        {rolls('waiting_list_size')}, {lags('waiting_list_size')}, {growths('waiting_list_size', digits=6)},
        {regional_z('bed_occupancy_pct')}, {regional_z('median_wait_days')} FROM fact""",
    "lead_target": f"""SELECT * FROM (SELECT hospital_id, specialty_id, date_key, admissions,
        lead(admissions, 30) OVER ({SERIES}) AS target FROM fact) WHERE target IS NOT NULL""",
    "ffill_series": f"""SELECT hospital_id, specialty_id, date_key, coalesce(last_value(a IGNORE NULLS) OVER ({SERIES}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS admissions
        FROM (SELECT *, CASE WHEN admissions > 1 THEN admissions END AS a FROM fact)""",
    "waiting_features": f"""SELECT hospital_id, specialty_id, date_key, CAST(median_wait_days AS DOUBLE) AS median_wait_days,
        referrals, CAST(vacancy_rate AS DOUBLE) AS vacancy_rate, {lags('median_wait_days', cast='DOUBLE')},
        {rolls('median_wait_days')}, {lags('referrals')}, {rolls('referrals')}, {lags('vacancy_rate', cast='DOUBLE')},
        {rolls('vacancy_rate')}, CAST(month(date_key) AS BIGINT) AS month, CAST(isodow(date_key) - 1 AS BIGINT) AS dow,
        CAST({FLU} AS BIGINT) AS flu_season FROM fact""",
    "workforce_features": """SELECT trust_code, role, staff_count, vacancies, vacancy_rate, DATE '2025-06-01' AS date_key,
        NULL::DOUBLE AS vacancy_rate_lag7, NULL::DOUBLE AS vacancy_rate_lag14, NULL::DOUBLE AS vacancy_rate_lag30,
        vacancy_rate AS vacancy_rate_roll14, vacancy_rate AS vacancy_rate_roll30,
        NULL::BIGINT AS staff_count_lag7, NULL::BIGINT AS staff_count_lag14, NULL::BIGINT AS staff_count_lag30,
        CAST(staff_count AS DOUBLE) AS staff_count_roll14, CAST(staff_count AS DOUBLE) AS staff_count_roll30,
        6::BIGINT AS month, 6::BIGINT AS dow FROM workforce""",
    "rolling_blocked": """SELECT event_type, event_id, value, {r}, {l} FROM events""".format(
        r=rolls("value", over="PARTITION BY event_type ORDER BY date_trunc('minute', ts), event_id"),
        l=", ".join(
            f"round(lag(value, {n}) OVER (PARTITION BY event_type ORDER BY date_trunc('minute', ts), event_id), 6) AS value_lag{n}"
            for n in (1, 7, 14, 30)
        ),
    ).replace("event_id, value,", "event_id, round(value, 6) AS value,"),
    "known_lag": """SELECT f.date_key, coalesce(h.ae, (SELECT arg_max(ae, date_key) FROM daily_ae)) AS ae_lag7,
        round(coalesce((SELECT avg(ae) FROM daily_ae x WHERE x.date_key BETWEEN f.date_key - 14 AND f.date_key - 1),
                 (SELECT arg_max(ae, date_key) FROM daily_ae)), 6) AS ae_roll14
        FROM (SELECT CAST((SELECT d FROM newest) + CAST(i AS INT) AS DATE) AS date_key FROM range(1, 31) t(i)) f
        LEFT JOIN daily_ae h ON h.date_key = f.date_key - 7""",
    "asof_growth_30d": "SELECT hospital_id, round(waiting_list_growth_30d, 9) AS waiting_list_growth_30d FROM growths",
    "asof_snapshot": "SELECT hospital_id, specialty_id, wl_past AS waiting_list_size FROM series_past",
    "ae_surge": """SELECT hospital_id, ae_7d, round(ae_baseline_7d, 9) AS ae_baseline_7d,
        round(ae_surge_index, 9) AS ae_surge_index FROM parts""",
    "peer_zscore": "SELECT hospital_id, " + ", ".join(
        f"round({c}_z, 6) AS {c}_z"
        for c in ("bed_occupancy", "waiting_list_growth", "waiting_list_size", "vacancy_rate", "ae_surge_index")
    ) + " FROM z",
    "regional_zscore": f"""SELECT hospital_id, specialty_id, date_key, region_id,
        CAST(bed_occupancy_pct AS DOUBLE) AS bed_occupancy_pct, {regional_z('bed_occupancy_pct')} FROM fact""",
    "risk_score": """SELECT risk_id, date_key, hospital_id, score, classification_relative, classification_absolute,
        classification, trigger FROM risk""",
    "json_metric_mean": "SELECT hospital_id, round(ae_surge_index, 6) AS ae_surge_index FROM risk",
    "hospital_means": "SELECT * FROM hospital_now",
    "top_roles": "SELECT * FROM roles",
    "rules_hits": """SELECT hospital_id, severity, category, top_role, round(vacancy_rate, 6) AS vacancy_rate,
        round(ae_surge_index, 6) AS ae_surge_index FROM hits""",
    "recommendations": """SELECT row_number() OVER (ORDER BY hospital_id, rank) AS recommendation_id,
        DATE '2025-06-01' AS date_key, hospital_id, severity, category, hospital_name,
        CASE rank
          WHEN 0 THEN 'Trust ' || hospital_id || ' has a ' || printf('%.1f', vacancy_rate) || '% vacancy rate. Open international recruitment + bank incentive shifts; prioritise the ' || top_role || ' role.'
          WHEN 1 THEN 'Bed occupancy at ' || printf('%.1f', occ) || '% — open 8–12 surge beds and review discharge pathway for the 5 longest-stay patients.'
          WHEN 2 THEN 'Waiting list grew ' || printf('%.1f', growth * 100) || '% in 30 days. Redistribute elective lists to partner trusts and extend weekend clinics.'
          ELSE 'A&E attendances ' || printf('%.0f', ae_surge_index * 100) || '% above 7-day baseline. Activate same-day emergency care unit and divert ambulatory cases to urgent treatment centres.'
        END AS action,
        (['Reduce vacancy rate by ~3pp in 60 days.', 'Drop occupancy below 90% within 14 days.',
          'Stabilise list size within 45 days.', 'Restore A&E flow to baseline within 7 days.'])[rank + 1] AS expected_impact
        FROM hits""",
    "clean_code": f"""SELECT s_suppkey, {code("' ' || lower(s_name) || '-'")} AS long_code,
        {code("' t-' || (s_suppkey % 2000) || '.'")} AS code,
        {code("nullif('rx' || s_nationkey, 'rx7')")} AS nation_code FROM supplier""",
    "clip_fixed": """SELECT l_orderkey, l_partkey, least(5.0, greatest(2.0, x)) AS line,
        least(45.0, greatest(5.0, l_quantity)) AS l_quantity
        FROM (SELECT *, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem WHERE l_linenumber <> 7)
        UNION ALL SELECT l_orderkey, l_partkey, NULL, least(45.0, greatest(5.0, l_quantity))
        FROM lineitem WHERE l_linenumber = 7""",
    "clip_quantile": """SELECT l_orderkey, l_partkey, round(least(greatest(l_extendedprice, lo), hi), 6) AS l_extendedprice,
        round(least(greatest(l_quantity, 0), qhi), 6) AS l_quantity
        FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi,
                        quantile_cont(l_quantity, 0.999) AS qhi FROM lineitem)""",
    "impute_median": """SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END,
        (SELECT median(o_totalprice) FROM orders WHERE o_orderkey % 7 <> 0)), 6) AS price FROM orders""",
    "dedup_keep_first": """SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
    "latest_per_key": """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "clean_waiting_list": """SELECT trust_code, specialty_id, period,
        CAST(least(waiting_list_size, 200000) AS DOUBLE) AS waiting_list_size,
        round(coalesce(m, (SELECT median(m) FROM (SELECT CASE WHEN waiting_list_size % 5 <> 0
          THEN least(365.0, greatest(0.0, median_wait_days)) END AS m FROM waiting))), 6) AS median_wait_days
        FROM (SELECT *, CASE WHEN waiting_list_size % 5 <> 0 THEN least(365.0, greatest(0.0, median_wait_days)) END AS m
              FROM waiting)""",
    "clean_activity": f"WITH kept AS (SELECT * FROM activity WHERE {VALID_DATE}) " + clipped_activity("kept"),
    "clean_activity_counts": f"""SELECT count(*) FILTER (WHERE {VALID_DATE}) AS kept, count(*) FILTER (WHERE NOT ({VALID_DATE})) AS dropped,
        CAST(sum(admissions) AS BIGINT) AS line_items, count(*) AS all_rows FROM activity""",
    "star_fact": """SELECT row_number() OVER (ORDER BY a.date, hospital_id, a.specialty_id) * 1000 + 1 AS activity_id,
        a.date AS date_key, h.hospital_id, a.specialty_id, h.region_id, admissions, discharges,
        round_even(bed_occupancy_count::DOUBLE / nullif(h.bed_capacity, 0)::DOUBLE * 100 * 100, 0) / 100 AS bed_occupancy_pct, bed_occupancy_count,
        CAST(w.waiting_list_size AS BIGINT) AS waiting_list_size,
        CASE WHEN w.median_wait_days IS NOT NULL THEN round(least(365.0, greatest(0.0, w.median_wait_days)), 2) END AS median_wait_days,
        s.staff_count, s.vacancies, CAST(s.vacancy_rate AS DOUBLE) AS vacancy_rate, ae_attendances, referrals,
        CASE WHEN i.flu_index IS NOT NULL THEN round(least(50.0, i.flu_index), 2) END AS flu_index,
        CASE WHEN i.covid_index IS NOT NULL THEN least(50.0, i.covid_index) END AS covid_index,
        CASE WHEN t.avg_temp_c IS NOT NULL THEN round(least(40.0, greatest(-15.0, t.avg_temp_c)), 1) END AS avg_temp_c
        FROM clipped a LEFT JOIN hospitals h USING (trust_code) LEFT JOIN staff s USING (trust_code)
        LEFT JOIN waiting w ON w.trust_code = a.trust_code AND w.specialty_id = a.specialty_id
                           AND w.period = strftime(a.date, '%Y-%m')
        LEFT JOIN illness i ON i.date = a.date LEFT JOIN weather t ON t.date = a.date AND t.region_id = h.region_id""",
    "union_by_name": """SELECT c_name AS name, c_acctbal AS balance, NULL::BIGINT AS nation FROM customer
        UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier""",
    "season_flags": f"""SELECT o_orderkey, date_key, {CALENDAR}, {SEASON} AS season, {FLU} AS flu_season,
        strftime(date_key, '%Y-%m') AS year_month FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date_key FROM orders)""",
    "minute_floor": "SELECT date_trunc('minute', ts) AS minute_ts, count(*) AS n FROM events GROUP BY 1",
    "postcode_region": """SELECT c_custkey, (['YOR', 'LON', 'MDL', 'LON', 'MDL', 'LON', 'MDL'])[CAST(c_custkey % 7 + 1 AS INT)]
        AS region_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'NW' ELSE 'MDL' END AS segment_region,
        (['LON', 'EST', 'Wales'])[CAST(c_custkey % 3 + 1 AS INT)] AS label_region FROM customer""",
    "organisation_flatten": """SELECT 'R' || s_suppkey || x AS trust_code,
        s_name || ' ' || 'General Hospital ' || x || ' NHS Trust' AS trust_name, 'YOR' AS region_id, 'Acute' AS hospital_type,
        CAST(300 + (('0x' || substr(md5('R' || s_suppkey || x), 1, 8))::BIGINT % 25) * 50 AS BIGINT) AS bed_capacity
        FROM supplier, (VALUES ('A'), ('B')) v(x) WHERE s_suppkey % 4 = 0""",
    "weather_flatten": f"""SELECT date, region_id, {exact('round(avg_temp_c, 6)', 1)} + 0.0 AS avg_temp_c FROM weather
        WHERE day(date) <> 13 AND date <= (SELECT max(date) - 5 FROM weather WHERE day(date) <> 13)""",
    "stream_minute_agg": "SELECT * FROM minutes",
    "batch_minute_agg": "SELECT * FROM minutes",
    "stream_dead_letters": """SELECT 'H0' AS key, substr(props, 1, 3) AS value, count(*) AS n FROM events
        WHERE value > 95 GROUP BY 2""",
    "stream_watermark_windows": "SELECT * FROM minutes",
    "event_messages": """SELECT hospital_id, CASE event_type WHEN 'purchase' THEN 'ambulance' WHEN 'click' THEN 'referral'
        ELSE 'walk_in' END AS arrival_mode, count(*) AS n FROM sent GROUP BY 1, 2
        UNION ALL SELECT 'dead', 'none', count(*) FROM events WHERE value > 95 HAVING count(*) > 0""",
    "landed_workforce": "SELECT * FROM workforce",
    "exported_csv": "SELECT * FROM pressure",
    "partitioned_tree": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment AS segment FROM customer",
    "json_records": """SELECT to_json({'o_orderkey': o_orderkey, 'o_orderdate': strftime(o_orderdate, '%Y-%m-%d'),
        'o_orderpriority': o_orderpriority, 'o_custkey': CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END})::VARCHAR
        AS record FROM orders""",
    "workforce_totals": "SELECT trust_code, staff_count, vacancies, CAST(vacancy_rate AS DOUBLE) AS vacancy_rate FROM staff",
    "monthly_waiting": """SELECT trust_code, specialty_id, period AS ym, waiting_list_size, median_wait_days FROM waiting""",
    "bed_capacity": "SELECT trust_code, bed_capacity FROM hospitals",
    "recommendations_ranked": """SELECT row_number() OVER (ORDER BY hospital_id, rank) AS recommendation_id,
        severity, hospital_name FROM hits""",
    "validation_metrics": f"""SELECT *, CASE WHEN accuracy >= 85 THEN 'Green' WHEN accuracy >= 70 THEN 'Amber' ELSE 'Red' END AS band
        FROM (SELECT target, 'orders' AS model, 30::BIGINT AS holdout_days,
        {exact('avg(abs(actual - predicted))', 2)} AS mae, {exact('avg(abs((actual - predicted) / actual)) * 100', 2)} AS mape,
        {exact('greatest(0.0, 100 - avg(abs((actual - predicted) / actual)) * 100)', 1)} AS accuracy, count(*) AS n_eval
        FROM paired WHERE actual IS NOT NULL AND actual <> 0 GROUP BY 1)""",
    "model_accuracy": f"""SELECT round(avg(a), 6) AS model_accuracy_pct FROM (SELECT
        {exact('greatest(0.0, 100 - avg(abs((actual - predicted) / actual)) * 100)', 1)} AS a
        FROM paired WHERE actual IS NOT NULL AND actual <> 0 GROUP BY target)""",
    "stream_trailing_window": "SELECT * FROM trail_minutes",
    "stream_totals": """SELECT CAST(coalesce(sum(attendances), 0) AS BIGINT) AS attendances,
        CAST(coalesce(sum(ambulance), 0) AS BIGINT) AS ambulance, CAST(coalesce(sum(breach_risk), 0) AS BIGINT) AS breach_risk
        FROM trail_minutes""",
    "stream_run_summary": """SELECT count(*) AS rows, count(DISTINCT minute_ts) AS minutes,
        CAST(sum(attendances) AS BIGINT) AS attendances, CAST(sum(ambulance) AS BIGINT) AS ambulance,
        CAST(sum(high_acuity) AS BIGINT) AS high_acuity, CAST(sum(breach_risk) AS BIGINT) AS breach_risk FROM minutes""",
    "no_loss_check": """SELECT 'events lost' AS check, (SELECT count(*) FROM events)
        - (SELECT CAST(sum(attendances) AS BIGINT) FROM minutes) AS violations""",
    "dept_state": "SELECT * FROM dept_minutes",
    "dept_latest": """SELECT minute_ts, arrivals, available_beds, queue_length, ambulances_waiting, breach_risk, occupancy_pct
        FROM dept_minutes ORDER BY minute_ts DESC LIMIT 1""",
    "pressure_metrics": f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY minute_ts DESC) AS rn FROM dept_minutes),
        a AS (SELECT avg(arrivals) FILTER (WHERE rn <= 20) AS arr, greatest(avg(arrivals) FILTER (WHERE rn > 20), 0.01) AS arr0,
              avg(occupancy_pct) FILTER (WHERE rn <= 20) AS occ, any_value(available_beds) FILTER (WHERE rn = 1) AS beds,
              avg(available_beds) FILTER (WHERE rn > 20) AS beds0, any_value(queue_length) FILTER (WHERE rn = 1) AS queue,
              any_value(ambulances_waiting) FILTER (WHERE rn = 1) AS amb_now,
              avg(ambulances_waiting) FILTER (WHERE rn <= 20) AS amb,
              greatest(avg(ambulances_waiting) FILTER (WHERE rn > 20), 0.01) AS amb0 FROM r)
        SELECT {exact('(arr - arr0) / arr0 * 100', 1)} AS arrivals_vs_baseline_pct, {exact('occ', 1)} AS occupancy_pct,
               beds AS available_beds_now, CAST(trunc(beds - beds0) AS BIGINT) AS available_beds_change, queue AS queue_now,
               amb_now AS ambulances_waiting_now, {exact('(amb - amb0) / amb0 * 100', 1)} AS ambulances_vs_baseline_pct FROM a""",
    "live_measures": """SELECT avg(occupancy_pct) AS live_occupancy_pct, CAST(sum(ambulances_waiting) AS BIGINT) AS ambulances_waiting,
        CAST(sum(available_beds) AS BIGINT) AS beds_available_now, CAST(sum(queue_length) AS BIGINT) AS patients_queued_now
        FROM dept WHERE minute_ts = (SELECT max(minute_ts) FROM dept)""",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round_even(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) * 100, 0) / 100 + 0.0 AS r FROM fact"
        for i, a in enumerate(CORR) for b in CORR[i + 1:]
    ),
    "describe": " UNION ALL ".join(describe(c) for c in DESCRIBED),
    "mape_scores": f"""SELECT target, {exact('avg(abs(actual - predicted))', 2)} AS mae,
        {exact('avg(abs((actual - predicted) / actual)) * 100', 2)} AS mape,
        {exact('greatest(0.0, 100 - avg(abs((actual - predicted) / actual)) * 100)', 1)} AS accuracy, count(*) AS n_eval
        FROM paired WHERE actual IS NOT NULL AND actual <> 0 GROUP BY 1""",
    "mean_errors": """SELECT round(avg(abs(actual - predicted)), 6) AS mae,
        round(avg(abs((actual - predicted) / actual)), 6) AS mape FROM paired WHERE actual IS NOT NULL""",
    "trend_weekday_baseline": """WITH f AS (SELECT regr_slope(ae, epoch(date_key) / 86400) AS s,
          regr_intercept(ae, epoch(date_key) / 86400) AS i FROM daily_ae),
        t AS (SELECT date_key, ae, s * (epoch(date_key) / 86400) + i AS trend, isodow(date_key) AS w FROM daily_ae, f),
        e AS (SELECT w, avg(ae - trend) AS effect FROM t GROUP BY 1)
        SELECT date_key, round(ae, 4) AS ae, round(trend + effect, 4) AS baseline FROM t JOIN e USING (w)""",
    "intent_routing": """SELECT conv_id, turn, CASE WHEN contains(q, 'wait') THEN 'wait'
        WHEN contains(q, 'a&e') OR contains(q, 'a & e') OR contains(q, 'a and e') OR contains(q, 'ae') OR contains(q, 'emergency') THEN 'ae'
        WHEN contains(q, 'staff') OR contains(q, 'workforce') OR contains(q, 'vacanc') THEN 'staff'
        WHEN contains(q, 'bed') OR contains(q, 'occupanc') THEN 'bed' ELSE 'risk' END AS intent,
        coalesce(nullif(concat_ws(',',
          CASE WHEN contains(q, 'wait') OR contains(q, 'forecast') OR contains(q, 'ae') OR contains(q, 'bed') THEN 'ForecasterAgent' END,
          CASE WHEN contains(q, 'staff') OR contains(q, 'workforce') OR contains(q, 'nurse') OR contains(q, 'doctor') THEN 'WorkforceAgent' END,
          CASE WHEN contains(q, 'risk') OR contains(q, 'overload') OR contains(q, 'pressure') OR contains(q, 'red') THEN 'RiskAgent' END), ''),
          'RiskAgent') AS agents FROM (SELECT *, lower(text) AS q FROM conversations)""",
    "sql_audit": """SELECT event_id AS id, CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN 'not a select'
        WHEN 'purchase' THEN 'multiple statements' WHEN 'signup' THEN 'no allowed table' ELSE 'forbidden keyword' END AS reason,
        event_type = 'click' AS accepted FROM events
        UNION ALL SELECT -conv_id * 1000 - turn, CASE
          WHEN contains(rtrim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ';'), ';') THEN 'multiple statements'
          WHEN NOT regexp_matches(text, '(?i)^\\s*select\\b') THEN 'not a select' ELSE 'other' END, false FROM conversations""",
    "verdict_bands": """SELECT p_partkey, (['Green', 'Amber', 'Red'])[r + 1] AS relative, (['Green', 'Amber', 'Red'])[a + 1] AS absolute,
        (['Green', 'Amber', 'Red'])[greatest(r, a) + 1] AS final, (['Green', 'Amber', 'Red'])[r + 1] AS band,
        CASE WHEN x / 2 >= 12 THEN 'Red' WHEN x / 2 >= 8 THEN 'Amber' ELSE 'Green' END AS vacancy,
        CASE WHEN x + 50 >= 85 THEN 'Green' WHEN x + 50 >= 70 THEN 'Amber' ELSE 'Red' END AS accuracy,
        CAST(x / 2 > 9 AS BIGINT) AS short, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (x - 25) / 10)) AS clipped
        FROM (SELECT p_partkey, x, CASE WHEN (x - 25) / 10 < 0 THEN 0 WHEN (x - 25) / 10 < 1 THEN 1 ELSE 2 END AS r,
              CASE WHEN x + 50 >= 95 OR x / 2 >= 15 THEN 2 WHEN x + 50 >= 92 OR x / 2 >= 12 THEN 1 ELSE 0 END AS a
              FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part))""",
}
PARTS["clipped"] = clipped_activity("activity")

# The job's window: clip bounds and waiting periods from its rows only.
PARTS["window_activity"] = "SELECT * FROM activity WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'"
PARTS["window_clipped"] = clipped_activity("window_activity")
SQL["job_fact"] = SQL["star_fact"].replace("FROM clipped a", "FROM window_clipped a")
# loaded in parts: clipped by the bounds of the whole feed
PARTS["clipped_window"] = "SELECT * FROM clipped WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'"
SQL["job_increments"] = SQL["star_fact"].replace("FROM clipped a", "FROM clipped_window a")

SQL["pressure_metrics"] = f"""WITH m AS ({SQL['pressure_metrics']})
    SELECT *, 'Recent arrivals are ' || CASE WHEN arrivals_vs_baseline_pct >= 0 THEN '+' ELSE '' END || arrivals_vs_baseline_pct
        || ' % against the time before; beds are ' || occupancy_pct || ' % full with ' || available_beds_now || ' free ('
        || CASE WHEN available_beds_change >= 0 THEN '+' ELSE '' END || available_beds_change || '); ' || queue_now
        || ' patients and ' || ambulances_waiting_now || ' ambulances wait, ambulances '
        || CASE WHEN ambulances_vs_baseline_pct >= 0 THEN '+' ELSE '' END || ambulances_vs_baseline_pct || ' %.' AS summary
    FROM m"""

# Model jobs: what can be known without the fitted numbers.
_DAYS = "SELECT date_key, avg(CAST(bed_occupancy_pct AS DOUBLE)) AS v FROM fact GROUP BY 1 HAVING v IS NOT NULL"
SQL["training_days"] = f"""WITH days AS ({_DAYS})
    SELECT date_key, round(v, 6) AS bed_occupancy_pct, {', '.join(f"round(lag(v, {n}) OVER w, 6) AS bed_occupancy_pct_lag{n}" for n in (1, 7, 14, 30))},
        {', '.join(f"round(avg(v) OVER (ORDER BY date_key ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS bed_occupancy_pct_roll{n}" for n in (7, 14, 30))},
        CAST(month(date_key) AS BIGINT) AS month, CAST(isodow(date_key) - 1 AS BIGINT) AS dow
    FROM days WINDOW w AS (ORDER BY date_key)"""
SQL["trained_forecasts"] = """WITH ends AS (SELECT min(date_key) AS a, max(date_key) AS b, count(DISTINCT date_key) AS n FROM fact),
    horizons(h) AS (VALUES (30), (60), (90)),
    waits AS (SELECT h, date_key + CAST(h AS INT) AS target_date, hospital_id FROM fact, horizons),
    found AS (
        SELECT 'bed_occupancy' AS target, 'trend_gbt' AS model, 90 AS horizon_days, true AS is_future, 90 AS n,
               CAST(b + 1 AS DATE) AS first_day, CAST(b + 90 AS DATE) AS last_day, 0 AS hospitals, 0 AS roles FROM ends
        UNION ALL SELECT 'ae_demand', 'trend', 90, true, 90, CAST(b + 1 AS DATE), CAST(b + 90 AS DATE), 0, 0 FROM ends
        UNION ALL SELECT 'ae_demand', 'trend', 90, false, n, a, b, 0, 0 FROM ends
        UNION ALL SELECT 'waiting_time', 'gbt', h, target_date > b, count(*), min(target_date), max(target_date), count(DISTINCT hospital_id), 0
            FROM waits, ends GROUP BY h, target_date > b
        UNION ALL SELECT 'workforce_demand', 'gbt', 60, true, count(*), DATE '2025-06-01', DATE '2025-06-01',
            count(DISTINCT trust_code), count(DISTINCT role) FROM workforce)
    SELECT target, model, CAST(horizon_days AS BIGINT) AS horizon_days, is_future, CAST(n AS BIGINT) AS n, CAST(first_day AS DATE) AS first_day,
        CAST(last_day AS DATE) AS last_day, CAST(hospitals AS BIGINT) AS hospitals, CAST(roles AS BIGINT) AS roles,
        0::BIGINT AS unknown, 0::BIGINT AS crossed_bands FROM found"""
SQL["naive_backtest"] = f"""WITH f AS (SELECT *, CAST(max(date_key) OVER () - 30 AS DATE) AS cutoff FROM fact),
    days AS (SELECT date_key, any_value(cutoff) AS cutoff, avg(CAST(bed_occupancy_pct AS DOUBLE)) AS beds,
                    CAST(sum(ae_attendances) AS DOUBLE) AS ae FROM f GROUP BY 1),
    asked AS (SELECT *, CAST(date_key - CAST(7 * ceil((date_key - cutoff) / 7.0) AS INT) AS DATE) AS source FROM days WHERE date_key > cutoff),
    pairs AS (
        SELECT 'Capacity pressure' AS target, a.beds AS actual, p.beds AS predicted FROM asked a JOIN days p ON p.date_key = a.source
        UNION ALL SELECT 'A&E demand', a.ae, p.ae FROM asked a JOIN days p ON p.date_key = a.source
        UNION ALL SELECT 'Waiting time', CAST(b.median_wait_days AS DOUBLE), CAST(a.median_wait_days AS DOUBLE)
            FROM f a JOIN f b ON a.hospital_id = b.hospital_id AND a.specialty_id = b.specialty_id AND b.date_key = a.date_key + 30
            WHERE a.date_key <= a.cutoff AND b.date_key > b.cutoff),
    known AS (SELECT * FROM pairs WHERE actual <> 0 AND predicted IS NOT NULL)
    SELECT target, 'naive' AS model, {exact('avg(abs(actual - predicted))', 2)} AS mae,
        {exact('avg(abs((actual - predicted) / actual)) * 100', 2)} AS mape,
        {exact('greatest(0.0, 100 - avg(abs((actual - predicted) / actual)) * 100)', 1)} AS accuracy,
        count(*) AS n_eval, 30::BIGINT AS holdout_days FROM known GROUP BY 1"""
SQL |= {
    "waiting_list_files": """SELECT trust_code, specialty_id, period, CAST(least(waiting_list_size, 200000) AS DOUBLE) AS waiting_list_size,
        round(least(365.0, greatest(0.0, median_wait_days)), 6) AS median_wait_days FROM waiting""",
    "clean_dimension": "SELECT 'S' || s_suppkey AS hospital_id, s_name AS hospital_name FROM supplier",
    "clean_demographics": "SELECT 'R' || r_regionkey AS region_id, r_name AS region_name FROM region",
    "json_documents": """SELECT CAST(s_nationkey AS BIGINT) AS nation, count(*) AS n,
        string_agg(CAST(s_suppkey AS VARCHAR), '-' ORDER BY s_suppkey) AS suppliers FROM supplier GROUP BY 1""",
    "listed_files": "SELECT DISTINCT c_mktsegment AS segment FROM customer",
    "typed_fallback": "SELECT c_name, c_acctbal, CAST(NULL AS VARCHAR) AS note FROM customer",
    "bucketed_month_bridge": f"""SELECT a.trust_code, a.specialty_id, a.date AS date_key, admissions, w.waiting_list_size, round(w.median_wait_days, 6) AS median_wait_days,
        {rolls('admissions', over="PARTITION BY a.trust_code, a.specialty_id ORDER BY a.date")}
        FROM activity a LEFT JOIN waiting w ON w.trust_code = a.trust_code AND w.specialty_id = a.specialty_id
        AND w.period = strftime(a.date, '%Y-%m')""",
    "observed_checks": """SELECT unnest(['n_rows', 'date_key_nulls', 'hospital_id_nulls', 'specialty_id_nulls', 'admissions_min',
            'admissions_max', 'waiting_list_size_null_share', 'rows_read_back']) AS rule,
        unnest([n, days, hospitals, specialties, low, high, round(waits / n, 9), n]) AS value
        FROM (SELECT count(*)::DOUBLE AS n, (count(*) - count(date_key))::DOUBLE AS days,
                     (count(*) - count(hospital_id))::DOUBLE AS hospitals, (count(*) - count(specialty_id))::DOUBLE AS specialties,
                     min(admissions)::DOUBLE AS low, max(admissions)::DOUBLE AS high,
                     (count(*) - count(waiting_list_size))::DOUBLE AS waits FROM fact)""",
    "live_national": "SELECT * FROM dept_minutes",
    "live_newest": """SELECT minute_ts, hospital_id, CAST(arrivals AS BIGINT) AS arrivals, CAST(admissions AS BIGINT) AS admissions,
        CAST(discharges AS BIGINT) AS discharges, CAST(available_beds AS BIGINT) AS available_beds,
        CAST(queue_length AS BIGINT) AS queue_length, CAST(ambulances_waiting AS BIGINT) AS ambulances_waiting,
        CAST(breach_risk AS BIGINT) AS breach_risk, CAST(occupancy_pct AS DOUBLE) AS occupancy_pct
        FROM dept QUALIFY row_number() OVER (PARTITION BY hospital_id ORDER BY minute_ts DESC) = 1""",
    "closed_days": """SELECT date_trunc('minute', ts) AS minute_ts, hospital_id, min(region_id) AS region_id,
        count(*) AS attendances, count(*) FILTER (WHERE event_type = 'purchase') AS ambulance,
        count(*) FILTER (WHERE k < 40) AS high_acuity, count(*) FILTER (WHERE value > 50) AS breach_risk, late
        FROM (SELECT *, event_id % 8 > 4 AND ts < TIMESTAMP '2024-01-11' AS late FROM sent) GROUP BY 1, 2, late""",
    "asof_every_row": """SELECT l.hospital_id, l.specialty_id, l.date_key, l.waiting_list_size, r.date_key AS asof_date_key,
        r.waiting_list_size AS asof_waiting_list_size
        FROM (SELECT *, CAST(date_key - 30 AS DATE) AS moment FROM fact) l
        ASOF LEFT JOIN (SELECT * FROM fact WHERE waiting_list_size IS NOT NULL) r
        ON l.hospital_id = r.hospital_id AND l.specialty_id = r.specialty_id AND l.moment >= r.date_key""",
    "archived_events": "SELECT hospital_id, count(*) AS n, count(DISTINCT event_id) AS events FROM sent GROUP BY 1",
    "events_by_day": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1",
    "answered_question": SQL["intent_wait"],
}


def _needed(sql: str) -> list[str]:
    """Sub-queries a text mentions, in dependency order."""
    import re

    order: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in order and re.search(rf"\b{name}\b(?!\s*\()", text):
                visit(PARTS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        parts = ",\n".join(f"{p} AS ({PARTS[p]})" for p in _needed(sql))
        if sql.startswith("WITH "):
            sql = sql[5:]
            out[name] = f"WITH {parts}, {sql}" if parts else f"WITH {sql}"
        else:
            out[name] = f"WITH {parts} {sql}" if parts else sql
    return out
