import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wardflow import schemas
from wardflow.plans import questions
from wardflow.sources import jdbc, kafka, layers, nested, scans, tables

from .util import column, day, rows


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "w.csv").write_text("trust_code,specialty,period,waiting_list_size,median_wait_days\nRXH,CARD,2025-01,5,1.5\n")
    assert rows(scans.read_csv(spark, str(tmp_path / "w.csv"), schemas.WAITING_LIST)) == [("RXH", "CARD", "2025-01", 5, 1.5)]
    doc = {"region_id": "LON", "daily": {"time": ["2025-01-01", "2025-01-02"], "temperature_2m_mean": [1.25, None]}}
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=1))
    flat = nested.flatten_weather(scans.read_json_documents(spark, str(tmp_path / "doc.json"), schemas.WEATHER_DOCUMENT))
    assert rows(flat) == [(day("2025-01-01"), "LON", round(1.25, 1))]


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.read_parquet(spark, str(tmp_path / "none"))


def test_organisations(spark):
    orgs = [("R1", "LEEDS GENERAL NHS TRUST", "LS1 1AA"), ("R2", "X MENTAL HEALTH TRUST", "E1"), ("R3", "kent acute", None)]
    text = json.dumps({"Organisations": [dict(zip(("OrgId", "Name", "PostCode"), o)) for o in orgs]})
    df = nested.parse(spark.createDataFrame([(text,)], "document string"), "document", schemas.ORGANISATIONS)
    flat = nested.flatten_organisations(df)
    assert rows(flat.select("trust_code", "trust_name", "region_id", "hospital_type")) == [
        ("R1", "Leeds General NHS Trust", "YOR", "Acute"), ("R3", "Kent Acute", "MDL", "Acute")
    ]
    assert column(nested.flatten_organisations(df, limit=1), "trust_code") == ["R1"]


def test_source_lag(spark):
    df = spark.createDataFrame([(day("2025-01-10"),), (day("2025-01-16"),)], "date date")
    today = F.lit("2025-01-20").cast("date")
    assert nested.within_source_lag(df, F.lit("2025-01-31").cast("date"), today).count() == 1
    d = dt.date
    assert nested.capped_window(d(2025, 1, 1), d(2025, 1, 31), d(2025, 1, 20)) == (d(2025, 1, 1), d(2025, 1, 15))
    with pytest.raises(ValueError):
        nested.capped_window(d(2025, 1, 18), d(2025, 1, 31), d(2025, 1, 20))


def test_landing_is_appended_and_rerunnable(spark, tmp_path):
    a = spark.createDataFrame([("A", "n", 1, "c")], schemas.DEMOGRAPHICS)
    b = spark.createDataFrame([("A", "later", 2, "c")], schemas.DEMOGRAPHICS)
    tables.land({"demographics": a}, str(tmp_path), "2025-01-01")
    tables.land({"demographics": b}, str(tmp_path), "2025-01-02")
    tables.land({"demographics": b}, str(tmp_path), "2025-01-02")
    landed = scans.read_landed(spark, f"{tmp_path}/demographics", schemas.DEMOGRAPHICS)
    assert landed.count() == 2
    from wardflow.plans.silver import clean_demographics

    assert rows(clean_demographics(landed)) == [("A", "n", 1, "c")]  # first delivery wins


def test_discovery_and_partitioned_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    tables.write_parquet(df, f"{tmp_path}/x/y", ["k"])
    files = scans.list_parquet_files(spark, str(tmp_path)).collect()
    assert len(files) == 2 and all(f.path.endswith(".parquet") for f in files)
    tree = scans.read_tree(spark, str(tmp_path), spark.createDataFrame([], "n int").schema)
    assert sorted(column(tree, "n")) == [1, 2]


def test_tables(spark, tmp_path):
    assert tables.table_or_empty(spark, "no_such_table", schemas.RISK).schema == schemas.RISK
    df = spark.createDataFrame([("H1", 1.0005)], "hospital_id string, score double")
    tables.replace_load(df, "risk_t", schemas.RISK, f"{tmp_path}/risk")
    got = tables.table_or_empty(spark, "risk_t", schemas.RISK).first()
    assert got.hospital_id == "H1" and str(got.score) == "1.001" and got.risk_id is None
    tables.create_or_replace(df, "any_t", f"{tmp_path}/any")
    tables.create_or_replace(df.withColumn("more", F.lit(1)), "any_t", f"{tmp_path}/any")
    assert spark.table("any_t").columns == ["hospital_id", "score", "more"]


def test_export(spark, tmp_path, caplog):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 12), 1)], "minute_ts timestamp, n int")
    assert tables.export_csv({"a": df, "gone": None}, str(tmp_path)) == ["a"]
    assert "gone" in caplog.text
    assert spark.read.option("header", True).csv(f"{tmp_path}/a").first().minute_ts == "2025-01-01T12:00:00.000"
    df.createOrReplaceTempView("ae_dept_state")
    assert "ae_dept_state" in tables.export_views(spark, f"{tmp_path}/all")


def test_stored_layer(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    stored = layers.store(df, "t")
    assert rows(stored) == rows(df)
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,4)]" in stored.filter("x > 4")._jdf.queryExecution().executedPlan().toString()


def test_jdbc_options():
    assert jdbc.write_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": "t", "batchsize": "200", "truncate": "false"}
    assert kafka.source_options("b:9092", ["ae"], "g", 10) == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "ae", "startingOffsets": "earliest",
        "kafka.group.id": "g", "maxOffsetsPerTrigger": "10",
    }
    assert kafka.sink_options("b:9092", "ae") == {"kafka.bootstrap.servers": "b:9092", "topic": "ae"}


class StandInFrame:
    """Stands for a DataFrame: records the JDBC writes and fails the first ones."""

    def __init__(self, failures):
        self.failures, self.saved, self.write = failures, [], self

    def format(self, name):
        self.target = {"format": name}
        return self

    def options(self, **kw):
        self.target |= kw
        return self

    def mode(self, mode):
        self.target["mode"] = mode
        return self

    def save(self):
        if self.failures:
            self.failures -= 1
            raise OSError("statement timeout")
        self.saved.append(self.target)


def test_write_retries():
    waits, frame = [], StandInFrame(1)
    assert jdbc.write_table(frame, "jdbc:x", "t", "replace", sleep=waits.append) == 2
    assert waits == [2] and frame.saved[0]["batchsize"] == "200" and frame.saved[0]["mode"] == "overwrite"
    waits, frame = [], StandInFrame(4)
    with pytest.raises(OSError):
        jdbc.write_table(frame, "jdbc:x", "t", "replace", sleep=waits.append)
    assert waits == [2, 4, 8] and not frame.saved
    with pytest.raises(ValueError):
        jdbc.write_table(frame, "jdbc:x", "t")


def test_errors_that_stay_are_not_retried():
    def wrong():
        raise ValueError("column n_beds does not exist")

    waits = []
    with pytest.raises(ValueError):
        jdbc.with_retries(wrong, "t", waits.append)
    assert waits == []


def test_partly_committed_attempt_does_not_double_rows():
    """A stand-in database whose first attempt loads half of the rows, then loses the connection."""
    tables, swaps = {"t": [0], "t_staging": []}, []

    class Frame(StandInFrame):
        def save(self):
            rows = tables[self.target["dbtable"]]
            if self.target["mode"] == "overwrite":
                rows.clear()
            rows.extend([1, 2] if self.failures else [1, 2, 3, 4])
            super().save()

    def swap(staging, table):
        swaps.append(table)
        tables[table] += tables[staging]

    write = jdbc.publisher("jdbc:x", swap)
    frame = Frame(1)
    frame_write = jdbc.write_table(frame, "jdbc:x", "t", sleep=lambda s: None, swap=swap)
    assert frame_write == 2 and swaps == ["t"] and tables["t"] == [0, 1, 2, 3, 4]
    write(Frame(0), "t", "append")
    assert tables["t"] == [0, 1, 2, 3, 4, 1, 2, 3, 4]


def test_retried_append_goes_through_a_staging_table():
    moved, frame = [], StandInFrame(2)
    jdbc.write_table(frame, "jdbc:x", "t", sleep=lambda s: None, swap=lambda a, b: moved.append((a, b)))
    assert frame.saved[0]["dbtable"] == "t_staging" and frame.saved[0]["mode"] == "overwrite"
    assert moved == [("t_staging", "t")]


def test_publish_order():
    log = []
    given = {n: n for n in ("recommendation", "hospital_activity_fact", "dim_date", "model_metrics")}
    loaded = jdbc.publish(
        given, lambda df, name, mode: log.append((name, mode)), lambda names: log.append("clear"), lambda: log.append("views")
    )
    assert loaded == ["dim_date", "hospital_activity_fact", "recommendation", "model_metrics"]
    assert log == ["clear", ("dim_date", "append"), ("hospital_activity_fact", "append"), ("recommendation", "append"),
                   ("model_metrics", "replace"), "views"]


def test_parameterised_query(spark):
    spark.createDataFrame([("a", 1), ("b", 2)], "t string, n int").createOrReplaceTempView("pq")
    assert rows(jdbc.query_view(spark, "SELECT n FROM pq WHERE t = :t", t="b")) == [(2,)]


def test_question_tables(spark):
    df = spark.createDataFrame([("A&E surge",), ("hello",)], "question string")
    assert [(r.intent, r.agents) for r in questions.route(df).collect()] == [("ae", ["RiskAgent"]), ("risk", ["RiskAgent"])]
    log = spark.createDataFrame([("select 1 from dim_region",), ("drop x",)], "sql string")
    assert column(questions.audit(log), "accepted") == [True, False]
    recent = spark.createDataFrame([("b", 30, 1.25), ("a", 90, 2.0)], "target string, horizon_days int, yhat double")
    assert questions.forecast_summary(recent).first()[0] == f"a @ horizon 90d ≈ 2.0\nb @ horizon 30d ≈ {1.25:.1f}"
    assert questions.forecast_summary(recent.limit(0)).first()[0] == "No forecasts available."
