import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardflow.streaming import department, events, live, minute_counts

START = dt.datetime(2025, 3, 1, 8)
VALUES = (*department.SUMS, "occupancy_pct")


def states(minutes, hospitals=("H1", "H2", "H3")):
    return [
        (START + dt.timedelta(minutes=m), h, 10 + m % 7, m % 3, 2, 50 - m % 11, 20 + k, m % 5, m % 2, 60.0 + (m + k) % 30)
        for m in range(minutes) for k, h in enumerate(hospitals)
    ]


def deliver(spark, path, *batches):
    """One file per batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, live.STATE).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, work, folder, schema, key, table=None):
    stream = events.replay(spark, path, schema=live.STATE, files_per_batch=1)
    table = table or f"{folder}/log"
    q = live.start_live(work(stream), table, f"{folder}/checkpoint")
    minute_counts.run_bounded(q, 240)
    return q, live.read_live(spark, table, schema, key)


def test_newest_row_of_each_hospital(spark, tmp_path):
    rows = states(40)
    random.Random(1).shuffle(rows)
    late = [rows[0][:1] + rows[0][1:]]  # delivered again, in a later batch
    deliver(spark, f"{tmp_path}/in", rows[:50], rows[50:90], rows[90:], late)
    _, got = run(spark, f"{tmp_path}/in", lambda s: live.newest_states(s, idle=500), tmp_path, live.NEWEST, "hospital_id")
    want = spark.createDataFrame(rows, live.STATE).groupBy("hospital_id").agg(
        F.max_by(F.struct("minute_ts", *VALUES), "minute_ts").alias("r")).select("hospital_id", "r.*")
    assert sorted(map(tuple, got.filter("is_live").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_national_minutes_equal_the_batch(spark, tmp_path):
    rows = states(30)
    again = rows[10:40]
    deliver(spark, f"{tmp_path}/in", rows[:30], again, rows[30:70], rows[70:])
    _, got = run(spark, f"{tmp_path}/in", live.national_minutes, tmp_path, live.MINUTE, "minute_ts")
    batch = department.national_series(spark.createDataFrame(rows, live.STATE))
    columns = ["minute_ts", *department.SUMS]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    pct = {r.minute_ts: r.occupancy_pct for r in batch.collect()}
    assert all(r.occupancy_pct == pytest.approx(pct[r.minute_ts], abs=0.051) and r.hospitals == 3 for r in got.collect())


def held(q):
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_state_is_bounded_and_late_rows_are_dropped(spark, tmp_path):
    """Ten hours in batches of half an hour: only the open minutes are kept."""
    rows = states(600, ("H1", "H2"))
    batches = [rows[i : i + 60] for i in range(0, 1200, 60)]
    too_late = [(START, "H1", *[1000] * 7, 99.0)]
    deliver(spark, f"{tmp_path}/in", *batches, too_late)
    q, got = run(spark, f"{tmp_path}/in", lambda s: live.national_minutes(s, 60), tmp_path, live.MINUTE, "minute_ts")
    assert max(held(q)) < 600  # of 1200 rows
    assert minute_counts.dropped_late(q) == 1
    first = got.filter(F.col("minute_ts") == F.lit(START)).first()
    assert first.is_closed and first.hospitals == 2 and first.arrivals == 20
    assert got.count() == 600 and got.filter("NOT is_closed").count() < 180


def test_silent_hospitals_are_forgotten(spark, tmp_path):
    early, later = states(10, ("H1", "H2")), [r for r in states(400, ("H2",)) if r[0] >= START + dt.timedelta(minutes=300)]
    deliver(spark, f"{tmp_path}/in", early, later[:50], later[50:])
    q, got = run(spark, f"{tmp_path}/in", lambda s: live.newest_states(s, 120, 30), tmp_path, live.NEWEST, "hospital_id")
    assert {r.hospital_id: r.is_live for r in got.collect()} == {"H1": False, "H2": True}
    assert got.filter("hospital_id = 'H1'").first().minute_ts == START + dt.timedelta(minutes=9)


def test_restart_goes_on_from_the_state(spark, tmp_path):
    rows = states(20)
    deliver(spark, f"{tmp_path}/in", rows[:30])
    run(spark, f"{tmp_path}/in", live.national_minutes, tmp_path, live.MINUTE, "minute_ts")
    deliver(spark, f"{tmp_path}/in", rows[30:])
    _, got = run(spark, f"{tmp_path}/in", live.national_minutes, tmp_path, live.MINUTE, "minute_ts")
    batch = department.national_series(spark.createDataFrame(rows, live.STATE))
    columns = ["minute_ts", *department.SUMS]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
