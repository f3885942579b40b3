import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from wardflow import schemas
from wardflow.operators.quality import reconcile
from wardflow.plans import questions, serving
from wardflow.streaming import department, events, minute_counts

from .util import rows

START = dt.datetime(2025, 1, 1, 8, 0, tzinfo=dt.timezone.utc)


def make_events(n=500, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        h = rng.choice(["H1"] * 6 + ["H2", "H3"])
        at = START + dt.timedelta(seconds=rng.randrange(3600))
        out.append((f"e{i}", h, "LON" if h == "H1" else "NW", at.isoformat(), rng.randint(1, 5),
                    rng.choice(["walk_in", "ambulance", "referral"]), rng.random() < 0.3))
    return out


@pytest.fixture(scope="module")
def sent(spark):
    return spark.createDataFrame(make_events(), schemas.EVENT)


def test_json_round_trip(spark, sent):
    messages = events.encode(sent)
    assert {r.key for r in messages.select("key").distinct().collect()} == {"H1", "H2", "H3"}
    decoded, dead = events.decode(messages)
    assert rows(decoded) == rows(sent) and dead.count() == 0
    assert set(json.loads(messages.first().value)) == set(schemas.EVENT.names)


def test_malformed_messages_are_kept_apart(spark):
    df = spark.createDataFrame([("{bad",), ('{"event_id": "x", "event_ts": "nope"}',), (None,)], "value string")
    good, dead = events.decode(df)
    assert (good.count(), dead.count()) == (0, 3)


def run(spark, folder, tmp, files_per_batch, name="t", trigger=None):
    stream = events.replay(spark, str(folder), files_per_batch=files_per_batch)
    q = minute_counts.start_counts(stream, f"{tmp}/{name}", f"{tmp}/{name}_cp", f"{tmp}/{name}_raw", trigger)
    minute_counts.run_bounded(q, 120)
    return minute_counts.read_counts(spark, f"{tmp}/{name}")


@pytest.fixture(scope="module")
def folder(sent, tmp_path_factory):
    path = tmp_path_factory.mktemp("events")
    sent.repartition(5).write.mode("overwrite").parquet(str(path))
    return path


def test_stream_equals_batch_and_loses_nothing(spark, sent, folder, tmp_path):
    counts = run(spark, folder, tmp_path, 1)
    assert rows(counts) == rows(minute_counts.minute_counts(sent))
    assert counts.agg(F.sum("attendances")).first()[0] == 500
    raw = spark.read.parquet(f"{tmp_path}/t_raw")
    assert raw.count() == 500 and rows(reconcile(counts, raw, "attendances")) == [("events lost", 0)]


def test_replayed_batch_does_not_count_twice(spark, sent, folder, tmp_path):
    counts = run(spark, folder, tmp_path, 2)
    before = rows(counts)
    # the same batch written again, as after a failure between write and commit
    batch = spark.read.schema(schemas.EVENT).parquet(f"{tmp_path}/t_raw/batch_id=0")
    minute_counts.minute_counts(batch).write.mode("overwrite").parquet(f"{tmp_path}/t/batch_id=0")
    assert rows(minute_counts.read_counts(spark, f"{tmp_path}/t")) == before
    # restarting on a drained source adds nothing
    assert rows(run(spark, folder, tmp_path, 2)) == before


def test_compacting_again_and_again_keeps_all_counts(spark, sent, folder, tmp_path):
    want, table = rows(run(spark, folder, tmp_path, 1)), f"{tmp_path}/t"
    for upto in (0, 2, 2, 3):
        minute_counts.compact(spark, table, upto)
        assert rows(minute_counts.read_counts(spark, table)) == want
        minute_counts.drop_folded(spark, table)
        assert rows(minute_counts.read_counts(spark, table)) == want
    # a base whose job did not end is not read
    minute_counts.minute_counts(sent).write.parquet(f"{table}_base/upto=4")
    (tmp_path / "t_base" / "upto=4" / "_SUCCESS").unlink()
    assert rows(minute_counts.read_counts(spark, table)) == want
    # late rows after a compaction still count
    minute_counts.minute_counts(sent.limit(7)).write.parquet(f"{table}/batch_id=9")
    assert minute_counts.read_counts(spark, table).agg(F.sum("attendances")).first()[0] == 507


def test_dead_letters_of_the_stream(spark, sent, tmp_path):
    bad = spark.createDataFrame([("H1", "{bad"), ("H1", None), (None, "7")], "key string, value string")
    events.encode(sent).unionByName(bad).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.replay(spark, f"{tmp_path}/in", schema="key string, value string", files_per_batch=1)
    q = minute_counts.start_counts(stream, f"{tmp_path}/t", f"{tmp_path}/cp", dead=f"{tmp_path}/dead")
    minute_counts.run_bounded(q, 120)
    assert rows(minute_counts.read_counts(spark, f"{tmp_path}/t")) == rows(minute_counts.minute_counts(sent))
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 3


def test_region_of_the_first_batch_wins(spark):
    at = dt.datetime(2025, 1, 1)
    log = spark.createDataFrame(
        [(at, "H1", "NW", 1, 0, 0, 0, 1), (at, "H1", "LON", 2, 1, 1, 1, 0)], minute_counts.LOG
    )
    assert rows(minute_counts.merge_counts(log)) == [(at, "H1", "LON", 3, 1, 1, 1)]


def test_watermarked_windows(spark, sent, folder, tmp_path):
    stream = events.replay(spark, str(folder), files_per_batch=1)
    q = minute_counts.start_windows(stream, f"{tmp_path}/w", f"{tmp_path}/w_cp", "1 day")
    minute_counts.run_bounded(q, 120)
    assert minute_counts.dropped_late(q) == 0
    assert rows(minute_counts.read_windows(spark, f"{tmp_path}/w")) == rows(minute_counts.minute_counts(sent))


def test_exactly_once_archive(spark, folder, tmp_path):
    stream = events.replay(spark, str(folder), files_per_batch=2)
    q = minute_counts.archive_events(stream, f"{tmp_path}/raw", f"{tmp_path}/cp")
    minute_counts.run_bounded(q, 120)
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 500


def test_trailing_series_and_totals(spark, sent):
    counts = minute_counts.minute_counts(sent)
    series = minute_counts.trailing_series(counts, 10)
    assert 0 < series.count() <= 11
    total = minute_counts.totals(series).first()
    assert total.attendances == sum(r.attendances for r in series.collect())
    nothing = minute_counts.totals(series.limit(0)).first()
    assert tuple(nothing) == (0, 0, 0)
    summary = minute_counts.run_summary(counts).first()
    assert summary.attendances == 500 and summary.rows == counts.count()


def states(minutes):
    return [
        (START + dt.timedelta(minutes=m), h, "LON", 10 + m, 0, 2, 1, 50, 20 - m % 5, 70, 60.0 + m % 40, m % 7, m % 3, 1, 1.0)
        for m in range(minutes) for h in ("H1", "H2")
    ]


def test_department_state(spark):
    series = department.national_series(spark.createDataFrame(states(60), schemas.DEPARTMENT_STATE))
    assert series.count() == 60
    newest = department.newest_state(series).first()
    assert (newest.arrivals, newest.available_beds, newest.occupancy_pct) == (138, 32, 79.0)
    live = serving.live_measures(spark.createDataFrame(states(60), schemas.DEPARTMENT_STATE)).first()
    assert (live.live_occupancy_pct, live.beds_available_now) == (79.0, 32)


def expected_pressure(rows_):
    import pandas as pd

    df = pd.DataFrame(rows_)
    recent, base = df.tail(20), df.head(max(len(df) - 20, 1))
    base_arr = max(base.arrivals.mean(), 0.01)
    amb = max(base.ambulances_waiting.mean(), 0.01)
    return (
        round((recent.arrivals.mean() - base_arr) / base_arr * 100, 1), round(recent.occupancy_pct.mean(), 1),
        int(df.available_beds.iloc[-1]), int(df.available_beds.iloc[-1] - base.available_beds.mean()),
        int(df.queue_length.iloc[-1]), int(df.ambulances_waiting.iloc[-1]),
        round((recent.ambulances_waiting.mean() - amb) / amb * 100, 1),
    )


@pytest.mark.parametrize("minutes", [60, 21, 20, 7, 1])
def test_pressure_metrics(spark, minutes):
    series = department.national_series(spark.createDataFrame(states(minutes), schemas.DEPARTMENT_STATE))
    got = department.pressure_metrics(series)
    want = expected_pressure([r.asDict() for r in series.orderBy("minute_ts").collect()])
    assert tuple(got.first()) == pytest.approx(want)
    line = questions.pressure_summary(got).first().summary
    assert line.startswith("Recent arrivals are +") and "ambulances wait" in line


def test_department_feed_as_stream(spark, tmp_path):
    spark.createDataFrame(states(30), schemas.DEPARTMENT_STATE).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.replay(spark, f"{tmp_path}/in", schema=schemas.DEPARTMENT_STATE)
    q = (
        department.national_series(stream).writeStream.format("memory").queryName("dept")
        .outputMode("complete").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert spark.table("dept").count() == 30


def day_files(table):
    return {p.parent.name: p for p in (table.parent / f"{table.name}_base").rglob("*.parquet")}


def counted(spark, rows_):
    return spark.createDataFrame([(*r[:2], "LON", r[2], 0, 0, 0) for r in rows_], schemas.MINUTE_COUNTS)


def test_only_touched_days_are_written_again(spark, tmp_path):
    table, at = tmp_path / "t", lambda d, m=0: dt.datetime(2025, 1, d, 10, m)
    counted(spark, [(at(d), "H1", 1) for d in (1, 2, 3)]).write.parquet(f"{table}/batch_id=0")
    minute_counts.compact(spark, str(table), 0)
    first = day_files(table)
    counted(spark, [(at(2), "H1", 5), (at(4), "H1", 7)]).write.parquet(f"{table}/batch_id=1")
    minute_counts.compact(spark, str(table), 1)
    minute_counts.drop_folded(spark, str(table))
    second = day_files(table)
    assert {d for d in second if d in first and first[d] == second[d]} == {"day=2025-01-01", "day=2025-01-03"}
    assert set(second) == {f"day=2025-01-0{d}" for d in (1, 2, 3, 4)} and not first["day=2025-01-02"].exists()
    assert rows(minute_counts.read_counts(spark, str(table)).select("minute_ts", "attendances")) == [
        (at(1), 1), (at(2), 6), (at(3), 1), (at(4), 7)
    ]


def test_closed_days_take_no_more_rows(spark, tmp_path):
    table, at = str(tmp_path / "t"), lambda d: dt.datetime(2025, 1, d, 10)
    counted(spark, [(at(1), "H1", 1), (at(2), "H1", 1)]).write.parquet(f"{table}/batch_id=0")
    minute_counts.compact(spark, table, 0, closed_before=dt.date(2025, 1, 2))
    before = day_files(tmp_path / "t")
    assert rows(minute_counts.late_counts(spark, table)) == []
    counted(spark, [(at(1), "H1", 4), (at(2), "H1", 2)]).write.parquet(f"{table}/batch_id=1")

    def seen():
        kept = rows(minute_counts.read_counts(spark, table).select("minute_ts", "attendances"))
        return kept, rows(minute_counts.late_counts(spark, table).select("minute_ts", "attendances"))

    want = ([(at(1), 1), (at(2), 3)], [(at(1), 4)])
    assert seen() == want  # still in the log
    minute_counts.compact(spark, table, 1)
    minute_counts.drop_folded(spark, table)
    assert seen() == want  # put aside
    assert day_files(tmp_path / "t")["day=2025-01-01"] == before["day=2025-01-01"]
    counted(spark, [(at(1), "H2", 9)]).write.parquet(f"{table}/batch_id=2")  # late rows only
    minute_counts.compact(spark, table, 2, closed_before=dt.date(2025, 1, 1))  # a day once closed stays closed
    minute_counts.drop_folded(spark, table)
    assert seen() == (want[0], [(at(1), 4), (at(1), 9)])


def test_large_deliveries_are_read_by_several_tasks(spark, monkeypatch, tmp_path):
    """Eight batches whatever the size; a delivery of many events is several files, all counted."""
    from checks import queries
    from checks.domain import Domain

    folder = "/root/testdata/sf0.001"
    read = []
    original = queries.events.replay

    def replay(spark, landed, **options):
        read.append((options["files_per_batch"], spark.read.parquet(landed).inputFiles()))
        return original(spark, landed, **options)

    monkeypatch.setattr(queries.events, "replay", replay)
    want = rows(queries.QUERIES["stream_minute_agg"](spark, folder))
    lost = [queries.QUERIES["no_loss_check"](spark, folder).first()["violations"]]
    monkeypatch.setattr(queries, "FILE_BYTES", 1 << 10)
    table, archive, dead = queries._stream_run(Domain(spark, folder))
    got = rows(queries.plain(queries.minute_counts.read_counts(spark, table)))
    assert got == want and lost == [0]
    per_batch, files = read[-1]
    assert read[0][0] == 1 and len(read[0][1]) == 8 and per_batch >= 2 and len(files) == 8 * per_batch
    batches = {f.rsplit("batch_id=", 1)[1].split("/")[0] for f in spark.read.parquet(archive).inputFiles()}
    assert batches == {str(b) for b in range(8)}
