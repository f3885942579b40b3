import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow.operators import windows
from wardflow.plans import star
from wardflow.sources import bucketed

from .util import rows

KEYS = ["trust_code", "specialty_id"]


@pytest.fixture(scope="module")
def frames(spark):
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=i) for i in range(70)]
    activity = spark.createDataFrame(
        [(f"T{t}", f"S{s}", d, 10 * t + s + i % 5) for t in range(6) for s in range(3) for i, d in enumerate(days)],
        "trust_code string, specialty_id string, date_key date, admissions long",
    )
    waiting = spark.createDataFrame(
        [(f"T{t}", f"S{s}", f"2025-0{m}", 100 * m + t, 5.0 * s + m) for t in range(5) for s in range(3) for m in (1, 2, 3)],
        "trust_code string, specialty_id string, period string, waiting_list_size long, median_wait_days double",
    )
    return activity, waiting


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def stored(frames, tmp_path):
    activity, waiting = frames
    return (
        bucketed.save_bucketed(activity, "activity_by_series", KEYS, 4, ["date_key"], f"{tmp_path}/a"),
        bucketed.save_bucketed(waiting, "waiting_by_series", KEYS, 4, ["period"], f"{tmp_path}/w"),
    )


def test_month_bridge_moves_no_row(spark, frames, tmp_path, no_broadcast):
    want = star.bridge_months(*frames)
    assert bucketed.shuffles(want) > 0
    with bucketed.co_located(spark):
        got = star.bridge_months(*stored(frames, tmp_path))
        assert bucketed.shuffles(got) == 0
        assert rows(got.select(*want.columns)) == rows(want)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_windows_move_no_row(spark, frames, tmp_path):
    activity, _ = frames
    table, _ = stored(frames, tmp_path)
    want = windows.add_rolling_means(activity, "admissions", keys=KEYS)
    got = windows.add_rolling_means(table, "admissions", keys=KEYS)
    assert bucketed.shuffles(want) == 1 and bucketed.shuffles(got) == 0
    assert rows(got.select(*want.columns)) == rows(want)


def test_one_file_per_bucket(spark, frames, tmp_path):
    table, _ = stored(frames, tmp_path)
    assert 1 <= len(list((tmp_path / "a").glob("*.parquet"))) <= 4 and table.count() == frames[0].count()
    again = bucketed.save_bucketed(frames[0].filter("trust_code = 'T1'"), "activity_by_series", KEYS, 4, ["date_key"], f"{tmp_path}/a")
    assert again.select("trust_code").distinct().count() == 1


def test_bucket_count(spark):
    df = spark.range(100_000)  # 800,000 bytes
    assert bucketed.bucket_count(df) == 1 and bucketed.bucket_count(df, 300_000) == 4 and bucketed.bucket_count(df, 100_000) == 16
    assert bucketed.bucket_count(df.filter(F.lit(False))) == 1
