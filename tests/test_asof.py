import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardflow.operators.asof import asof_join

START = dt.date(2024, 1, 1)


def brute(left, right, back=0):
    out = []
    for k, day, x in left:
        known = [r for r in right if k is not None and day is not None and r[0] == k and r[1] is not None
                 and r[1] <= day - dt.timedelta(days=back)]
        best = max(known, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=(None, None, None))
        out.append((k, day, x, best[1], best[2]))
    return sorted(out, key=str)


def frames(spark, seed, keys=("a", "b", None)):
    draw = random.Random(seed)
    day = lambda: None if draw.random() < 0.05 else START + dt.timedelta(days=draw.randrange(900))
    left = [(draw.choice(keys), day(), i) for i in range(250)]
    right = [(draw.choice(keys), day(), draw.choice([None, 1.0, 2.0, i * 1.0])) for i in range(60)]
    return left, right, spark.createDataFrame(left, "k string, day date, x long"), spark.createDataFrame(right, "k string, day date, v double")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("back", [0, 30])
def test_every_row_against_all_pairs(spark, seed, back):
    left, right, a, b = frames(spark, seed)
    got = asof_join(a, b, ["k"], "day", ["v"], at=F.date_sub("day", back))
    assert got.columns == ["k", "day", "x", "asof_day", "asof_v"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, right, back)


def test_blocks_change_nothing(spark):
    left, right, a, b = frames(spark, 4)
    want = brute(left, right)
    for block in (F.lit(0), F.unix_date("_at"), F.floor(F.unix_date("_at") / 7)):
        assert sorted(map(tuple, asof_join(a, b, ["k"], "day", ["v"], block=block).collect()), key=str) == want


def test_no_older_than(spark):
    left, right, a, b = frames(spark, 5)
    got = asof_join(a, b, ["k"], "day", ["v"], within=F.date_sub("day", 10))
    want = [r if r[3] is None or r[3] >= r[1] - dt.timedelta(days=10) else (*r[:3], None, None) for r in brute(left, right)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_sides(spark):
    _, _, a, b = frames(spark, 6)
    assert asof_join(a, b.limit(0), ["k"], "day", ["v"]).filter("asof_day IS NOT NULL").count() == 0
    assert asof_join(a.limit(0), b, ["k"], "day", ["v"]).count() == 0


def test_no_window_holds_a_whole_series(spark):
    _, _, a, b = frames(spark, 7)
    plan = asof_join(a, b, ["k"], "day", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_block" in w.split("], [", 1)[1].split("]")[0] for w in windows) >= 1
