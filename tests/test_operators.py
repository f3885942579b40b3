import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardflow.operators import cleaning, dedup, positions, quality, quantiles, scores, snapshots, windows

from .util import by_key, column, day, rows


# de-duplication ---------------------------------------------------------------------------------

def test_keep_first_by_ingest_order(spark):
    df = spark.createDataFrame(
        [("a", 1, "late", 9), ("a", 1, "early", 2), (None, 1, "x", 5), (None, 1, "y", 4), ("b", 1, None, 1)],
        "k string, n int, v string, o int",
    )
    assert rows(dedup.keep_first(df, ["k", "n"], ["o"]).select("k", "v")) == [(None, "y"), ("a", "early"), ("b", None)]


def test_keep_latest(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("b", 2, 20)], "k string, d int, v int")
    assert rows(dedup.keep_latest(df, ["k"], ["d"])) == [("a", 3, 30), ("b", 2, 20)]


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2.0, 2)], "d double, n int")
    assert rows(dedup.union_all([a, b])) == [(1, "x", None), (2, None, 2.0)]
    empty = dedup.union_or_empty(spark, [], a.schema)
    assert empty.schema == a.schema and empty.count() == 0
    assert rows(dedup.distinct_pairs(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int"), "a", "b")) == [(1, 2)]


# snapshots --------------------------------------------------------------------------------------

SERIES = [
    ("H1", "2025-01-01", 100), ("H1", "2025-02-10", 110), ("H1", "2025-03-20", 150),
    ("H2", "2025-03-19", 5), ("H2", "2025-03-20", 7), ("H3", "2025-01-05", 9),
]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(h, day(d), v) for h, d, v in SERIES], "h string, date_key date, v int")


def test_latest_and_trailing(series):
    assert rows(snapshots.at_latest(series).select("h", "v")) == [("H1", 150), ("H2", 7)]
    assert rows(snapshots.trailing_days(series, 1).select("v")) == [(150,), (5,), (7,)]


def test_as_of(series):
    cutoff = F.date_sub(snapshots.latest(series), 30)
    assert rows(snapshots.as_of(series, ["h"], "v", "date_key", cutoff)) == [("H1", 110), ("H3", 9)]


def test_as_of_equals_row_number(spark, series):
    """The aggregate form gives what the ROW_NUMBER form of the same question gives."""
    series.createOrReplaceTempView("s")
    ranked = spark.sql(
        "SELECT h, v FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY date_key DESC) rn FROM s "
        "WHERE date_key <= (SELECT max(date_key) - INTERVAL 30 DAY FROM s)) WHERE rn = 1"
    )
    cutoff = F.date_sub(snapshots.latest(series), 30)
    assert rows(snapshots.as_of(series, ["h"], "v", "date_key", cutoff)) == rows(ranked)


def test_trailing_minutes_use_data_time(spark):
    t0 = dt.datetime(2020, 1, 1, 12, 0)
    df = spark.createDataFrame([(t0 - dt.timedelta(minutes=m),) for m in (0, 59, 60, 61)], "minute_ts timestamp")
    assert snapshots.trailing_minutes(df, 60).count() == 3
    with pytest.raises(ValueError):
        snapshots.trailing_minutes(df, 0)


def test_top_and_newest(series):
    assert column(snapshots.newest_first(series.select("date_key").distinct(), 2), "date_key") == [
        day("2025-03-19"), day("2025-03-20")
    ]
    assert column(snapshots.top(series, 2, "v", ["h"]), "v") == [150, 110]


def test_holdout(series):
    train, held = snapshots.split_holdout(series, 30)
    assert (train.count(), held.count()) == (3, 3)


# positions --------------------------------------------------------------------------------------

def test_positions_match_a_global_sort(spark):
    rng = random.Random(7)
    data = {(rng.choice("aaaab"), rng.randrange(5), rng.randrange(40), rng.randrange(100)) for _ in range(400)}
    df = spark.createDataFrame(sorted(data, key=lambda _: rng.random()), "k string, d int, h int, s int")
    got = positions.with_position(df, [["d"], ["h"], ["s", "k"]])
    want = sorted(data, key=lambda r: (r[1], r[2], r[3], r[0]))
    assert sorted((tuple(r)[4], tuple(r)[:4]) for r in got.collect()) == list(enumerate(want, 1))
    inside = positions.with_position(df, [["d"], ["h", "s"]], by=["k"])
    for k in "ab":
        mine = sorted((r.position, (r.d, r.h, r.s)) for r in inside.filter(F.col("k") == k).collect())
        assert mine == list(enumerate(sorted(r[1:] for r in data if r[0] == k), 1))


def test_lag_by_position(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "position long, v int")
    assert rows(positions.lag_by_position(df, "v", 2).select("position", "v_lag2")) == [
        (1, None), (2, None), (3, 10), (4, 20), (5, 30)
    ]


def test_blocked_windows_equal_plain_windows(spark):
    rng = random.Random(3)
    data = [("hot" if i % 5 else "cold", dt.date(2025, 1, 1) + dt.timedelta(days=i // 20), i, rng.choice([None, *range(9)]))
            for i in range(600)]
    df = spark.createDataFrame(data, "k string, d date, i int, v int")
    plain = windows.add_lag_features(
        windows.add_rolling_means(df, "v", keys=["k"], order=["d", "i"]), "v", keys=["k"], order=["d", "i"]
    )
    cut = windows.add_rolling_blocked(df, "v", ["k"], [["d"], ["i"]], block_rows=37)
    assert rows(cut.select(*plain.columns)) == rows(plain)
    with pytest.raises(ValueError):
        windows.add_rolling_blocked(df, "v", ["k"], [["d"], ["i"]], block_rows=10)


# quantiles --------------------------------------------------------------------------------------

@pytest.mark.parametrize("accuracy", [10_000, 100, 20])
@pytest.mark.parametrize("shape", ["spread", "ties", "hot", "tiny"])
def test_exact_quantiles(spark, accuracy, shape, monkeypatch):
    """A coarse sketch stands for a column far larger than the sketch."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    x = {
        "spread": rng.normal(size=3000),
        "tiny": rng.normal(size=3),
        "ties": rng.integers(0, 4, size=3000).astype(float),
        "hot": np.concatenate([np.full(2000, 5.0), rng.normal(size=1000)]),
    }[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x * 2})).withColumn(
        "y", F.when(F.col("y") < 100, F.col("y"))
    )
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, {"x": probs, "y": [0.5]})
    for p in probs:
        assert got["x"][p] == pytest.approx(np.quantile(x, p), abs=1e-12)
    assert got["y"][0.5] == pytest.approx(np.quantile(x * 2, 0.5), abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    got = quantiles.exact_quantiles(df, {"x": [0.5], "y": [0.5]})
    assert got == {"x": {0.5: None}, "y": {0.5: 1.5}}


def test_range_positions(spark):
    data = [(k, j) for k in ["b", "a", None, "é", "", "Z"] for j in range(50)] + [("a", 0)] * 3
    df = spark.createDataFrame(data, "code string, j int").repartition(5)
    got = [tuple(r) for r in positions.with_range_position(df, ["code", "j"], "p").orderBy("p").collect()]
    assert [p for *_, p in got] == list(range(1, len(data) + 1))
    key = lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])
    assert [r[:2] for r in got] == sorted(data, key=key)
    assert positions.with_range_position(df.limit(0), ["code"]).count() == 0


# cleaning ---------------------------------------------------------------------------------------

def test_headers_and_renames(spark):
    df = spark.createDataFrame([(1, 2)], " Trust_Code int, B int")
    assert cleaning.rename(cleaning.lower_headers(df), {"b": "c", "zz": "y"}).columns == ["trust_code", "c"]


def test_quantile_clip(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)] + [(None,)], "x double")
    got = cleaning.clip_to_quantiles(df, ["x", "absent"]).agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert tuple(got) == (1.0, 999.0, 1001)
    low = cleaning.clip_to_quantiles(df.withColumn("x", F.col("x") - 5), ["x"], lo=0)
    assert low.agg(F.min("x")).first()[0] == 0.0


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,), (2.0,)], "x double")
    assert sorted(column(cleaning.impute_median(df, "x"), "x")) == [1.0, 2.0, 2.0, 4.0]
    assert cleaning.impute_median(df, "absent") is df


def test_json_records(spark):
    df = spark.createDataFrame([(float("nan"), day("2025-01-02"), None)], "x double, d date, s string")
    assert column(cleaning.json_records(df), "record") == ['{"x":null,"d":"2025-01-02","s":null}']


# windows ----------------------------------------------------------------------------------------

def fact(spark, values, key="H1"):
    start = dt.date(2025, 1, 1)
    data = [(key, "S", start + dt.timedelta(days=2 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "hospital_id string, specialty_id string, date_key date, x double")


def test_windows_equal_pandas(spark):
    values = [1.0, None, 4.0, 0.0, 8.0, 16.0, 2.0, 3.0, 5.0, 1.0]
    df = fact(spark, values).unionByName(fact(spark, [9.0, 7.0], "H2"))
    got = windows.add_growth_rate(
        windows.add_lag_features(windows.add_rolling_means(df, "x"), "x"), "x", periods=(7,)
    ).filter("hospital_id = 'H1'").orderBy("date_key").collect()
    s = pd.Series(values, dtype=float)
    prev = s.shift(7)
    for n in (7, 14, 30):
        want = s.rolling(n, min_periods=1).mean()
        assert [r[f"x_roll{n}"] for r in got] == pytest.approx(list(want))
    for n in (1, 7):
        assert [r[f"x_lag{n}"] for r in got] == [None if pd.isna(v) else v for v in s.shift(n)]
    want = (s - prev) / prev.replace(0, np.nan)
    assert [r["x_growth7d"] for r in got] == [None if pd.isna(v) else v for v in want]


def test_fill_stays_inside_the_series(spark):
    df = fact(spark, [None, 2.0, None]).unionByName(fact(spark, [None, 5.0], "H2"))
    assert rows(windows.forward_fill(df, ["x"]).select("hospital_id", "date_key", "x")) == [
        ("H1", day("2025-01-01"), 0.0), ("H1", day("2025-01-03"), 2.0), ("H1", day("2025-01-05"), 2.0),
        ("H2", day("2025-01-01"), 0.0), ("H2", day("2025-01-03"), 5.0),
    ]


def test_lead_drops_open_ends(spark):
    assert rows(windows.add_lead(fact(spark, [1.0, 2.0, 3.0]), "x", 2).select("x", "target")) == [(1.0, 3.0)]


def test_known_lag_and_rolling(spark):
    history = spark.createDataFrame(
        [(day("2025-01-01"), 10.0), (day("2025-01-02"), 20.0), (day("2025-01-03"), 60.0)], "date_key date, v double"
    )
    future = spark.createDataFrame([(day("2025-01-04"),), (day("2025-01-08"),)], "date_key date")
    got = windows.known_lag(future, history, "v", 2, F.lit(60.0))
    assert rows(got) == [(day("2025-01-04"), 20.0), (day("2025-01-08"), 60.0)]
    both = future.unionByName(history, allowMissingColumns=True)
    roll = both.withColumn("r", windows.known_rolling(both, "v", 3, F.lit(60.0))).filter("date_key > '2025-01-03'")
    assert rows(roll.select("date_key", "r")) == [(day("2025-01-04"), 30.0), (day("2025-01-08"), 60.0)]


def test_all_features_share_one_window(spark):
    df = fact(spark, [1.0, 2.0]).withColumn("y", F.col("x") * 2)
    out = windows.add_all(df, ["x", "y"])
    assert {"month", "day_of_week", "x_roll30", "y_lag14", "y_growth30d"} <= set(out.columns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# scores -----------------------------------------------------------------------------------------

def test_peer_zscores(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "i int, a double, b double")
    got = by_key(scores.peer_zscores(df, ["a", "b"]), "i")
    assert (got[1]["a_z"], got[2]["a_z"], got[3]["a_z"]) == (-1.0, 1.0, None)
    assert {r["b_z"] for r in got.values()} == {0.0}


def test_regional_zscores(spark):
    data = [("A", 1.0), ("A", 2.0), ("A", 6.0), ("B", 4.0), ("C", 2.0), ("C", 2.0)]
    df = spark.createDataFrame(data, "region_id string, x double")
    got = {(r.region_id, r.x): r.x_regional_z for r in scores.regional_zscores(df, ["x"]).collect()}
    sd = statistics.stdev([1.0, 2.0, 6.0])
    assert got["A", 6.0] == pytest.approx((6 - 3) / sd)
    assert got["B", 4.0] is None and got["C", 2.0] is None


def test_error_scores(spark):
    data = [("m", 10.0, 9.0), ("m", 20.0, 25.0), ("m", 0.0, 5.0), ("m", None, 1.0), ("m", float("nan"), 1.0),
            ("none", 0.0, 1.0), ("bad", 1.0, 9.0)]
    df = spark.createDataFrame(data, "t string, actual double, predicted double")
    got = by_key(scores.error_scores(df, ["t"]), "t")
    assert got["m"] == {"t": "m", "mae": 3.0, "mape": 17.5, "accuracy": 82.5, "n_eval": 2}
    assert got["none"] == {"t": "none", "mae": None, "mape": None, "accuracy": None, "n_eval": 0}
    assert got["bad"]["accuracy"] == 0.0
    pair = spark.createDataFrame([(10.0, 9.0), (20.0, 25.0)], "actual double, predicted double")
    assert tuple(scores.mean_errors(pair).first()) == (3.0, pytest.approx(0.175))


def test_describe(spark):
    df = spark.createDataFrame([(str(v),) for v in (1, 2, 3, 10)] + [("x",)], "v string")
    got = scores.describe(df, ["v"]).first()
    want = pd.Series([1.0, 2.0, 3.0, 10.0]).describe()
    assert [got[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(want))


def test_correlations_are_pairwise_complete(spark):
    df = pd.DataFrame({"a": [1.0, 2, 3, 4, None], "b": [2.0, 1, 4, 3, 9], "c": [1.0, None, 2, 2, 5]})
    data = [tuple(None if pd.isna(v) else float(v) for v in r) for r in df.itertuples(index=False)]
    got = {(r.x, r.y): r.r for r in scores.correlations(spark.createDataFrame(data, "a double, b double, c double"), list("abc")).collect()}
    want = df.corr().round(2)
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y])


def test_shares(spark):
    df = spark.createDataFrame([("Red", 1), ("Amber", 2), ("Green", 0)], "c string, n long")
    assert rows(scores.shares(df, "c", whole_percent=True)) == [("Amber", 2, 67), ("Green", 0, 0), ("Red", 1, 33)]
    none = spark.createDataFrame([("Red", 0)], "c string, n long")
    assert rows(scores.shares(none, "c")) == [("Red", 0, 0.0)]


def test_trend_and_weekday(spark):
    start = dt.date(2025, 1, 6)
    data = [(start + dt.timedelta(days=i), 5.0 + 2.0 * i) for i in range(28)]
    got = scores.trend_and_weekday(spark.createDataFrame(data, "d date, v double"), "d", "v")
    assert all(abs(r.v - r.baseline) < 1e-6 for r in got.collect())


# quality ----------------------------------------------------------------------------------------

def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (3, "c")], "k int, h string")
    dim = spark.createDataFrame([("a",), ("b",)], "h string")
    days = spark.createDataFrame([(day("2025-01-01"),), (day("2025-01-04"),)], "date_key date")
    pairs = spark.createDataFrame([("T1", "H1"), ("T1", "H2"), ("T2", "H3")], "t string, h string")
    got = dict(
        rows(
            quality.report(
                [
                    quality.not_null(df, ["k"], "null"), quality.unique(df, ["k", "h"], "dup"),
                    quality.foreign_key(df, dim, "h", "fk"), quality.gap_free(days, "gap"),
                    quality.not_empty(df, "empty"), quality.not_empty(df.limit(0), "really empty"),
                    quality.one_to_one(pairs, "t", "h", "fan-out"),
                ]
            )
        )
    )
    assert got == {"null": 1, "dup": 1, "fk": 1, "gap": 2, "empty": 0, "really empty": 1, "fan-out": 1}


def test_numbering_is_dealt_by_the_bytes_read(spark, tmp_path, monkeypatch):
    """More input gives more partitions, not larger ones; the rows are sorted once and the numbers stay."""
    draw = random.Random(8)
    made = [(draw.randrange(5), draw.randrange(4), i, draw.random()) for i in range(3000)]
    spark.createDataFrame(made, "d int, h int, k int, v double").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    order = [["d"], ["h"], ["k"]]
    want = rows(positions.with_position(df, order))
    assert [r[-1] for r in sorted(want, key=lambda r: r[:3])] == list(range(1, 3001))
    monkeypatch.setattr(positions, "POSITION_BYTES", 1 << 10)
    dealt = positions.dealt(df, ["d", "h"])
    assert dealt.rdd.getNumPartitions() == positions.input_bytes(df) // 1024 + 1 > 8
    got = positions.with_position(df, order)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and rows(got) == want
    row_sorts = [line for line in plan.splitlines() if " Sort [" in line and "k#" in line]
    assert len(row_sorts) == 1
    assert positions.dealt(spark.createDataFrame(made, "d int, h int, k int, v double"), ["d"]).rdd.getNumPartitions() < 50
