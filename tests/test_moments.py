import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.operators import moments, scores


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(85, 7, 900)
    data = [
        (float(v) if i % 5 else None, float(2 * v + rng.normal()) if i % 7 else float("nan"), int(i % 11), 4.0, None)
        for i, v in enumerate(x)
    ]
    return spark.createDataFrame(data, "a double, b double, c long, same double, none double").repartition(5)


COLUMNS = ["a", "b", "c", "same", "none"]


def test_moments_of_known_pairs(table):
    pdf = table.toPandas().astype(float)
    got = {(r.x, r.y): r for r in moments.pairwise_moments(table, COLUMNS).collect()}
    assert len(got) == 15
    for (x, y), r in got.items():
        both = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
        u, v = both[x].to_numpy(), both[y].to_numpy()
        want = (u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum())
        assert r.n == len(both) and np.allclose((r.sx, r.sy, r.sxx, r.syy, r.sxy), want, rtol=1e-12)


def test_correlations_are_those_of_spark(table):
    got = {(r.x, r.y): r.r for r in scores.correlations(table, COLUMNS).collect()}
    clean = table.withColumn("b", F.nanvl("b", F.lit(None)))
    for (x, y), r in got.items():
        if "same" in (x, y):  # no spread: Spark's own function divides by zero
            assert r is None
            continue
        want = clean.agg(F.corr(x, y)).first()[0]
        assert (r is None) == (want is None)
        assert r is None or r == pytest.approx(want, abs=0.005)
    assert len(got) == 10 and got["a", "b"] > 0.98


def test_one_pass(table):
    plan = scores.correlations(table, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "corr(" not in plan


def test_gram(table):
    whole = table.select("a", "c").dropna()
    n, g = moments.gram(table, ["a", "c"])
    x = np.column_stack([whole.toPandas().to_numpy(float), np.ones(whole.count())])
    assert n == len(x) and np.allclose(g, x.T @ x)


def test_no_rows(table):
    none = table.limit(0)
    assert moments.pairwise_moments(none, COLUMNS).count() == 0
    assert scores.correlations(none, ["a", "c"]).collect() == [("a", "c", None)]
    assert moments.gram(none, ["a"])[0] == 0
