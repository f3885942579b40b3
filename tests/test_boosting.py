import numpy as np
import pytest
from pyspark.ml import classification, regression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardflow.plans import boosting, training

SETTINGS = {"maxIter": 6, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 1.0, "seed": 42}


@pytest.fixture(scope="module")
def table(spark):
    """Features with fewer distinct values than bins, so that Spark ML's sampled edges are exact as well."""
    values = [F.floor(F.rand(i) * k).cast("double").alias(f"x{i}") for i, k in enumerate((4, 9, 28))]
    made = spark.range(0, 2000, 1, 3).select("id", *values, F.randn(9).alias("e"))
    made = made.withColumn("y", 4 * F.sin("x1") + F.col("x0") * F.col("x2") / 5 + F.col("e"))
    made = made.withColumn("label", (F.col("y") > 4).cast("double"))
    return training.vectors(made, ["x0", "x1", "x2"], "id", "y", "label")


def farthest(table, one, other, column="prediction"):
    both = one.transform(table).select("id", F.col(column).alias("a")).join(other.transform(table), "id")
    return both.agg(F.max(F.abs(F.col("a") - F.col(column)))).first()[0]


def test_a_fit_starts_few_jobs(spark, table):
    """An ensemble is one job over a small table: Spark ML started several for each tree."""
    context = spark.sparkContext
    context.setJobGroup("few", "")
    try:
        training.gbt(training.PooledRegressor, "y", 30).fit(table)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("few")) < 10


def test_regression_is_that_of_spark_ml(table):
    mine = boosting.PooledRegressor(labelCol="y", **SETTINGS).fit(table)
    assert farthest(table, mine, regression.GBTRegressor(labelCol="y", **SETTINGS).fit(table)) < 1e-9


def test_classification_is_that_of_spark_ml(table):
    mine = boosting.PooledClassifier(labelCol="label", **SETTINGS).fit(table).transform(table).select("id", F.col("probability").alias("p"))
    theirs = classification.GBTClassifier(labelCol="label", **SETTINGS).fit(table).transform(table).join(mine, "id")
    assert theirs.agg(F.max(F.abs(vector_to_array("probability")[1] - F.col("p")))).first()[0] < 1e-9


def test_many_blocks_fit_the_trees_of_one(table, monkeypatch):
    one = boosting.PooledRegressor(labelCol="y", **SETTINGS).fit(table)
    monkeypatch.setattr(boosting, "ONE_BLOCK", 0)
    monkeypatch.setattr(boosting, "ANCHOR", 2)
    many = boosting.PooledRegressor(labelCol="y", **SETTINGS)
    assert farthest(table, one, many.fit(table.repartition(3))) < 1e-9
    monkeypatch.setattr(boosting, "DIRECT", 2)
    assert farthest(table, one, many.fit(table.repartition(9))) < 1e-9


def test_the_order_of_rows_does_not_matter(table):
    booster = boosting.PooledRegressor(labelCol="y", **{**SETTINGS, "subsamplingRate": 0.7})
    one, other = (booster.fit(table.coalesce(1).sortWithinPartitions(order)) for order in ("id", F.desc("y")))
    assert farthest(table, one, other) == 0
    drawn = boosting.PooledRegressor(labelCol="y", **{**SETTINGS, "subsamplingRate": 0.7, "seed": 1}).fit(table)
    assert farthest(table, one, drawn) > 0


def test_constant_labels_and_features_give_a_constant(spark):
    made = spark.range(50).selectExpr("id", "1.0D AS a", "CAST(id AS double) AS b", "3.0D AS y", "CAST(id AS double) AS z")
    flat = training.vectors(made, ["a", "b"], "id", "y")
    assert [r.p for r in boosting.PooledRegressor(labelCol="y", **SETTINGS).fit(flat).transform(flat).selectExpr("round(prediction, 9) AS p").distinct().collect()] == [3.0]
    blind = training.vectors(made, ["a"], "id", "z")
    assert [r.p for r in boosting.PooledRegressor(labelCol="z", **SETTINGS).fit(blind).transform(blind).selectExpr("round(prediction, 9) AS p").distinct().collect()] == [24.5]


def test_rows_without_a_label_and_empty_tables_are_refused(spark, table):
    booster = boosting.PooledRegressor(labelCol="y", **SETTINGS)
    with pytest.raises(ValueError, match="no rows"):
        booster.fit(table.filter("id < 0"))
    with pytest.raises(Exception, match="no label"):
        booster.fit(table.withColumn("y", F.when(F.col("id") > 5, F.col("y"))))


def test_splits_that_part_the_rows_alike_take_the_first_feature():
    """Sums over one bin and over several of a finer feature differ by rounding, which must not choose the feature."""
    draw = np.random.default_rng(3)
    coarse = draw.integers(0, 2, 5000)
    codes = np.stack([coarse, coarse * 10 + draw.integers(0, 10, 5000)]).astype(np.uint8)
    y = coarse * 3 + draw.normal(size=5000)
    block = boosting.Block(0, codes, boosting.joined(codes, [2, 20]), y, np.zeros(5000))
    trees = [boosting.boosted(block, 1, 1, 0.1, boosting._squared, seed, 0.5)[0] for seed in range(40)]
    assert {int(tree.feature[0]) for tree in trees} == {0}


def test_features_are_counted_together(monkeypatch):
    """A histogram passes over the rows for a few features at once, and holds what one pass per feature gives."""
    draw, bins = np.random.default_rng(4), [32, 32, 4, 7, 2, 32, 1, 32, 32, 12]
    codes = np.stack([draw.integers(0, n, 3000) for n in bins]).astype(np.uint8)
    g, at, passes = draw.integers(-50, 50, 3000).astype(float), draw.integers(-1, 3, 3000), []
    joints, count = boosting.joined(codes, bins), np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(1) or count(*a, **k))
    found = boosting.histograms(joints, g, at, 3)
    assert len(passes) <= 2 * 5 < 2 * len(bins)
    assert all(np.prod(j.bins) <= boosting.CELLS for j in joints) and [f for j in joints for f in j.features] == [*range(10)]
    for node in range(3):
        rows = at == node
        for f, line in enumerate(codes):
            assert (found[node, 0, f] == count(line[rows], minlength=boosting.BINS)).all()
            assert (found[node, 1, f] == count(line[rows], g[rows], minlength=boosting.BINS)).all()


@pytest.mark.parametrize("depth", [1, 4, 8])
def test_rows_reach_the_leaf_of_their_bins(depth):
    draw, size = np.random.default_rng(depth), 2 ** (depth + 1) - 1
    codes = draw.integers(0, 32, (5, 400)).astype(np.uint8)
    feature = np.where(np.arange(size) < 2**depth - 1, draw.integers(-1, 5, size), -1)
    tree = boosting.Tree(feature, draw.integers(0, 31, size), draw.normal(size=size))
    for row, leaf in enumerate(boosting.leaves(codes, tree, depth)):
        node = 0
        while tree.feature[node] >= 0:
            node = 2 * node + 1 + int(codes[tree.feature[node], row] > tree.split[node])
        assert leaf == node
