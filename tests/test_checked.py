import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.sources import checked, files

SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("key", T.StringType()), T.StructField("pct", T.DoubleType())])


def rules():
    return [checked.at_least(1), *checked.never_null("day", "key"), *checked.between("pct", 0, 100), checked.null_share("pct", 0.5)]


def feed(spark, n, **kw):
    rows = [(dt.date(2025, 1, 1 + i % 5), f"k{i}", 1.0 * (i % 90)) for i in range(n)]
    return spark.createDataFrame([tuple(kw.get(c, v) for c, v in zip(SCHEMA.names, r)) for r in rows], SCHEMA)


def test_values_are_those_of_the_written_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    got = checked.write_checked(feed(spark, 200).repartition(4), path, rules(), "1", ["day"])
    assert got == {"n_rows": 200, "day_nulls": 0, "key_nulls": 0, "pct_min": 0.0, "pct_max": 89.0, "pct_null_share": 0.0}
    back = checked.read_checked(spark, path, SCHEMA)
    assert back.count() == 200 and back.columns == SCHEMA.names and back.agg(F.count_distinct("day")).first()[0] == 5


@pytest.mark.parametrize("broken, name", [
    ({"key": None}, "key_nulls"), ({"pct": 130.0}, "pct_max"), ({"pct": -1.0}, "pct_min"), ({"pct": None}, "pct_null_share"),
])
def test_a_broken_feed_stops_and_changes_nothing(spark, tmp_path, broken, name):
    path = f"{tmp_path}/t"
    checked.write_checked(feed(spark, 50), path, rules(), "1")
    with pytest.raises(checked.BrokenFeed, match=name) as stopped:
        checked.write_checked(feed(spark, 60, **broken), path, rules(), "2")
    assert set(stopped.value.broken) == {name}
    assert checked.read_checked(spark, path, SCHEMA).count() == 50 and files.children(spark, path) == ["1"]


def test_empty_and_first_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert checked.read_checked(spark, path, SCHEMA).count() == 0
    with pytest.raises(checked.BrokenFeed, match="n_rows is 0"):
        checked.write_checked(feed(spark, 1).limit(0), path, rules(), "1")
    assert checked.read_checked(spark, path, SCHEMA).count() == 0
    assert checked.write_checked(feed(spark, 1).limit(0), path, rules()[3:5], "1") == {"pct_min": None, "pct_max": None}


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    for version, n in (("2025-01-01", 10), ("2025-01-02", 20), ("2025-01-02", 30)):
        checked.write_checked(feed(spark, n), path, rules(), version)
    assert checked.read_checked(spark, path, SCHEMA).count() == 30
    checked.drop_older(spark, path)
    assert files.children(spark, path) == ["2025-01-02"]


def test_checks_read_nothing_again(spark, tmp_path):
    source = f"{tmp_path}/source"
    feed(spark, 300).repartition(3).write.parquet(source)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = spark.read.schema(SCHEMA).parquet(source).mapInArrow(counted, SCHEMA)
    checked.write_checked(watched, f"{tmp_path}/t", rules(), "1")
    assert read.value == 300
