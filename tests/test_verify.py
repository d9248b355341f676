"""Store comparison and freshness by interval."""

import datetime as dt

import pytest
from conftest import SF001, rows
from pyspark.sql import functions as F

from cadence.operators import freshness, verify
from cadence.sources.tables import interactions


def test_equal_stores_and_one_changed_row(spark):
    a = interactions(spark, SF001)
    b = a.repartition(3).select(*reversed(a.columns))
    same = verify.compare_stores(a, b, "event_id")
    assert same.equal and same.ranges == [] and same.rows.count() == 0
    key = a.select(F.max("event_id")).first()[0] // 2
    changed = b.withColumn("duration_ms", F.when(F.col("event_id") == key, -1).otherwise(F.col("duration_ms")))
    diff = verify.compare_stores(a, changed, "event_id")
    assert not diff.equal and len(diff.ranges) == 1
    low, high = diff.ranges[0]
    assert low <= key <= high and high - low < verify.LEAF_KEYS  # one small range is read
    got = {(r["event_id"], r["side"], r["times"], r["duration_ms"] == -1) for r in diff.rows.collect()}
    assert got == {(key, "a", 1, False), (key, "b", 1, True)}


def test_missing_repeated_and_keyless_rows(spark):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(5000)] + [(None, "n"), (None, "n")], "k bigint, v string")
    b = a.where("k IS NULL OR k != 4321").union(a.where("k = 17")).union(spark.createDataFrame([(9000, "new")], a.schema))
    diff = verify.compare_stores(a, b, "k", ranges=4, leaf_keys=50)
    assert {tuple(r) for r in diff.rows.collect()} == {(4321, "v4321", "a", 1), (17, "v17", "b", 1), (9000, "new", "b", 1)}
    less = a.where("k IS NOT NULL").union(spark.createDataFrame([(None, "n")], a.schema))
    diff = verify.compare_stores(a, less, "k")
    assert not diff.equal and diff.ranges == [] and [tuple(r) for r in diff.rows.collect()] == [(None, "n", "a", 1)]
    none = a.limit(0)
    assert verify.compare_stores(none, none, "k").equal
    assert verify.compare_stores(none, a.limit(3), "k").rows.count() == 3
    with pytest.raises(ValueError):
        verify.compare_stores(a, a.withColumn("w", F.lit(1)), "k")


def test_missing_intervals(spark):
    at = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    data = [("a", at(1, 0, 5)), ("a", at(1, 0, 50)), ("a", at(1, 3)), ("a", at(1, 23, 59)), ("b", at(1, 12)), ("c", at(2, 0)), (None, at(1, 5)), ("a", None)]
    df = spark.createDataFrame(data, "t string, ts timestamp_ntz")
    got = {tuple(r) for r in freshness.missing_intervals(df, "ts", "2024-01-01", "2024-01-02", label="t", expected=["a", "z"]).collect()}
    assert got == {
        ("a", at(1, 1), at(1, 3), 2), ("a", at(1, 4), at(1, 23), 19), ("b", at(1, 0), at(1, 12), 12), ("b", at(1, 13), at(2, 0), 11),
        ("c", at(1, 0), at(2, 0), 24), ("z", at(1, 0), at(2, 0), 24),
    }
    whole = freshness.missing_intervals(df, "ts", "2024-01-01", "2024-01-02", step_seconds=6 * 3600)
    assert [tuple(r) for r in whole.collect()] == [("all", at(1, 6), at(1, 12), 1)]
    empty = freshness.missing_intervals(df.limit(0), "ts", "2024-01-01", "2024-01-02")
    assert [tuple(r) for r in empty.collect()] == [("all", at(1, 0), at(2, 0), 24)]


def test_arrival_lag(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([(at(1, 10), at(1, 11)), (at(1, 20), at(4)), (at(2), None), (None, at(3))], "e timestamp_ntz, a timestamp_ntz")
    got = rows(freshness.arrival_lag(df, "e", "a", allowed_seconds=3600))
    want = [("all", at(1), 2, 60, 9600, 1), ("all", at(2), 1, None, None, 0), ("all", None, 1, None, None, 0)]
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
