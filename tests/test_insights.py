import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadence.operators import insights, quality
from cadence.plans import layout
from cadence.plans.inspect import num_partitions
from cadence.plans.lineage import cut_lineage


def test_version_usage_parses_and_tolerates_bad_versions(spark):
    df = spark.createDataFrame(
        [("a", "5.7.3"), ("b", "5.7.3"), ("a", "6.x.1"), ("c", None), ("c", "7.0")], "user_id string, app_version string"
    )
    out = {r["app_version"]: (r["major"], r["minor"], r["patch"], r["events"], r["users"]) for r in insights.version_usage(df).collect()}
    assert out["5.7.3"] == (5, 7, 3, 2, 2)
    assert out["6.x.1"] == (6, None, 1, 1, 1)
    assert out["7.0"] == (7, 0, None, 1, 1)
    assert out[None] == (None, None, None, 1, 1)


def test_retention_cohorts(spark):
    T = dt.datetime
    df = spark.createDataFrame(
        [("a", T(2024, 1, 5)), ("a", T(2024, 2, 1)), ("a", T(2024, 4, 1)), ("b", T(2024, 1, 9)), ("c", T(2024, 2, 2)), ("c", None)],
        "user_id string, timestamp timestamp",
    )
    got = {(r["cohort_month"], r["months_since"]): (r["active_users"], r["cohort_users"], r["retention"]) for r in insights.retention(df).collect()}
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    assert got == {(jan, 0): (2, 2, 1.0), (jan, 1): (1, 2, 0.5), (jan, 3): (1, 2, 0.5), (feb, 0): (1, 1, 1.0)}


def test_activity_by_hour_and_popular_actions(spark):
    T = dt.datetime
    df = spark.createDataFrame(
        [("a", T(2024, 1, 1, 9), "edit"), ("a", T(2024, 1, 2, 9), "edit"), ("b", T(2024, 1, 1, 23), "share")],
        "user_id string, timestamp timestamp, action_type string",
    )
    assert {r["hour"]: (r["events"], r["users"]) for r in insights.activity_by_hour(df).collect()} == {9: (2, 1), 23: (1, 1)}
    assert [(r["action_type"], r["events"], r["users"]) for r in insights.popular_actions(df).collect()] == [("edit", 2, 1), ("share", 1, 1)]


def test_timeliness_stale_flag(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 30, 12),)], "ts timestamp_ntz")
    r = quality.timeliness(df, "ts", "2024-02-01", "t", max_lag_hours=24).first()
    assert r["lag_hours"] == 36.0 and r["is_stale"] is True
    r = quality.timeliness(df, "ts", "2024-01-31", "t", max_lag_hours=24).first()
    assert r["lag_hours"] == 12.0 and r["is_stale"] is False


def test_layout_and_lineage_helpers(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert num_partitions(layout.reduce_partitions(df.repartition(8), 2)) == 2
    assert num_partitions(layout.cluster_by(df, "k", n=5)) == 5
    assert layout.rebalance_by(df, "k").count() == 1000
    assert cut_lineage(df, "table").count() == 1000
    with pytest.raises(ValueError):
        cut_lineage(df, "nope")
