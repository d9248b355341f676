import datetime as dt

import pytest
from conftest import SF001, rows
from pyspark.sql import functions as F

from cadence.operators import sessions
from cadence.sources.tables import interactions

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)


def ev(spark, data):
    return spark.createDataFrame(data, "event_id long, user_id string, timestamp timestamp, action_type string")


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def by_id(df):
    return {r["event_id"]: r for r in df.collect()}


def test_gap_1800_stays_1801_splits(spark):
    df = ev(spark, [(1, "u", at(0), "a"), (2, "u", at(1800), "a"), (3, "u", at(3601), "a")])
    out = by_id(sessions.sessionize(df, tiebreak=("event_id",)))
    assert [out[i]["session_id"] for i in (1, 2, 3)] == ["u_0", "u_0", "u_1"]
    assert [out[i]["time_diff"] for i in (1, 2, 3)] == [0, 1800, 1801]
    assert [out[i]["is_new_session"] for i in (1, 2, 3)] == [0, 0, 1]


def test_whole_second_rule(spark):
    # 1800.4 s apart but only 1800 whole-second boundaries apart -> same session
    a = T0 + dt.timedelta(microseconds=500_000)
    b = a + dt.timedelta(seconds=1800, microseconds=400_000)
    out = by_id(sessions.sessionize(ev(spark, [(1, "u", a, "x"), (2, "u", b, "x")])))
    assert out[2]["time_diff"] == 1800 and out[2]["session_id"] == "u_0"


def test_ties_share_session_and_nulls(spark):
    data = [
        (1, "u", at(0), "a"),
        (2, "u", at(5000), "a"),
        (3, "u", at(5000), "b"),
        (4, "u", None, "c"),
        (5, None, at(0), "d"),
        (6, "v", at(100), "e"),
    ]
    out = by_id(sessions.sessionize(ev(spark, data)))
    assert out[2]["session_id"] == out[3]["session_id"] == "u_1"
    assert out[4]["session_id"] == "u_0" and out[4]["time_diff"] == 0
    # first real event after a null-timestamp row: lag is null -> diff 0
    assert out[1]["time_diff"] == 0 and out[1]["session_id"] == "u_0"
    assert out[5]["session_id"] is None
    assert out[6]["session_id"] == "v_0"


def test_metrics_single_event_and_null_user_group(spark):
    data = [(1, "u", at(0), "a"), (2, "u", at(600), "a"), (3, "w", at(0), "a"), (4, None, at(0), "a"), (5, None, at(9000), "a")]
    m = {r["session_id"]: r for r in sessions.session_metrics(ev(spark, data)).collect()}
    assert m["u_0"]["session_duration_minutes"] == 10.0 and m["u_0"]["action_count"] == 2
    assert m["w_0"]["session_duration_minutes"] == 0.0 and m["w_0"]["action_count"] == 1
    # all null-user events form one group, as grouping by the null id does
    assert m[None]["action_count"] == 2


@pytest.mark.parametrize("chunk", [60, 600, 3600])
def test_chunk_width_changes_nothing(spark, chunk):
    df = interactions(spark, SF001)
    kw = dict(tiebreak=("event_id",), gap_seconds=1800, with_step=True)
    assert rows(sessions.session_core(df, **kw)) == rows(sessions.session_core(df, chunk_seconds=chunk, **kw))


def test_chunks_with_null_timestamps_and_ties(spark):
    data = [(i, "h", at(s) if s is not None else None, "a") for i, s in enumerate([None, None, 0, 10, 10, 4000, 4000, 4001, 9000, 20000, 20001])]
    data += [(100 + i, "c", at(s), "a") for i, s in enumerate([0, 5000, 5001])]
    data += [(200 + i, None, at(s) if s is not None else None, "a") for i, s in enumerate([None, 0, 9000])]
    df = ev(spark, data)
    kw = dict(tiebreak=("event_id",), with_step=True)
    plain = sessions.session_core(df, **kw)
    for chunk in (1, 7, 3600):
        assert rows(plain) == rows(sessions.session_core(df, chunk_seconds=chunk, **kw))


def _largest_window(df, chunk):
    """Rows of the largest (user, chunk) window of the session plan."""
    seconds = sessions._active_seconds(df, "user_id", "timestamp")
    return seconds.groupBy("user_id", F.floor(F.col("_sec") / chunk)).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("case", ["null users", "one-hour burst", "one second"])
def test_no_window_grows_with_a_users_events(spark, case):
    n = 20_000
    sec = {"null users": "id * 37 % 86400", "one-hour burst": "id % 3600", "one second": "0"}[case]
    user = {"null users": "CASE WHEN id % 10 = 0 THEN id END", "one-hour burst": "7L", "one second": "7L"}[case]
    df = spark.range(n).selectExpr("id AS event_id", f"{user} AS user_id", f"timestamp_seconds(1700000000 + {sec}) AS timestamp", "'a' AS action_type")
    assert _largest_window(df, 1800) <= 1800
    out = sessions.sessionize(df, tiebreak=("event_id",), chunk_seconds=1800)
    sizes = sessions.session_metrics(df, order=False, chunk_seconds=1800)
    assert out.count() == n and sizes.agg(F.sum("action_count")).first()[0] == n
    if case != "null users":
        assert sizes.collect()[0]["action_count"] == n


def test_decimal_and_binary_users(spark):
    df = ev(spark, [(1, "1", at(0), "a"), (2, "1", at(9000), "a"), (3, "2", at(0), "a")])
    for kind in ("decimal(20,2)", "binary"):
        got = sessions.session_core(df.withColumn("user_id", F.col("user_id").cast(kind)), tiebreak=("event_id",)).collect()
        assert {r["event_id"]: r["session_seq"] for r in got} == {1: 0, 2: 1, 3: 0}


def test_several_tiebreaks_and_none(spark):
    data = [(3, "u", at(0), "b"), (1, "u", at(0), "a"), (2, "u", at(0), "c"), (4, "u", at(9000), "a"), (5, "u", at(9000), "b")]
    df = ev(spark, data)
    two = by_id(sessions.session_core(df, tiebreak=("action_type", "event_id"), with_step=True))
    assert [two[i]["session_step"] for i in (1, 3, 2, 4, 5)] == [1, 2, 3, 1, 2]
    none = sessions.session_core(df).collect()
    assert sorted(r["session_seq"] for r in none) == [0, 0, 0, 1, 1]
    assert sum(r["is_new_session"] for r in none) == 1


def test_session_steps(spark):
    data = [(1, "u", at(0), "a"), (2, "u", at(60), "b"), (3, "u", at(5000), "c"), (4, "u", at(5001), "d"), (5, "u", at(5002), "e")]
    out = {r["timestamp"]: r["session_step"] for r in sessions.session_actions(ev(spark, data)).collect()}
    assert [out[at(s)] for s in (0, 60, 5000, 5001, 5002)] == [1, 2, 1, 2, 3]


def test_raw_events_are_shuffled_by_user_and_second_only(spark):
    from cadence.plans.inspect import plan_text

    df = interactions(spark, SF001)
    # the metrics never shuffle or sort raw events: counts per (user, second) first
    text = plan_text(sessions.session_metrics(df, order=False), "simple")
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text
    core = plan_text(sessions.session_core(df, tiebreak=("event_id",)), "simple")
    assert "ObjectHashAggregate" not in core and "SortAggregate" not in core


@pytest.mark.parametrize("cut", ["cache", "checkpoint", "table"])
def test_lineage_cuts_give_same_result(spark, cut):
    df = interactions(spark, SF001)
    kw = dict(tiebreak=("event_id",), chunk_seconds=600)
    try:
        assert rows(sessions.session_core(df, **kw)) == rows(sessions.session_core(df, cut=cut, **kw))
    finally:
        spark.catalog.clearCache()  # a persisted plan would serve later tests from memory


def test_running_count_chunks_equal_plain(spark):
    from cadence.operators.primitives import running_count

    df = interactions(spark, SF001)
    users = [r[0] for r in df.select("user_id").distinct().collect()]
    plain = running_count(df, tiebreak=("event_id",))
    split = running_count(df, tiebreak=("event_id",), chunk_seconds=900)
    assert rows(plain) == rows(split)
    first = plain.where("event_number = 1")
    assert first.count() == len(users) and first.where("seconds_since_previous is not null").count() == 0


def test_session_count_equals_session_window_on_whole_seconds(spark):
    df = interactions(spark, SF001).withColumn("timestamp", F.date_trunc("second", F.col("timestamp")).cast("timestamp_ntz"))
    ours = sessions.session_metrics(df, tiebreak=("event_id",), order=False).count()
    sw = df.groupBy("user_id", F.session_window(F.col("timestamp").cast("timestamp"), "30 minutes")).count().count()
    assert ours == sw == 9549
