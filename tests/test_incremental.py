"""Work on what is new: sessions from batches, daily bitmaps, point lookups."""

import datetime as dt
import random

from conftest import SF001, rows
from pyspark.sql import functions as F

from cadence.operators import lookup, sessions, user_bitmaps
from cadence.plans.inspect import plan_text
from cadence.session import scratch_path
from cadence.sources.tables import interactions
from cadence.streaming.sessions import advance_sessions, replay_sessions, run_sessions_available_now

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id bigint, user_id string, timestamp timestamp_ntz, action string"


def events(n=500, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = rng.choice(["a", "a", "a", "b", "c", None])
        t = T0 + dt.timedelta(seconds=rng.randrange(20_000), microseconds=rng.choice([0, 0, 400_000]))
        out.append((i, user, None if i % 50 == 0 else t, "x"))
    return out


def test_batches_in_time_order_equal_one_run(spark):
    data = events()
    df = spark.createDataFrame(data, EVENTS)
    want = rows(sessions.sessionize(df, gap_seconds=120, tiebreak=("event_id",)))
    # the third cut parts events of one second; null times come in every batch
    cuts = [T0 + dt.timedelta(seconds=s) for s in (4000, 4000, 11_000)]
    batch = lambda r: sum(r[2] >= c for c in cuts) if r[2] else r[0] % 4
    parts = [spark.createDataFrame([r for r in data if batch(r) == b], EVENTS) for b in range(4)]
    assert parts[1].count() < 5
    assert rows(replay_sessions(parts, gap_seconds=120, tiebreak=("event_id",))) == want


def test_late_events_are_told_apart(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    one = spark.createDataFrame([(1, "a", at(1000), "x"), (2, "a", at(5000), "x"), (3, "b", at(10), "x")], EVENTS)
    step = advance_sessions(None, one, gap_seconds=100)
    assert {tuple(r) for r in step.state.collect()} == {("a", at(5000), 1), ("b", at(10), 0)}
    two = spark.createDataFrame([(4, "a", at(4000), "x"), (5, "a", at(5000), "x"), (6, "a", at(5100), "x"), (7, "a", at(5201), "x"), (8, "c", at(1), "x")], EVENTS)
    step = advance_sessions(step.state, two, gap_seconds=100)
    assert [r["event_id"] for r in step.late.collect()] == [4]
    got = {r["event_id"]: (r["time_diff"], r["is_new_session"], r["session_id"]) for r in step.rows.collect()}
    assert got == {5: (0, 0, "a_1"), 6: (100, 0, "a_1"), 7: (101, 1, "a_2"), 8: (0, 0, "c_0")}
    assert {tuple(r) for r in step.state.collect()} == {("a", at(5201), 2), ("b", at(10), 0), ("c", at(1), 0)}
    assert advance_sessions(step.state, two.limit(0)).rows.count() == 0


def test_a_stream_of_files_gives_the_batch_ids(spark):
    data = [r for r in events(200, 5) if r[2]]
    data.sort(key=lambda r: r[2])
    src, out, check = (scratch_path(spark, x) for x in ("src", "out", "check"))
    kw = dict(gap_seconds=300, tiebreak=("event_id",))
    for part in (data[:90], data[90:]):  # the second run goes on where the first has stopped
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
        run_sessions_available_now(stream, out, check, **kw)
    got = spark.read.parquet(f"{out}/rows").drop("batch")
    assert rows(got) == rows(sessions.sessionize(spark.createDataFrame(data, EVENTS), **kw))
    assert spark.read.parquet(f"{out}/late").count() == 0


def test_trailing_users_from_days_added_one_by_one(spark):
    rng = random.Random(2)
    acts = [(rng.choice([1, 5, 32_768, 32_769, 70_000, 0, -4, None]), dt.date(2024, 1, 1) + dt.timedelta(days=rng.choice([*range(9), 15, 16]))) for _ in range(60)]
    df = spark.createDataFrame(acts + [(9, None)], "user_id bigint, date date")
    path = scratch_path(spark, "days")
    days = sorted({d for _, d in acts})
    user_bitmaps.add_days(df.where(F.col("date") < F.lit(days[-1])), path)
    user_bitmaps.add_days(user_bitmaps.day_filter(df, days[-1]), path)
    user_bitmaps.add_days(user_bitmaps.day_filter(df, days[-1]), path)  # again: the day is replaced
    store = user_bitmaps.read_days(spark, path)

    def want(first, last, n):
        out = {}
        for k in range((last - first).days + 1):
            d = first + dt.timedelta(days=k)
            users = {u for u, x in acts if u is not None and 0 <= (d - x).days < n}
            if users:
                out[d] = len(users)
        return out

    for n in (1, 3, 28):
        assert {r[0]: r[1] for r in user_bitmaps.trailing_actives(store, n).collect()} == want(days[0], days[-1], n)
    one = user_bitmaps.trailing_actives(store, 3, "2024-01-08", "2024-01-09")
    assert [tuple(r) for r in one.collect()] == [(k, v) for k, v in want(dt.date(2024, 1, 8), dt.date(2024, 1, 8), 3).items()]
    text = plan_text(one, "simple")
    assert "PartitionFilters: [isnotnull(date" in text and "2024-01-05" in text
    assert user_bitmaps.trailing_actives(user_bitmaps.daily_bitmaps(df.limit(0))).count() == 0


def test_a_lookup_reads_little(spark):
    ev = interactions(spark, SF001)
    path = scratch_path(spark, "look")
    lookup.write_lookup_store(ev, path, partitions=16, keys_per_file=1000)
    for ids in ([7, 42], [42]):
        found = lookup.lookup(spark, path, ids)
        assert rows(found) == rows(ev.where(F.col("user_id").isin(ids)))
    assert lookup.rows_read(found) < 0.4 * ev.count()
    # ids inside a file's range that it does not hold: only the Bloom filter can tell
    even = spark.range(20_000).select((F.col("id") * 2).alias("user_id"), F.col("id").alias("timestamp"))
    lookup.write_lookup_store(even, path + "x", partitions=4, keys_per_file=10_000)
    nobody = lookup.lookup(spark, path + "x", [777, 20_001, 39_001])
    assert nobody.count() == 0 and lookup.rows_read(nobody) <= 5000
