import datetime as dt
import os
import tempfile

from conftest import SF001
from pyspark.sql import functions as F

from cadence.operators import activity, sessions
from cadence.sources.tables import interactions
from cadence.streaming import active_users_stream, run_available_now, session_metrics_stream


def _src(spark):
    base = tempfile.mkdtemp(prefix="cadence-stream-")
    return base, os.path.join(base, "src")


def test_incremental_dau_equals_batch_for_closed_days(spark):
    base, src = _src(spark)
    inter = interactions(spark, SF001)
    inter.where("date < '2024-01-16'").write.partitionBy("date").parquet(src)
    schema = spark.read.parquet(src).schema
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")

    def run():
        run_available_now(active_users_stream(spark.readStream.schema(schema).parquet(src)), out, ck)

    run()
    first = spark.read.parquet(out).count()
    inter.where("date >= '2024-01-16'").write.mode("append").partitionBy("date").parquet(src)
    run()  # second run only reads the new files
    got = {r["period"].date(): r["active_users"] for r in spark.read.parquet(out).collect()}
    want = {r["date"]: r["daily_active_users"] for r in activity.dau_series(inter, date_col="date").collect()}
    assert 0 < first < len(got)
    last = max(want)
    assert got == {d: n for d, n in want.items() if d < last}  # the newest day waits for the watermark


def test_streaming_sessions_match_batch_on_whole_seconds(spark):
    base, src = _src(spark)
    inter = interactions(spark, SF001).withColumn("timestamp", F.date_trunc("second", F.col("timestamp")).cast("timestamp_ntz"))
    inter.write.partitionBy("date").parquet(src)
    schema = spark.read.parquet(src).schema
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    run_available_now(session_metrics_stream(spark.readStream.schema(schema).parquet(src)), out, ck)
    got = spark.read.parquet(out).select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("start"), "action_count", "session_duration_minutes"
    )
    core = sessions.session_core(inter, tiebreak=("event_id",))
    batch = core.groupBy("user_id", "session_seq").agg(
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("last"),
        F.count(F.lit(1)).alias("action_count"),
        F.round((F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))) / 60, 2).alias("session_duration_minutes"),
    )
    key = ["user_id", "start", "action_count", "session_duration_minutes"]
    # every emitted session is exactly a batch session
    assert got.join(batch, key, "left_anti").count() == 0
    # every batch session that closed before the watermark was emitted
    watermark = inter.agg(F.max("timestamp")).first()[0] - dt.timedelta(hours=1)
    closed = batch.where(F.col("last") + F.expr("INTERVAL 30 MINUTES") < F.lit(watermark))
    assert closed.join(got, key, "left_anti").count() == 0
    assert closed.count() > 9000


def test_incremental_hourly_active_users_with_action_filter(spark):
    base, src = _src(spark)
    inter = interactions(spark, SF001).where("date <= '2024-01-03'")
    inter.write.partitionBy("date").parquet(src)
    schema = spark.read.parquet(src).schema
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    acts = ["click", "view"]
    stream = active_users_stream(spark.readStream.schema(schema).parquet(src), grain="hour", lateness="1 hour", actions=acts)
    run_available_now(stream, out, ck)
    got = {r["period"]: r["active_users"] for r in spark.read.parquet(out).collect()}
    want = {
        r["period"]: r["active_users"]
        for r in activity.active_users(inter, grain="hour", actions=acts).select(F.col("period").cast("timestamp").alias("period"), "active_users").collect()
    }
    assert got and all(want[p] == n for p, n in got.items())
    assert len(got) >= len(want) - 2  # the last hours wait for the watermark
