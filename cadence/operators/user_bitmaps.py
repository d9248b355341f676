"""Trailing active users from mergeable per-day bitmaps of user ids.

A day's users are a few bitmaps of 4 KB, one per 32,768 consecutive ids: a
fixed-size buffer, built map-side, whatever a user's volume.  Bitmaps of several
days are or-ed, so users active in the last 28 days are counted exactly from daily
state, and a new day is added without reading the events of any other.

Ids are whole numbers and should be dense (one bitmap serves 32,768 neighbours);
``user_id`` expressions like the digits of ``u000123`` do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators._common import in_range


def daily_bitmaps(df: DataFrame, user: str | Column = "user_id", ts: str = "timestamp", date_col: str | None = "date") -> DataFrame:
    """``(date, bucket, users)``: one bitmap per day and 32,768 ids.  Null users
    and null days do not count."""
    uid = (F.col(user) if isinstance(user, str) else user).cast("bigint")
    day = F.col(date_col) if date_col else F.to_date(ts)
    rows = df.select(day.alias("date"), uid.alias("uid")).where("date IS NOT NULL AND uid IS NOT NULL")
    return rows.groupBy("date", F.bitmap_bucket_number("uid").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("uid")).alias("users")
    )


def add_days(df: DataFrame, path: str, **kw) -> None:
    """Store the bitmaps of the days in ``df`` under ``path`` (partitioned by
    date), replacing these days and touching no other."""
    w = daily_bitmaps(df, **kw).hint("rebalance", "date").write.mode("overwrite")
    w.option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket bigint, users binary, date date").parquet(path)


def trailing_actives(bitmaps: DataFrame, days: int = 28, start=None, end=None, value_name: str = "trailing_active_users") -> DataFrame:
    """``(date, trailing_active_users)``: users active on the date or the
    ``days - 1`` before it, for every calendar day of ``[start, end)`` (default:
    first to last stored day) that has one.  Only the days needed are read."""
    if start is None or end is None:
        first, last = bitmaps.agg(F.min("date"), F.max("date")).first()
        if first is None:
            return bitmaps.select("date", F.lit(0).cast("bigint").alias(value_name)).limit(0)
        start = first if start is None else start
        end = F.date_add(F.lit(last), 1) if end is None else end
    low = F.lit(start).cast("date")
    high = end if isinstance(end, Column) else F.lit(end).cast("date")
    needed = bitmaps.where((F.col("date") > F.date_sub(low, days)) & (F.col("date") < high))
    reach = F.explode(F.sequence("date", F.date_add("date", days - 1))).alias("day")
    spread = needed.select(reach, "bucket", "users").where((F.col("day") >= low) & (F.col("day") < high))
    per_bucket = spread.groupBy("day", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n"))
    return per_bucket.groupBy(F.col("day").alias("date")).agg(F.sum("n").cast("bigint").alias(value_name))


def day_filter(df: DataFrame, day, date_col: str = "date") -> DataFrame:
    """The events of one day (partition pruning)."""
    return in_range(df, date_col, day, None).where(F.col(date_col) == F.lit(day).cast("date"))
