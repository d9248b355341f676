"""Product insights proposed by the reference's final report.

* ``retention``              monthly cohorts: users of cohort c active k months later
* ``popular_actions``        events and distinct users per action type
* ``subscription_insights``  events, users, mean duration per subscription type
* ``activity_by_hour``       events and distinct users per hour of day
* ``version_usage``          events and users per app version, with numeric parts

All counts are exact; distinct counts go through map-side de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import period_start, version_part
from cadence.plans.strategy import DEFAULT_BROADCAST_BYTES, apply_strategy


def _month_index(c):
    return F.year(c) * 12 + F.month(c)


def retention(df: DataFrame, user: str = "user_id", ts: str = "timestamp") -> DataFrame:
    """``(cohort_month, months_since, active_users, cohort_users, retention)``.

    A user's cohort is the month of their first event.  Events are reduced to
    one row per (user, month) map-side; the cohort is the minimum over a
    user's months (at most one row per calendar month in a window).
    """
    pairs = (
        df.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
        .select(F.col(user).alias("_u"), period_start(ts, "month").alias("_m"))
        .distinct()
    )
    um = pairs.select(F.min("_m").over(Window.partitionBy("_u")).alias("cohort_month"), "_m")
    counts = (
        um.select("cohort_month", (_month_index(F.col("_m")) - _month_index(F.col("cohort_month"))).alias("months_since"))
        .groupBy("cohort_month", "months_since")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    w = Window.partitionBy("cohort_month")
    size = F.max(F.when(F.col("months_since") == 0, F.col("active_users"))).over(w)
    return counts.withColumn("cohort_users", size).withColumn(
        "retention", F.round(F.col("active_users") / F.col("cohort_users"), 6)
    )


def popular_actions(df: DataFrame, action: str = "action_type", user: str = "user_id") -> DataFrame:
    """``(action_type, events, users)``, most frequent first."""
    return (
        df.groupBy(action)
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct(user).alias("users"))
        .orderBy(F.col("events").desc(), F.col(action))
    )


def subscription_insights(
    events: DataFrame,
    users: DataFrame,
    attr: str = "subscription_type",
    key: str = "user_id",
    duration: str = "duration_ms",
    strategy: str = "auto",
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
) -> DataFrame:
    """``(subscription_type, events, users, avg_duration_ms)`` over matched events.

    Events are reduced to one row per user (count, duration sum) before the
    join; the per-group mean is the ratio of sums, equal to the row mean.
    """
    per_user = (
        events.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(duration).alias("_d"), F.count(duration).alias("_dn"))
    )
    dim = apply_strategy(users.select(key, attr), strategy, max_broadcast_bytes)
    return (
        per_user.join(dim, key)
        .groupBy(attr)
        .agg(
            F.sum("_n").cast("bigint").alias("events"),
            F.count_distinct(key).alias("users"),
            F.round(F.try_divide(F.sum("_d"), F.sum("_dn")), 4).alias("avg_duration_ms"),
        )
    )


def activity_by_hour(df: DataFrame, ts: str = "timestamp", user: str = "user_id") -> DataFrame:
    """``(hour, events, users)`` — hour of day 0..23."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(user).alias("users")
    )


def version_usage(df: DataFrame, version: str = "app_version", user: str = "user_id") -> DataFrame:
    """``(app_version, major, minor, patch, events, users)``."""
    return (
        df.groupBy(version)
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct(user).alias("users"))
        .select(
            version,
            version_part(version, "major").alias("major"),
            version_part(version, "minor").alias("minor"),
            version_part(version, "patch").alias("patch"),
            "events",
            "users",
        )
    )
