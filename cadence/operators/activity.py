"""Active-user metrics.

* ``active_users``            distinct active users per hour/day/month/... (DAU, MAU series)
* ``users_active_in_n_periods`` users active in at least N distinct periods of a range
* ``streak_days``             first days plus day-after-day continuations
* ``user_timeline``           every event of a few named users

"Active" means: at least one event of an accepted action type in the period.
All distinct counts are exact and pre-aggregated map-side: a (period, user)
pair leaves a map task once however many events it has, so a single very
busy user never funnels its raw events into one reducer.  Per-user work
holds at most one entry per calendar period of the range.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions import period_start
from cadence.operators._common import in_range


_WORD = 63  # period bits per BIGINT (the sign bit stays clear)


def _period_index(ts: str | Column, grain: str) -> Column:
    """Number of the calendar period since year 0 / 1970 (consecutive)."""
    if grain == "day":
        return F.unix_date(F.to_date(ts))
    months = F.year(ts) * 12 + F.month(ts) - 1
    return {"month": months, "quarter": F.floor(months / 3), "year": F.year(ts)}[grain].cast("int")


def _bit_words(index: Column, low: int, high: int) -> list[Column]:
    """Per-group bit sets of ``index`` in ``[low, high]``, as one ``bit_or``
    per word: a fixed-size buffer for the hash aggregate."""
    words = []
    for base in range(low, high + 1, _WORD):
        at = index - F.lit(base)
        one = F.expr("1L")
        words.append(F.bit_or(F.when((at >= 0) & (at < _WORD), F.call_function("shiftleft", one, at.cast("int")))))
    return [F.coalesce(w, F.lit(0).cast("bigint")) for w in words]


def _index_range(start, end, grain: str) -> tuple[int, int] | None:
    """First and last period index of the half-open range (None if open)."""
    if start is None or end is None or grain not in ("day", "month", "quarter", "year"):
        return None
    first, last = (dt.date.fromisoformat(str(x)[:10]) for x in (start, end))

    def number(d: dt.date) -> int:
        months = d.year * 12 + d.month - 1
        return {"day": (d - dt.date(1970, 1, 1)).days, "month": months, "quarter": months // 3, "year": d.year}[grain]

    return number(first), number(last)


def _restrict(df, ts, start, end, date_col, action_col, actions):
    # Filter on the partition column when there is one (partition pruning),
    # else on the timestamp itself (Parquet row-group pushdown).
    df = in_range(df, date_col or ts, start, end)
    if actions is not None:
        df = df.where(F.col(action_col).isin(list(actions)))
    return df


def active_users(
    df: DataFrame,
    grain: str = "day",
    user: str = "user_id",
    ts: str = "timestamp",
    start=None,
    end=None,
    date_col: str | None = None,
    actions: Sequence[str] | None = None,
    action_col: str = "action_type",
    period_name: str = "period",
    value_name: str = "active_users",
) -> DataFrame:
    """Distinct active users per period: ``(period, active_users)``.

    grain ``day`` gives the DAU series, ``month`` the MAU series.  Null users
    are not counted.
    """
    df = _restrict(df, ts, start, end, date_col, action_col, actions)
    ntz = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    period = F.col(date_col) if (grain == "day" and date_col) else period_start(ts, grain, ntz=ntz)
    return (
        df.select(period.alias(period_name), F.col(user).alias("_u"))
        .groupBy(period_name)
        .agg(F.count_distinct("_u").cast("bigint").alias(value_name))
    )


def dau_series(df: DataFrame, **kw) -> DataFrame:
    kw.setdefault("period_name", "date")
    kw.setdefault("value_name", "daily_active_users")
    return active_users(df, grain="day", **kw)


def mau_series(df: DataFrame, **kw) -> DataFrame:
    kw.setdefault("period_name", "month")
    kw.setdefault("value_name", "monthly_active_users")
    return active_users(df, grain="month", **kw)


def users_active_in_n_periods(
    df: DataFrame,
    n: int = 12,
    grain: str = "month",
    user: str = "user_id",
    ts: str = "timestamp",
    start="2024-01-01",
    end="2025-01-01",
    date_col: str | None = None,
    actions: Sequence[str] | None = None,
    action_col: str = "action_type",
    value_name: str = "monthly_active_users",
    method: str = "count",
) -> DataFrame:
    """Number of users active in at least ``n`` distinct periods of ``[start, end)``.

    With n = 12 months inside one calendar year this is "active every month".
    One row, one BIGINT column.  Periods carry their year (``trunc``), so a
    range longer than a year does not merge January 2024 with January 2025.

    ``method="count"`` counts each user's distinct periods; ``"window"``
    numbers them with ``row_number()`` and keeps the n-th, the reference's
    form (Catalyst applies the rank limit before the shuffle).  Same result.
    """
    df = _restrict(df, ts, start, end, date_col, action_col, actions)
    period = period_start(ts, grain)
    if method == "window":
        pairs = df.select(F.col(user).alias("_u"), period.alias("_p")).distinct()
        nth = pairs.select("_u", F.row_number().over(Window.partitionBy("_u").orderBy("_p")).alias("_rn"))
        return nth.where(F.col("_rn") == n).agg(F.count("_u").cast("bigint").alias(value_name))
    span = _index_range(start, end, grain)
    missing = F.max(F.when(F.col(ts).isNull(), 1).otherwise(0))  # a null period counts as one more value
    if span is None:  # open range: one row per (user, period) first
        pairs = df.select(F.col(user).alias("_u"), period.alias("_p")).distinct()
        per_user = pairs.groupBy("_u").agg(F.count(F.lit(1)).alias("_n"))
    else:
        # One shuffle by user: each user's periods are bits, set map-side.
        words = _bit_words(_period_index(ts, grain), *span)
        per_user = df.groupBy(F.col(user).alias("_u")).agg(*[w.alias(f"_w{i}") for i, w in enumerate(words)], missing.alias("_null"))
        per_user = per_user.withColumn("_n", sum((F.bit_count(f"_w{i}") for i in range(len(words))), F.col("_null")))
    return per_user.where(F.col("_n") >= n).agg(F.count("_u").cast("bigint").alias(value_name))


def streak_days(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "timestamp",
    start="2024-01-01",
    end="2025-01-01",
    date_col: str | None = None,
    actions: Sequence[str] | None = None,
    action_col: str = "action_type",
    value_name: str = "daily_active_users",
) -> DataFrame:
    """Count of (user, day) that are the user's first active day in range or
    directly follow an active day — the reference's "daily streak" figure.

    Equals (#users) + (#day-to-day continuations).  In a closed range each
    user's active days are bits, set map-side (one shuffle by user, a
    fixed-size buffer per user); neighbouring bits are continuations.  An open
    range goes through one row per (user, day).
    One row; no row on empty input (the grouped sum has no group).
    """
    df = _restrict(df, ts, start, end, date_col, action_col, actions)
    day = F.col(date_col) if date_col else F.to_date(ts)
    # the first day counts 1; a null day sorts first and counts 1, and the day
    # after it counts 1 too (its difference to null is unknown -> 1)
    missing = F.max(F.when(day.isNull(), 1).otherwise(0))
    span = _index_range(start, end, "day")
    if span is None:
        pairs = df.select(F.col(user).alias("_u"), day.alias("_d")).distinct()
        before = F.lag("_d").over(Window.partitionBy("_u").orderBy("_d"))
        starts = F.when(F.col("_d").isNull() | before.isNull() | (F.datediff("_d", before) == 1), 1).otherwise(0)
        per_user = pairs.select("_u", starts.alias("_streak"))
    else:
        words = _bit_words(F.unix_date(day), *span)
        per_user = df.groupBy(F.col(user).alias("_u")).agg(*[w.alias(f"_w{i}") for i, w in enumerate(words)], missing.alias("_null"))
        w = [F.col(f"_w{i}") for i in range(len(words))]
        within = [F.bit_count(x.bitwiseAND(F.shiftright(x, 1))) for x in w]
        across = [F.shiftright(a, _WORD - 1).bitwiseAND(b).bitwiseAND(F.lit(1)).cast("int") for a, b in zip(w, w[1:])]
        some = F.when(sum((F.bit_count(x) for x in w), F.lit(0)) > 0, 1).otherwise(0)
        per_user = per_user.select(sum([*within, *across], F.col("_null") + some).alias("_streak"))
    return (
        per_user.groupBy(F.lit(1).alias("_g"))  # grouped: no row on empty input
        .agg(F.sum("_streak").cast("bigint").alias(value_name))
        .select(value_name)
    )


def daily_user_rollup(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "timestamp",
    date_col: str | None = "date",
    duration: str | None = "duration_ms",
) -> DataFrame:
    """One row per (user, day): ``(user_id, date, events, first_ts, last_ts
    [, duration_ms])`` — the preprocessing step for the activity jobs.

    Written once (partitioned by ``date``), it replaces the raw events for
    ``dau_series``, ``mau_series``, ``streak_days``,
    ``users_active_in_n_periods`` and ``insights.retention`` (pass
    ``ts="first_ts"``): each reads one row per active user-day instead of
    every event, with the same results.  Partial aggregation builds it
    map-side, so a busy user costs one row per day per map task.
    """
    day = F.col(date_col) if date_col else F.to_date(ts)
    aggs = [F.count(F.lit(1)).alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    if duration:
        aggs.append(F.sum(duration).alias(duration))
    return df.groupBy(F.col(user).alias(user), day.alias("date")).agg(*aggs)


def user_timeline(
    df: DataFrame, user_ids: Sequence, user: str = "user_id", order_by: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """All events of the named users, ordered by user then time (spot check)."""
    return df.where(F.col(user).isin(list(user_ids))).orderBy(user, *order_by)
