"""Small operators that the larger jobs are made of, exposed on their own.

* ``sum_numeric``      ``groupBy(k).sum()`` over every numeric column, named ``sum_<col>``
* ``running_count``    per-user running event number and previous-event gap (skew-safe windows)
* ``duration_band``    CASE WHEN banding with a null fill
* ``top_k``            sort + limit with a total order (TakeOrderedAndProject)
* ``time_features``    the scalar functions the jobs use, side by side
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions import days_between, epoch_seconds

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def sum_numeric(df: DataFrame, key: str) -> DataFrame:
    """Sum of every numeric column per ``key`` (the key itself included when
    numeric, as ``groupBy(k).sum()`` does); columns named ``sum_<col>``."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    return df.groupBy(key).agg(*[F.sum(c).alias(f"sum_{c}") for c in cols])


def running_count(
    df: DataFrame, user: str = "user_id", ts: str = "timestamp", tiebreak: Sequence[str] = (), **kw
) -> DataFrame:
    """``(…, event_number, seconds_since_previous)`` per user in time order.

    Runs on the session machinery with an infinite gap (one session per
    user), so a user holding a large share of the rows is spread over many
    tasks.  ``seconds_since_previous`` is null for a user's first event and 0
    after an event without timestamp.
    """
    from cadence.operators.sessions import session_core

    core = session_core(df, user=user, ts=ts, gap_seconds=2**62, tiebreak=tiebreak, with_step=True, **kw)
    return core.select(
        *df.columns,
        F.col("session_step").alias("event_number"),
        F.when(F.col("session_step") > 1, F.col("time_diff")).alias("seconds_since_previous"),
    )


def duration_band(df: DataFrame, col: str = "duration_ms", out: str = "duration_band") -> DataFrame:
    """``short`` < 10 s <= ``medium`` < 60 s <= ``long``; null -> ``unknown``."""
    band = (
        F.when(F.col(col) < 10_000, F.lit("short"))
        .when(F.col(col) < 60_000, F.lit("medium"))
        .when(F.col(col).isNotNull(), F.lit("long"))
    )
    return df.withColumn(out, band).fillna({out: "unknown"})


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """First ``k`` rows by ``by`` descending, ties broken by ``tiebreak``."""
    return df.orderBy(F.col(by).desc(), *[F.col(c) for c in tiebreak]).limit(k)


def time_features(df: DataFrame, ts: str = "timestamp", user: str = "user_id", key: str = "event_id") -> DataFrame:
    """month, to_date, date as string, days since the first day of the year,
    epoch seconds, rounded minutes, a concatenated label, and a comparison."""
    day = F.to_date(ts)
    return df.select(
        key,
        F.month(ts).alias("month"),
        day.alias("day"),
        day.cast("string").alias("day_text"),
        days_between(day, F.trunc(day, "year")).alias("day_of_year0"),
        epoch_seconds(ts).alias("epoch_seconds"),
        F.round((epoch_seconds(ts) % 86400) / 60, 2).alias("minute_of_day"),
        F.concat(F.col(user).cast("string"), F.lit("@"), day.cast("string")).alias("user_day"),
        ((F.hour(ts) >= 9) & (F.hour(ts) < 17)).alias("office_hours"),
    )
