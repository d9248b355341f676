"""Time columns: epoch seconds, period starts, day differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.util import as_col

GRAINS = ("hour", "day", "week", "month", "quarter", "year")


def epoch_seconds(ts) -> Column:
    """Whole epoch seconds (sub-second part dropped), as ``unix_timestamp``.

    Works for TIMESTAMP and TIMESTAMP_NTZ.  BIGINT.
    """
    return F.unix_timestamp(as_col(ts))


def whole_second_gap(later, earlier) -> Column:
    """Difference of whole epoch seconds: what the session rule compares."""
    return epoch_seconds(later) - epoch_seconds(earlier)


def period_start(ts, grain: str, ntz: bool = False) -> Column:
    """Start of the hour/day/week/month/quarter/year containing ``ts``.

    Returned as TIMESTAMP for hour, DATE otherwise (so month series join
    cleanly with date dimensions).  With ``ntz`` (input is TIMESTAMP_NTZ) the
    hour start is built from the wall-clock fields, so it is TIMESTAMP_NTZ
    and independent of the session time zone.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    c = as_col(ts)
    if grain == "hour" and ntz:
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))
    if grain == "hour":
        return F.date_trunc("hour", c)
    if grain == "day":
        return F.to_date(c)
    return F.trunc(F.to_date(c), grain)


def days_between(end, start) -> Column:
    """``datediff(end, start)`` in days (INT); null when either side is null."""
    return F.datediff(as_col(end), as_col(start))
