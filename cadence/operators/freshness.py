"""Freshness by interval: which expected time slots have no data, and how late
data arrived.

Slots are whole steps of ``step_seconds`` from the epoch.  Rows are reduced to one
per (label, slot) map-side; from there on the work follows the calendar, not the
table, so the windows per label hold at most one row per slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators._common import bound_literal

HOUR = 3600


def _epoch(df: DataFrame, ts: str) -> Column:
    return bound_literal(df, ts, "1970-01-01")


def _slot(epoch: Column, ts: Column, step_seconds: int) -> Column:
    """Number of the slot: whole steps from the epoch by the column's own clock
    (wall clock for TIMESTAMP_NTZ), whatever the session time zone."""
    micros, step = F.timestamp_diff("MICROSECOND", epoch, ts), F.lit(step_seconds * 1_000_000)
    return ((micros - F.pmod(micros, step)) / step).cast("bigint")


def _start(epoch: Column, slot: Column, step_seconds: int) -> Column:
    return F.timestamp_add("SECOND", slot * step_seconds, epoch)


def missing_intervals(
    df: DataFrame,
    ts: str,
    start,
    end,
    label: str | None = None,
    expected: Sequence | None = None,
    step_seconds: int = HOUR,
) -> DataFrame:
    """``(label, gap_start, gap_end, slots)``: the maximal runs of slots in
    ``[start, end)`` without a row, per value of ``label`` (without one: of the
    table, as ``all``).  ``expected`` names labels that must be there even if the
    table holds none of them; rows without label or time are ignored."""
    spark = df.sparkSession
    name = F.col(f"`{label}`").cast("string") if label else F.lit("all")
    low, high = (bound_literal(df, ts, x) for x in (start, end))
    epoch = _epoch(df, ts)
    behind = F.timestamp_add("MICROSECOND", F.lit(-1), high)
    first, last = spark.range(1).select(_slot(epoch, low, step_seconds), _slot(epoch, behind, step_seconds)).first()
    present = df.where((F.col(ts) >= low) & (F.col(ts) < high)).select(name.alias("label"), _slot(epoch, F.col(ts), step_seconds).alias("slot"))
    present = present.where("label IS NOT NULL").distinct()
    labels = [str(x) for x in expected] if expected is not None else [] if label else ["all"]
    wanted = df.select(name.alias("label")).where("label IS NOT NULL").distinct() if label else None
    if labels:
        named = spark.createDataFrame([(x,) for x in labels], "label string")
        wanted = named if wanted is None else wanted.union(named).distinct()
    slots = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint")) if last >= first else F.array().cast("array<bigint>")
    missing = wanted.select("label", F.explode(slots).alias("slot")).join(present, ["label", "slot"], "left_anti")
    island = F.col("slot") - F.row_number().over(Window.partitionBy("label").orderBy("slot"))
    runs = missing.withColumn("island", island).groupBy("label", "island").agg(
        F.min("slot").alias("a"), F.max("slot").alias("b"), F.count(F.lit(1)).alias("slots")
    )
    return runs.select("label", _start(epoch, F.col("a"), step_seconds).alias("gap_start"), _start(epoch, F.col("b") + 1, step_seconds).alias("gap_end"), "slots")


def arrival_lag(
    df: DataFrame, ts: str, arrived: str, label: str | None = None, allowed_seconds: int = 86_400, step_seconds: int = HOUR
) -> DataFrame:
    """``(label, slot_start, rows, min_lag_seconds, max_lag_seconds,
    late_rows)`` per slot of ``ts``: how long after the event its row arrived,
    and how many took longer than allowed.  Rows without either time count in
    ``rows`` only."""
    epoch = _epoch(df, ts)
    lag = F.timestamp_diff("SECOND", F.col(ts), F.col(arrived))
    name = F.col(f"`{label}`").cast("string") if label else F.lit("all")
    return (
        df.select(name.alias("label"), _slot(epoch, F.col(ts), step_seconds).alias("slot"), lag.alias("lag"))
        .groupBy("label", "slot")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("lag").alias("min_lag_seconds"),
            F.max("lag").alias("max_lag_seconds"),
            F.count(F.when(F.col("lag") > allowed_seconds, 1)).alias("late_rows"),
        )
        .select("label", _start(epoch, F.col("slot"), step_seconds).alias("slot_start"), "rows", "min_lag_seconds", "max_lag_seconds", "late_rows")
    )
