"""Exact percentiles and modes per group, without a group in one task.

A histogram (group, value) -> count, combined map-side, is range-partitioned by
both columns and written once: a group with many different values lies in many
partitions.  One row per (group, partition) with its count gives, by running
sums, the partitions that hold a group's wanted ranks; only these rows of the
histogram are summed up value by value.  The largest window is one range
partition, whatever share of the table a group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.plans.lineage import cut_lineage


def group_histogram(df: DataFrame, group: str, col: str) -> DataFrame:
    """``(g, v, n)`` of the non-null values, written; null groups are a group."""
    rows = df.where(F.col(f"`{col}`").isNotNull())
    hist = rows.groupBy(F.col(f"`{group}`").alias("g"), F.col(f"`{col}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(hist.repartitionByRange("g", "v").withColumn("b", F.spark_partition_id()), "table")


def group_percentiles(df: DataFrame, group: str, col: str, probs: Sequence[float], hist: DataFrame | None = None) -> DataFrame:
    """``(group, p, value, low, high)``: the linearly interpolated percentile (a
    double) and the neighbouring values in the column's own type.  Groups
    without values give no row."""
    if any(not 0.0 <= float(p) <= 1.0 for p in probs):
        raise ValueError(f"probabilities must lie in [0, 1], got {list(probs)}")
    hist = hist if hist is not None else group_histogram(df, group, col)
    upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = hist.groupBy("g", "b").agg(F.sum("n").alias("pn"))
    parts = parts.withColumn("end", F.sum("pn").over(upto)).withColumn("off", F.col("end") - F.col("pn"))
    totals = parts.groupBy("g").agg(F.max("end").alias("total"))
    probs_col = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    wanted = totals.select("g", probs_col, "total").withColumn("pos", F.col("p") * (F.col("total") - 1))
    wanted = wanted.select("g", "p", (F.col("pos") - F.floor("pos")).alias("frac"), F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank"))
    null_safe = lambda a, b: F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))
    at = wanted.alias("w").join(parts.alias("q"), null_safe("w", "q") & (F.col("off") <= F.col("rank")) & (F.col("rank") < F.col("end")))
    at = cut_lineage(at.select(F.col("w.g").alias("g"), "b", "p", "frac", "rank", "off"), "table")
    inside = Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = at.select("g", "b", "off").distinct()
    some = hist.alias("h").join(needed.alias("d"), null_safe("h", "d") & (F.col("h.b") == F.col("d.b")))
    some = some.select(F.col("h.g").alias("g"), F.col("h.b").alias("b"), "v", "n", "off")
    some = some.withColumn("hi", F.col("off") + F.sum("n").over(inside)).withColumn("lo", F.col("hi") - F.col("n"))
    hit = at.alias("w").join(
        some.alias("s"),
        null_safe("w", "s") & (F.col("w.b") == F.col("s.b")) & (F.col("lo") <= F.col("rank")) & (F.col("rank") < F.col("hi")),
    )
    pair = hit.groupBy(F.col("w.g").alias("g"), "p", "frac").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    a, b = F.col("low").cast("double"), F.col("high").cast("double")
    value = F.when(F.col("frac") == 0, a).otherwise(a + F.col("frac") * (b - a))
    return pair.select(F.col("g").alias(group), "p", value.alias("value"), "low", "high")


def group_modes(df: DataFrame, group: str, col: str, hist: DataFrame | None = None) -> DataFrame:
    """``(group, mode, count)``: the smallest of the most frequent values, a
    grouped minimum over the histogram that is combined map-side."""
    hist = hist if hist is not None else group_histogram(df, group, col)
    best = hist.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("best"))
    return best.select(F.col("g").alias(group), F.col("best.v").alias("mode"), (-F.col("best.m")).alias("count"))
