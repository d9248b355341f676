"""Exact percentiles without funnelling values into one task.

``percentile``/``median`` keep every distinct value of a group in one buffer,
and ``percentile_approx`` is approximate.  Here the exact linear-interpolated
percentile (same definition as SQL ``percentile_cont``) is computed as a
distributed selection:

1. histogram: value -> count, in the column's own type (map-side combined; a
   hot value is one row), range-partitioned by value and written to the shared
   folder with its partition number: the source is scanned once;
2. rows per partition and their running total (one row per partition) give
   the partitions that hold the wanted ranks;
3. only these are sorted: the values at ranks floor(p·(N-1)) and ceil(p·(N-1))
   are the histogram rows whose cumulative interval covers them.

Values keep their type until the interpolation between two of them, so
integers beyond 2^53 and decimals come back exactly where no interpolation is
needed (``low``, ``high``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.plans.lineage import cut_lineage


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """One row per probability: ``p``, ``value`` (DOUBLE), and ``low`` and
    ``high``, the neighbouring values in the column's type; nulls ignored.
    Empty input gives no rows."""
    if any(not 0.0 <= float(p) <= 1.0 for p in probs):
        raise ValueError(f"probabilities must lie in [0, 1], got {list(probs)}")
    spark = df.sparkSession
    hist = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    hist = cut_lineage(hist.repartitionByRange("v").withColumn("_b", F.spark_partition_id()), "table")
    per_part = hist.groupBy("_b").agg(F.sum("n").alias("_bn"))
    total = per_part.agg(F.sum("_bn")).first()[0]
    if not total:
        return spark.createDataFrame([], f"p double, value double, low {hist.schema['v'].dataType.simpleString()}, high {hist.schema['v'].dataType.simpleString()}")
    ranks = []
    for x in probs:
        pos = float(x) * (total - 1)
        ranks.append((float(x), math.floor(pos), math.ceil(pos), pos - math.floor(pos)))
    wanted = sorted({r for _, lo, hi, _ in ranks for r in (lo, hi)})

    def any_rank(holds) -> Column:
        return reduce(lambda a, c: a | c, [holds(r) for r in wanted])

    # one row per partition; at most one partition per wanted rank remains
    order = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = per_part.withColumn("_end", F.sum("_bn").over(order)).withColumn("_off", F.col("_end") - F.col("_bn"))
    parts = parts.where(any_rank(lambda r: (F.col("_off") <= r) & (F.lit(r) < F.col("_end")))).select("_b", "_off")
    inside = Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (
        hist.join(F.broadcast(parts), "_b")
        .withColumn("_hi", F.col("_off") + F.sum("n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("n"))
    )

    def holds(rank: int) -> Column:
        return (F.col("_lo") <= rank) & (F.lit(rank) < F.col("_hi"))

    picked = cum.where(any_rank(holds)).agg(*[F.max(F.when(holds(r), F.col("v"))).alias(f"_r{r}") for r in wanted])

    def row(p: float, lo: int, hi: int, frac: float) -> Column:
        low, high = F.col(f"_r{lo}"), F.col(f"_r{hi}")
        a, b = low.cast("double"), high.cast("double")
        value = a if frac == 0.0 else a + F.lit(frac) * (b - a)
        return F.struct(F.lit(p).alias("p"), value.alias("value"), low.alias("low"), high.alias("high"))

    return picked.select(F.explode(F.array(*[row(*r) for r in ranks])).alias("s")).select("s.p", "s.value", "s.low", "s.high")


def percentile_values(df: DataFrame, col: str, named: dict[str, float]) -> dict:
    """``{name: value}`` on the driver (a handful of scalars), e.g.
    ``{"q1": .25, "q3": .75}``: in the column's type where both neighbours are
    equal, else a double; values are None on empty input."""
    got = {
        r["p"]: r["low"] if r["low"] == r["high"] else r["value"]
        for r in exact_percentiles(df, col, list(named.values())).collect()
    }
    return {k: got.get(float(v)) for k, v in named.items()}
