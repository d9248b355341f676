"""Skew and layout reports, and hot-key detection.

* ``partition_profile``  rows per physical partition (file/scan balance)
* ``key_frequency``      rows per join/group key, most frequent first (real key skew)
* ``key_skew_summary``   one row: keys, largest key's share, max / median rows per key
* ``hot_keys``           the keys too big for one task, as a table of proven size
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_HOT_KEYS = 100_000


def partition_profile(df: DataFrame) -> DataFrame:
    """``(partition_id, count)`` for the current physical partitioning, largest first."""
    return (
        df.select(F.spark_partition_id().alias("partition_id"))
        .groupBy("partition_id")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("partition_id"))
    )


def partition_totals(df: DataFrame, label: str) -> DataFrame:
    """``(table, rows)`` of a partition profile: what its counts add up to."""
    return partition_profile(df).agg(F.lit(label).alias("table"), F.sum("count").alias("rows"))


def key_frequency(df: DataFrame, key: str, top: int | None = 20, count_name: str = "count") -> DataFrame:
    """Rows per key, most frequent first, ties by key (a total order, so the
    top-k cut is deterministic).  Partial aggregation runs map-side, so even a
    key holding a third of the rows costs one row per map task in the shuffle."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name)).orderBy(F.col(count_name).desc(), F.col(key))
    return out.limit(top) if top else out


def key_skew_summary(df: DataFrame, key: str) -> DataFrame:
    """One row describing how skewed ``key`` is: ``keys``, ``rows``,
    ``max_key_rows``, ``max_key_share``, ``median_key_rows`` (exact) and
    ``max_to_median`` — the key-level answer to "is there skew?", which rows
    per scan partition cannot give.  Null keys are one key, as in a join's
    shuffle.

    One pass: rows per key, then keys per row count.  N rows have at most
    sqrt(2 N) different row counts, so the window over these is small for any
    table (1.4 million rows for 10^12).
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    everything = Window.partitionBy(F.lit(0))
    upto = everything.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sizes.withColumn("hi", F.sum("k").over(upto)).withColumn("last", F.sum("k").over(everything) - 1)

    def at(rank):
        return F.max(F.when((F.col("hi") - F.col("k") <= rank) & (rank < F.col("hi")), F.col("n")))

    median = ((at(F.floor(F.col("last") / 2)) + at(F.ceil(F.col("last") / 2))) / 2).cast("double")
    rows = F.sum(F.col("n") * F.col("k"))
    return s.agg(
        F.sum("k").alias("keys"),
        rows.cast("bigint").alias("rows"),
        F.max("n").alias("max_key_rows"),
        F.round(F.max("n") / rows, 6).alias("max_key_share"),
        median.alias("median_key_rows"),
        F.round(F.max("n") / median, 4).alias("max_to_median"),
    )


def hot_keys(df: DataFrame, key: str, min_rows: int, most: int = MOST_HOT_KEYS) -> DataFrame:
    """``(key, n)`` of the keys with more than ``min_rows`` rows (nulls
    excluded), as a lazy table.

    The threshold is raised to ``rows / most`` where that is more, so at most
    ``most`` keys can qualify whatever the table: the result is safe to
    broadcast.  (A key below it holds less than 1 / ``most`` of all rows.)
    """
    threshold = max(min_rows, df.count() // most)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > threshold)
