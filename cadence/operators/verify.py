"""Proof that two stores hold the same rows, without moving them.

Each side is reduced to one line per key range: its rows and an order-free sum of
row hashes (a multiset checksum, combined map-side).  Ranges whose lines agree are
done.  Those that differ are cut into finer ranges and read again, with a filter on
the key that reaches the files, until they are small; only their rows are compared.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 64
LEAF_KEYS = 256
MOST_OPEN = 256


class StoreDiff(NamedTuple):
    equal: bool
    ranges: list[tuple[int, int]]  # key ranges (both ends inside) that differ; rows without key apart
    rows: DataFrame  # the rows that only one side has: all columns + ``side`` (a, b) + ``times``


def _line(df: DataFrame, group: Column, side: str) -> DataFrame:
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    other = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in sorted(df.columns)])
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    return df.groupBy(group.alias("range_no")).agg(
        F.count(F.lit(1)).alias(f"rows_{side}"), F.struct(total(row), total(other)).alias(f"sum_{side}")
    )


def range_checksums(a: DataFrame, b: DataFrame, key: str, low: int, high: int, ranges: int = RANGES) -> DataFrame:
    """``(range_no, low_key, high_key, rows_a, rows_b, equal)`` for ``ranges``
    even ranges of the whole-number ``key`` in ``[low, high]``; rows without key,
    or outside, are range -1."""
    width = -(-(high - low + 1) // ranges)
    k = F.col(f"`{key}`")
    group = F.when(k.between(low, high), F.floor((k - F.lit(low)) / F.lit(width))).otherwise(-1).cast("bigint")
    j = _line(a, group, "a").join(_line(b, group, "b"), "range_no", "full_outer")
    lows = F.when(F.col("range_no") >= 0, F.lit(low) + F.col("range_no") * width)
    return j.select(
        "range_no",
        lows.alias("low_key"),
        F.least(lows + (width - 1), F.lit(high)).alias("high_key"),
        F.coalesce("rows_a", F.lit(0)).alias("rows_a"),
        F.coalesce("rows_b", F.lit(0)).alias("rows_b"),
        (F.col("sum_a").eqNullSafe(F.col("sum_b")) & F.col("rows_a").eqNullSafe(F.col("rows_b"))).alias("equal"),
    )


def key_bounds(a: DataFrame, b: DataFrame, key: str) -> tuple[int, int]:
    """Least and greatest key of both sides ((0, 0) where there are none)."""
    both = [df.agg(F.min(f"`{key}`"), F.max(f"`{key}`")).first() for df in (a, b)]
    lows, highs = [r[0] for r in both if r[0] is not None], [r[1] for r in both if r[1] is not None]
    return (int(min(lows)), int(max(highs))) if lows else (0, 0)


def compare_stores(a: DataFrame, b: DataFrame, key: str, ranges: int = RANGES, leaf_keys: int = LEAF_KEYS) -> StoreDiff:
    """Compare two tables of the same columns by a whole-number ``key`` (which
    need not be unique).  The driver sees the lines of open ranges, at most
    ``MOST_OPEN`` of ``ranges`` lines each; where more differ, these are not cut
    further but compared row by row."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {a.columns}, {b.columns}")
    b = b.select(*[F.col(f"`{c}`") for c in a.columns])
    k = F.col(f"`{key}`")
    open_, leaves, keyless = [key_bounds(a, b, key)], [], False
    first = True
    while open_:
        found = []
        for low, high in open_:
            inside = k.between(low, high)
            left, right = (a, b) if first else (a.where(inside), b.where(inside))
            lines = range_checksums(left, right, key, low, high, ranges).where("NOT equal").collect()
            keyless |= any(r["range_no"] < 0 for r in lines)
            found += [(r["low_key"], r["high_key"]) for r in lines if r["range_no"] >= 0]
            first = False
        done = len(found) > MOST_OPEN
        leaves += [r for r in found if done or r[1] - r[0] < leaf_keys]
        open_ = [] if done else [r for r in found if r[1] - r[0] >= leaf_keys]
    some = F.lit(False)
    for low, high in leaves:
        some = some | k.between(low, high)
    some = (some | k.isNull()) if keyless else some
    left, right = a.where(some), b.where(some)
    tagged = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(-1)))
    net = tagged.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("side").alias("net")).where("net != 0")
    rows = net.select(*[F.col(f"`{c}`") for c in a.columns], F.when(F.col("net") > 0, "a").otherwise("b").alias("side"), F.abs("net").alias("times"))
    return StoreDiff(not leaves and not keyless, sorted(leaves), rows)
