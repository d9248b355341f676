"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.plans.lineage import cut_lineage
from cadence.session import ship_package

# Fixed by the data contract: the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col(f"`{name}`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` as names that no column of ``df`` has (nor one another)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sums_before(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, per name, the sum of the expression over all rows that come
    earlier in ``order`` (a total order).  Rows are dealt by ranges of it; the
    only window over everything has one row per range."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "table")
    totals = ranged.groupBy("range_no").agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_no", *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"from_{n}") for n in sums])
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged
    for n, c in sums.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = out.join(starts, "range_no")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"from_{n}"))
    return out.drop("range_no", *[f"from_{n}" for n in sums])


def text_or_empty(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def hash52(*parts: str | Column) -> Column:
    """52-bit integer from the MD5 of the parts joined by ``:`` (null reads as
    the word null): uniform, stable across runs and engines, and exact in a
    double."""
    text = F.concat_ws(":", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def unit_interval(h: Column) -> Column:
    """A 52-bit integer as a double strictly between 0 and 1."""
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_count(total: float, per_group: float, spark: SparkSession, per_partition: int = 4) -> int:
    """Number of groups so that none holds more than ``per_group`` on average
    and every shuffle partition has several of them to work on."""
    return max(1, math.ceil(total / per_group), min(math.ceil(total), per_partition * shuffle_partitions(spark)))
