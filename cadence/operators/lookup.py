"""Point lookups: an events store in which a few users are found by reading little.

The store is range-partitioned and sorted by the key, so a file and a row group
cover a short range of keys (Parquet min/max), and every row group has a Bloom filter
of its keys, which rules out the groups whose range covers a key that they don't
hold.  A lookup is a plain filter: Spark pushes it into the scan, and the reader
skips files and row groups by both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 16 << 20


def write_lookup_store(
    df: DataFrame, path: str, key: str = "user_id", sort_by: Sequence[str] = ("timestamp",), partitions: int | None = None,
    keys_per_file: int = 1_000_000, row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Store ``df`` clustered by ``key``.  Ranges follow the other sort columns
    as well, so a key with a large share of all rows fills several files."""
    order = [F.col(f"`{c}`") for c in (key, *sort_by)]
    laid = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    w = laid.sortWithinPartitions(*order).write.mode("overwrite")
    w = w.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_per_file))
    w.option("parquet.block.size", str(row_group_bytes)).parquet(path)


def lookup(spark: SparkSession, path: str, ids: Sequence, key: str = "user_id") -> DataFrame:
    """All rows of the named keys."""
    return spark.read.parquet(path).where(F.col(f"`{key}`").isin(list(ids)))


def rows_read(df: DataFrame) -> int:
    """Rows that the file scans of ``df`` hand on when it runs: what pruning has
    left to filter."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    plan = query.executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total
