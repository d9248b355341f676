"""Physical layout helpers: partition counts and clustering of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reduce_partitions(df: DataFrame, n: int) -> DataFrame:
    """Fewer partitions without a shuffle (``coalesce``).  Use on outputs
    (e.g. before writing a small result); applied right after a scan it caps
    the scan's parallelism at ``n`` tasks."""
    return df.coalesce(n)


def cluster_by(df: DataFrame, *cols: str, n: int | None = None) -> DataFrame:
    """Hash-distribute rows by ``cols`` (a shuffle), e.g. so each output file
    holds whole groups."""
    return df.repartition(n, *cols) if n else df.repartition(*cols)


def rebalance_by(df: DataFrame, *cols: str) -> DataFrame:
    """Distribute by ``cols`` but let AQE split hot values and merge small
    partitions (the REBALANCE hint)."""
    return df.hint("rebalance", *cols)
