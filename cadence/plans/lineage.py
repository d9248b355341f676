"""Cache and lineage cuts.

``checkpoint`` writes to the shared folder the cluster names in
``spark.checkpoint.dir`` (reliable checkpoint: survives executor loss).
``localCheckpoint`` is never used: its blocks die with the executor.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from cadence.session import scratch_path, shared_dir


def cut_lineage(df: DataFrame, how: str | None) -> DataFrame:
    """``how``: None (no-op), ``"cache"`` (memory+disk persist), ``"checkpoint"``
    (reliable checkpoint), ``"table"`` (write Parquet to the shared folder and
    read it back)."""
    if how is None:
        return df
    if how == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        shared_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "table":
        path = scratch_path(df.sparkSession, "table")
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    raise ValueError(f"unknown lineage cut {how!r}")
