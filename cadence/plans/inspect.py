"""Read what Spark planned: physical-plan text, exchanges, pushed filters.

Used by the plan-shape tests (no Spark UI needed).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan ``df.explain(mode)`` would print, as a string."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def executed_plan_text(df: DataFrame) -> str:
    """Physical plan after execution (AQE final plan when adaptive)."""
    df._jdf.queryExecution().executedPlan()  # force planning
    return str(df._jdf.queryExecution().executedPlan().toString())


def count_exchanges(df: DataFrame) -> int:
    """Shuffle exchanges in the initial physical plan (broadcasts excluded)."""
    txt = plan_text(df, "simple")
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin|roundrobinpartitioning)", txt))


def has_broadcast_join(df: DataFrame) -> bool:
    return "BroadcastHashJoin" in plan_text(df, "simple")


def join_kinds(df: DataFrame) -> list[str]:
    return re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan_text(df, "simple"))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df, "simple"))


def partition_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_text(df, "simple"))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", plan_text(df, "simple"))


def num_partitions(df: DataFrame) -> int:
    """Physical partition count of ``df`` (scan splits or last shuffle)."""
    return df.rdd.getNumPartitions()
