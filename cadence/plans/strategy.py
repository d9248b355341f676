"""Join strategies with an explicit, checked choice.

``auto`` leaves the choice to Catalyst and AQE.  ``merge`` and
``shuffle_hash`` are hints.  ``broadcast`` is a promise that must hold: the
dimension's exact payload is measured (fixed-width bytes per column plus the
length of every string or binary value, plus per-row overhead), and a
dimension over the limits raises instead of quietly taking another plan.  A
derived dimension (joins, aggregates) is written to the shared folder first,
so it is built once, measured there and broadcast from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.plans.lineage import cut_lineage

STRATEGIES = ("auto", "broadcast", "merge", "shuffle_hash", "salted")
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024
DEFAULT_BROADCAST_ROWS = 50_000_000
_ROW_OVERHEAD = 16
_DERIVED = ("Join", "Aggregate", "Window", "Union", "Generate", "Expand", "Sort", "Limit", "Sample")


class BroadcastTooLarge(ValueError):
    """The dimension of an explicit broadcast join is over the limits."""


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files ``df`` reads (None when it reads none): the sum over
    the scans of its plan, not an estimate of its result."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()) if "Relation" in leaves.apply(i).nodeName()]
    return sum(sizes) if sizes and max(sizes) < 2**62 else None


def _value_bytes(field: T.StructField):
    c = F.col(f"`{field.name}`")
    dt = field.dataType
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
    return F.lit(8)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, payload bytes) of ``df``, measured by one distributed aggregate."""
    per_row = F.lit(_ROW_OVERHEAD)
    for f in df.schema.fields:
        per_row = per_row + _value_bytes(f)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(per_row), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])


def is_derived(df: DataFrame) -> bool:
    """Whether building ``df`` takes more than scans, projections and filters."""
    plan = str(df._jdf.queryExecution().optimizedPlan().toString())
    return any(line.lstrip(" :+-").startswith(_DERIVED) for line in plan.splitlines())


def broadcast_checked(
    dim: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES, max_rows: int = DEFAULT_BROADCAST_ROWS
) -> DataFrame:
    """``dim`` built once and hinted for broadcast; raises over the limits."""
    if is_derived(dim):
        dim = cut_lineage(dim, "table")
    rows, size = measured_size(dim)
    if rows > max_rows or size > max_bytes:
        raise BroadcastTooLarge(f"dimension has {rows} rows, {size} bytes; limits are {max_rows} rows, {max_bytes} bytes")
    return F.broadcast(dim)


def apply_strategy(
    dim: DataFrame, strategy: str, max_bytes: int = DEFAULT_BROADCAST_BYTES, max_rows: int = DEFAULT_BROADCAST_ROWS
) -> DataFrame:
    """``dim`` with the hint of the requested strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "broadcast":
        return broadcast_checked(dim, max_bytes, max_rows)
    return dim.hint(strategy) if strategy in ("merge", "shuffle_hash") else dim
