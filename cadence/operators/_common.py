from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bound_literal(df: DataFrame, col_name: str, value) -> Column:
    """A literal typed like ``df[col_name]`` (DATE, TIMESTAMP or TIMESTAMP_NTZ),
    so the comparison stays a plain column-vs-literal predicate that Parquet
    and partition pruning can use."""
    dtype = df.schema[col_name].dataType
    if isinstance(value, str):
        value = dt.date.fromisoformat(value) if len(value) == 10 else dt.datetime.fromisoformat(value)
    if isinstance(dtype, T.DateType):
        if isinstance(value, dt.datetime):
            value = value.date()
        return F.lit(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(T.TimestampNTZType())
    return F.lit(value.isoformat(sep=" ")).cast(T.TimestampType())


def in_range(df: DataFrame, col_name: str, start=None, end=None) -> DataFrame:
    """Half-open ``[start, end)`` filter on ``col_name``; either bound optional."""
    if start is not None:
        df = df.where(F.col(col_name) >= bound_literal(df, col_name, start))
    if end is not None:
        df = df.where(F.col(col_name) < bound_literal(df, col_name, end))
    return df
