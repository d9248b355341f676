"""Small driver-side rows as a DataFrame, for bounded data only.

The rows go to Spark as an Arrow table, typed by the schema: every type Spark
has is carried as it is (decimals, binary, both kinds of timestamps), and no
Python worker is needed to read them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A DataFrame holding ``rows`` with the given schema."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(st)
    columns = list(zip(*rows)) if rows else [()] * len(st)
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, st)
