import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cadence.operators._common import in_range
from cadence.sources.local import local_table


def test_local_table_values_types_and_plan(spark):
    rows = [("o'k\\x", 5, 1.5, None, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), True), (None, -1, -0.0, "z", None, None, None)]
    t = local_table(spark, rows, "k string, n int, d double, z string, day date, t timestamp_ntz, b boolean")
    assert [tuple(r) for r in t.collect()] == rows
    assert t.dtypes == [("k", "string"), ("n", "int"), ("d", "double"), ("z", "string"), ("day", "date"), ("t", "timestamp_ntz"), ("b", "boolean")]
    assert local_table(spark, [], "a long").count() == 0


def test_local_table_carries_decimals_binary_and_instants(spark):
    rows = [(Decimal("123456789012345678.90"), bytearray(b"\x00'\\"), dt.datetime(2024, 6, 1, 12)), (None, None, None)]
    t = local_table(spark, rows, "d decimal(20,2), b binary, t timestamp")
    assert t.dtypes == [("d", "decimal(20,2)"), ("b", "binary"), ("t", "timestamp")]
    assert [tuple(r) for r in t.collect()] == rows


def test_in_range_literals_follow_column_type(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 0, 0), dt.date(2024, 1, 1)), (dt.datetime(2024, 1, 1, 23, 59), dt.date(2024, 1, 2))],
        "t timestamp_ntz, d date",
    )
    assert in_range(df, "t", "2024-01-01", "2024-01-01 12:00:00").count() == 1
    assert in_range(df, "d", dt.date(2024, 1, 2), None).count() == 1
    assert in_range(df, "t", None, dt.datetime(2024, 1, 2)).where(F.col("d").isNotNull()).count() == 2
