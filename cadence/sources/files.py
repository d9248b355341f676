"""File sources and sinks: CSV, Parquet and ORC, Hive-style partitioned, plus noop.

CSV is always written *with* a header and read with ``header`` matching what
was written — reading headerless files with ``header=True`` silently drops
the first row of every part file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# What a lossless CSV round trip needs: quotes doubled inside quotes, spaces
# kept, nulls (nothing between two commas) told from empty strings (two
# quotes), and microseconds, which the default format would cut.  Reading needs
# no time format: without one Spark takes any ISO timestamp to the microsecond.
_CSV = {
    "quote": '"',
    "escape": '"',
    "charToEscapeQuoteEscaping": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CSV_READ = {**_CSV, "emptyValue": "", "nullValue": "\0"}
CSV_WRITE = {
    **_CSV,
    "emptyValue": '""',
    "nullValue": "",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    mode: str = "PERMISSIVE",
    corrupt_column: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV scan with an explicit schema (no inference pass over the data).

    ``multiline`` reads line breaks inside quoted values, at the price of one
    task per file."""
    reader = spark.read.format("csv").options(**CSV_READ)
    reader = reader.option("header", header).option("mode", mode).option("multiLine", multiline)
    if corrupt_column:
        schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_column, T.StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.schema(schema).load(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with a schema, INT32 files widen to LONG and partition
    columns are typed as declared."""
    reader = spark.read.format("parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    compression: str = "snappy",
    cluster_files: bool = True,
) -> None:
    """Partitioned Parquet sink.

    With ``cluster_files`` the rows go through a REBALANCE on the partition
    columns: each task writes few directories, and AQE splits a hot partition
    value over several tasks and merges small ones, so one busy day cannot
    land in a single writer.
    """
    if partition_by and cluster_files:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    header: bool = True,
    cluster_files: bool = True,
) -> None:
    """Partitioned CSV sink, header on by default (see ``write_parquet``)."""
    if partition_by and cluster_files:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).options(**CSV_WRITE).option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_orc(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """ORC scan (columnar, predicate pushdown like Parquet)."""
    reader = spark.read.format("orc")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_orc(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    compression: str = "zstd",
    cluster_files: bool = True,
) -> None:
    """Partitioned ORC sink (see ``write_parquet`` for the rebalance)."""
    if partition_by and cluster_files:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.orc(path)


def write_noop(df: DataFrame) -> None:
    """Run the whole plan without writing anything (timing sink)."""
    df.write.format("noop").mode("overwrite").save()


def convert(
    spark: SparkSession,
    src_csv: str,
    dst_parquet: str,
    schema: T.StructType,
    partition_by: Sequence[str] = (),
    header: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Re-store a CSV table as partitioned Parquet and return the Parquet reader."""
    write_parquet(read_csv(spark, src_csv, schema, header=header, multiline=multiline), dst_parquet, partition_by)
    return read_parquet(spark, dst_parquet, schema)
